"""Documents with the awkward cases, shared by the tests of this folder."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, score string, fp string, node string, "
          "kept string, unit string, window string, n string, size string, `_keep` string")


def word(rng):
    return "".join(rng.choice(["th", "an", "er", "on", "re", "in", "ti", "es"]) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def rows():
    rng = random.Random(5)
    long_text = prose(rng, 30_000)
    base = prose(rng, 60)
    texts = [None, "", "   \n\t ", "a", base, base, base + " tail", base.upper(), prose(rng, 40) + "\nline one\nline one\nline one",
             " ".join(["again"] * 400), long_text, "x" * 50_000, "1234 5678 ###", "été über señor naïve", "<|endoftext|> word",
             "tab\tnew\nline\x0bvt\x0cff\rcr", "\u2581lower one\u2581eighth  two  spaces ", "日本語 テスト", "\x00\x01 control"]
    texts += [prose(rng, rng.randint(1, 80)) for _ in range(40)]
    out = [(i, t, ["en", "fr", None][i % 3], "hot" if i % 3 else f"s{i}", len(t or "")) for i, t in enumerate(texts)]
    out += [out[4], out[4], (None, base, None, None, None), (None, "no id here", "en", None, 1), (10_000, base, "fr", "hot", 1)]
    return out


def frame(spark, some=None):
    some = rows() if some is None else some
    return spark.createDataFrame([(*r, *["clash"] * 10) for r in some], SCHEMA).repartition(4)
