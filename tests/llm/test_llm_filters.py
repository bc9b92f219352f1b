"""Quality rules, language ID, URL filter, decontamination."""

import random

import numpy as np
import pytest
from llm_cases import frame, prose, rows
from pyspark.sql import functions as F

from tidings.llm import decontamination, language_id, quality_rules, queries, url_filter
from tidings.llm.common import table

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ---- quality rules ---------------------------------------------------------------

def naive_measures(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_measures_equal_brute_force():
    rng = random.Random(1)
    texts = [r[1] for r in rows() if not r[1] or len(r[1]) < 100_000]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["\n".join(rng.choice(["", " ", "x", "x ", "é #"]) for _ in range(12)) for _ in range(50)]
    for t in texts:
        assert quality_rules.measures(None if t is None else t.encode()) == naive_measures(t)


def test_window_hash_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(quality_rules.np, "unique", lambda h, **_: (h[:1], np.zeros(1, int), np.zeros(len(h), int), np.array([len(h)])))
    for t in ("a b c d e f g h i a b c d e f g h", "a a b c d e f g h i j k"):
        assert quality_rules.repeated_words(t.encode().split()) == naive_measures(t)[-1]


def test_llr_equals_counted_ngrams(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(i, int(i % 2), "x") for i in range(30)] + [(None, 1, "x"), (4, 1, "x")], "doc_id long, quality int, text string")
    ratio = quality_rules.fit(docs, labels, n=3, bits=10)
    raw, good = np.zeros(1024), np.zeros(1024)
    trusted = {i for i in range(30) if i % 2} | {4}
    for doc_id, text, *_ in rows():
        for c in quality_rules.cells((text or "").encode(), 3, 10):
            for x in c:
                raw[x] += 1
                good[x] += doc_id in trusted
    with np.errstate(all="ignore"):
        expect = np.where(raw > 0, np.log((good / good.sum() + 0.1 * raw / raw.sum()) / (1.1 * raw / raw.sum())), 0)
    assert np.allclose(ratio, expect)
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(docs, labels, n=3, bits=10).collect()}
    for doc_id, text, *_ in rows():
        r = got[doc_id, naive_measures(text)[0]]
        cells = np.concatenate([*quality_rules.cells((text or "").encode(), 3, 10), np.zeros(0, int)])
        assert r["score"] == pytest.approx(expect[cells].mean() if len(cells) else 0)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.MIN_SCORE)
    kept = quality_rules.keep_good(docs, labels, n=3, bits=10)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in quality_rules.judge(docs, labels, n=3, bits=10).collect())


def test_quality_of_labelled_documents(spark):
    got = queries.op9_quality_rules(spark, MEDIUM).join(table(spark, MEDIUM, "labels"), "doc_id").where("not base_failed")
    share = {r["quality"]: r["k"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.995 and share[0] < 0.1


def test_lower_case_random_letters_go_and_a_language_without_labels_stays(spark):
    rng = random.Random(11)
    docs, labels = table(spark, MEDIUM, "documents").select("doc_id", "text", "lang"), table(spark, MEDIUM, "labels")
    noise = [(-1 - i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(150)), "xx")
             for i in range(20)]
    docs = docs.unionByName(spark.createDataFrame(noise, docs.schema))
    some = labels.where("doc_id % 2 = 1").join(docs.where("lang = 'fr'").select("doc_id"), "doc_id", "left_anti")
    got = quality_rules.judge(docs, some).join(docs.select("doc_id", "lang"), "doc_id")
    assert {r["kept"] for r in got.where("doc_id < 0").collect()} == {False}
    good = got.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").where("not base_failed")
    shares = {r["lang"]: (r["k"], r["n"]) for r in good.groupBy("lang").agg(
        F.avg((F.col("letter_score") >= quality_rules.MIN_LETTERS).cast("int")).alias("k"), F.count(F.lit(1)).alias("n")).collect()}
    assert shares["fr"][1] > 20 and {k for k, _ in shares.values()} == {1.0}


def test_texts_in_a_script_without_trusted_text_are_not_judged_by_letters(spark):
    docs = table(spark, MEDIUM, "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, "日本語の文章をここに書きます " * 3 + "別の話もあります")], "doc_id long, text string"))
    got = quality_rules.judge(docs, table(spark, MEDIUM, "labels")).where("doc_id = -1").first()
    assert got["letter_score"] >= quality_rules.MIN_LETTERS


def test_no_labels_and_no_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_rules.judge(frame(spark), labels).collect()} == {0.0}
    assert quality_rules.judge(frame(spark, []), labels).count() == 0


# ---- language ID -----------------------------------------------------------------

def test_language_accuracy_on_held_out(spark):
    got = queries.op1_language_id(spark, MEDIUM).join(table(spark, MEDIUM, "documents"), "doc_id").where("held_out and accepted")
    right, total = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert total > 150 and right / total > 0.95
    labels = {r[0] for r in table(spark, MEDIUM, "documents").select("lang").distinct().collect()}
    assert {r[0] for r in queries.op1_language_id(spark, MEDIUM).select("lang_pred").distinct().collect()} <= labels | {"und"}


def test_held_out_labels_are_never_read(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    other = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    dicts = language_id.dictionaries(docs.where(~language_id.held_out()))
    assert dicts == language_id.dictionaries(other.where(~language_id.held_out()))
    assert "zz" not in dicts and all(len(d) <= language_id.DICT_BYTES for d in dicts.values())


def test_predictions_equal_plain_compression(spark):
    """Sizes of every language from zstandard itself, one setting for texts of all lengths."""
    import re

    import zstandard as z

    docs = table(spark, SMALL, "documents")
    dicts = language_id.dictionaries(docs.where(~language_id.held_out()))
    texts = [r["text"] for r in docs.collect()] + ["und", "der Hund", "le " * 3000, "x" * 1024, "y" * 1025, None, "", "12 34"]
    params = z.ZstdCompressionParameters(strategy=z.STRATEGY_BTLAZY2, min_match=3, search_log=6, chain_log=17, hash_log=16, window_log=17,
                                         target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False)
    tools = {k: z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params) for k, d in dicts.items()}
    classifier = language_id.Classifier(dicts)
    for text in texts:
        data = " ".join(re.findall(r"[^\W\d_]+", text or "")).lower().encode()
        got = classifier.predict(text)
        if not data:
            assert got == ("und", 0.0)
            continue
        sizes = {k: sum(len(c.compress(data[i:i + 4096])) for i in range(0, len(data), 4096)) for k, c in tools.items()}
        small, second = sorted(sizes.values())[:2]
        assert got == (min(dicts, key=sizes.__getitem__), (second - small) / second)


def test_every_sampled_text_enters_its_dictionary(spark):
    rng = random.Random(2)
    some = [(i, prose(rng, 60), "en", "s", 1) for i in range(40)] + [(100 + i, "the one copied text of many rows " * 9, "en", "s", 1) for i in range(40)]
    dicts = language_id.dictionaries(frame(spark, some), rows_per_lang=80, dict_bytes=8000)
    text = dicts["en"].decode()
    pieces = [language_id.letters(r[1]) for r in some[:40]]
    assert sum(any(p[i:i + 40] in text for i in range(len(p) - 40)) for p in pieces) == 40
    assert text.count("copied") <= 3  # a piece of it, not one per copy


def test_language_edges(spark):
    docs = frame(spark)
    dicts = language_id.dictionaries(docs)
    assert list(dicts) == sorted(dicts, key=lambda k: (-sum(r[2] == k and bool(r[1]) for r in rows()), k))
    got = language_id.identify(docs, dicts).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {r[0] for r in rows() if not any(c.isalpha() for c in r[1] or "")}
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}
    one = language_id.identify(docs, {"en": b"the words of a language " * 9}).where("lang_pred <> 'und'").collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0)}
    assert language_id.keep_identified(docs, dicts).columns == docs.columns
    assert language_id.dictionaries(frame(spark, [])) == {}


# ---- URL filter --------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "http://A.Example.COM/en/x?q", "https://www.example.com/en/", "http://example.com/en", "ftp://x.net/es/#f",
        "http://x.net/fr/", "http://xnet/fr/", "http://net/fr/", "http://com", "http://com/", "http://a.com:80/en/", "http://u@b.com/x",
        "//example.com/en/", "x://y://z.com/", "http://notexample.com/en/", "http://WWW.EXAMPLE.COM/EN/", "http://é.com/é", "http://" + "a." * 5000 + "com/" + "p" * 9000]


def naive_verdict(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url[url.index("://") + 3:]
    end = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.index(c) for c in "?#" if c in path] + [len(path)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


def url_rows(spark):
    return spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS + URLS[4:6])], "page_id long, url string, host string, verdict string")


@pytest.mark.parametrize("rules", [queries.URL_RULES, [], [url_filter.Rule("block", "com", ""), url_filter.Rule("allow", "a.com", "/")]])
def test_url_verdicts_equal_brute_force(spark, rules):
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(url_rows(spark), rules).collect()}
    assert got == {i: naive_verdict(u, rules) for i, u in enumerate(URLS + URLS[4:6])}


def test_digest_collisions_decide_nothing(monkeypatch, tmp_path):
    monkeypatch.setattr(url_filter, "digests", lambda keys: np.full(len(keys), 7, np.uint64))
    url_filter.write_array(queries.URL_RULES, str(tmp_path))
    array = url_filter.DigestArray({f: str(tmp_path / f"{f}.npy") for f in url_filter.FILES})
    keys = [r.host + r.path for r in queries.URL_RULES] + ["nothing", ""]
    found = array.find(keys)
    assert found[-2:] == [-1, -1] and sorted(found[:-2]) == list(range(5))
    assert isinstance(array.digests, np.memmap)


def test_empty_pages(spark):
    assert url_filter.judge(url_rows(spark).where("false"), queries.URL_RULES).count() == 0


# ---- decontamination -------------------------------------------------------------

def naive_scan(text, items, window=13):
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, names = split(text), set(), set()
    for name, item in items:
        w = split(item)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i:i + window]
            for j in range(len(words) - len(part) + 1):
                if words[j:j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    names.add(name)
    return len(words), len(hit), sorted(names)


def test_scan_equals_brute_force(spark):
    rng = random.Random(2)
    items = [("1", prose(rng, 40)), ("2", prose(rng, 5)), ("3", None), ("4", ""), ("5", "!!"), ("5", "Only-One_word"), ("null", prose(rng, 13))]
    items.append(("6", items[0][1]))
    texts = [prose(rng, 50) + " " + items[0][1][20:] + "!", items[1][1].upper().replace(" ", "--"), items[6][1] + " " + items[6][1], None, "", "only one word",
             "Éa " + items[1][1] + " é", prose(rng, 300)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(None if n == "null" else int(n), t) for n, t in items], "item_id long, text string")
    got = decontamination.scan(docs, bench).collect()
    for r in got:
        n, hit, names = naive_scan(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, names)
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
        raw = (texts[r["doc_id"]] or "").encode()
        assert sum(len(decontamination.words(raw[s["start"]:s["stop"]])) for s in r["spans"]) == hit
    clean = decontamination.keep_clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r["contaminated"] for r in got)
    assert decontamination.scan(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontamination.scan(docs.where("false"), bench).count() == 0
    with pytest.raises(ValueError):
        decontamination.items_of(bench, max_bytes=10)
