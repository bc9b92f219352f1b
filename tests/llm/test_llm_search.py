"""Secret scan, ranked search, cross-tokenizer alignment."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from llm_cases import frame, prose, rows
from pyspark.sql import functions as F

from tidings.llm import queries, secret_scan, shared_search, token_alignment
from tidings.llm.common import table

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ---- secret scan ---------------------------------------------------------------

def naive_base(text):
    found = []
    for kind, pattern, group, least in (
            ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        found += [(m.start(), "assign access hex".split().index(kind), m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))


def secret_texts():
    rng = random.Random(3)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    b62 = string.ascii_letters + string.digits
    texts = [prose(rng, 80) for _ in range(1000)]
    texts += [f"é {prose(rng, 5)} {pick(b62, n)} end" for n in (32, 40, 48, 64, 100)]
    texts += [f"PassWord: '{pick(b62, 12)}' api_key=abc APIKEY == \"{pick('0123456789abcdef', 40)}\" tokeN=tooſhort paſſword=abcdefgh",
              f"AKIA{pick('ABCDEFGH234', 16)} AKIAAKIA AKIA{pick('ABC', 15)}", pick("0123456789abcdef", 24) * 2 + "g" + "a" * 23,
              "token = token=token:abcdef=", "secret" * 50 + " " * 500, "KKEY api_Key=abcdefgh"]
    texts += ["the_quick_brown_fox_jumps_over_the_lazy_dog", "internationalization-and-localization", "-" * 400, "0123456789" * 6,
              "/usr/local/share/documents/report/final/index", "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    return texts


def test_base_spans_equal_patterns():
    for text in secret_texts() + [r[1] for r in rows()]:
        got = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in secret_scan.base_spans(text or ""))
        assert got == naive_base(text)


def test_battery_is_calibrated_and_rejects_each_kind_of_order():
    rng = np.random.default_rng(1)
    for alphabet in secret_scan.ALPHABETS[:-1]:
        letters = np.frombuffer(alphabet.encode(), np.uint8)
        for n in (32, 100):
            got = secret_scan.battery(letters[rng.integers(0, len(letters), (2000, n))])
            # three degrees of freedom: mean 3, 95 % below 7.81
            assert 2.5 < got.mean() < 3.6 and 0.92 < (got < 7.81).mean() < 0.97
    uneven = rng.choice(np.frombuffer(b"0123456789abcdef", np.uint8), (50, 200), p=[0.4, *[0.04] * 15])
    blocks = np.repeat(np.frombuffer(b"0123456789abcdef" * 2, np.uint8)[rng.permuted(np.arange(32).repeat(50).reshape(32, 50).T, axis=1)], 4, axis=1)
    stairs = np.frombuffer((string.digits + string.ascii_lowercase).encode() * 3, np.uint8)[None]
    for order in (uneven, blocks, stairs):
        assert (secret_scan.battery(order) > secret_scan.RANDOM).mean() > 0.95


def test_cutoffs_control_the_false_discoveries_by_length():
    null = np.zeros((len(secret_scan.LENGTHS), secret_scan.CELLS), int)
    found = np.zeros_like(null)
    null[:, 100] = 1000
    null[0, 4] = 50  # short ordinary strings look random
    found[:, 2] = 10
    limits = secret_scan.cutoffs(np.stack([found, null]))
    assert limits[0] <= 4 * secret_scan.CELL and all(x == secret_scan.RANDOM for x in limits[1:])
    # ranked by hand: the largest p with p <= rate * rank / all
    rng = np.random.default_rng(2)
    counts = np.stack([rng.integers(0, 3, null.shape), rng.integers(0, 40, null.shape)])
    got = secret_scan.cutoffs(counts, 0.3)
    p = sorted((1 + counts[1, k, :c + 1].sum()) / (1 + counts[1, k].sum()) for k in range(len(null)) for c in range(secret_scan.CELLS)
               for _ in range(counts[0, k, c]))
    limit = max((x for x in p if x <= 0.3 * sum(y <= x for y in p) / len(p)), default=-1)
    for k, top in enumerate(got):
        cells = sum((1 + counts[1, k, :c + 1].sum()) / (1 + counts[1, k].sum()) <= limit for c in range(secret_scan.CELLS))
        assert top == min(secret_scan.RANDOM, cells * secret_scan.CELL)
    assert secret_scan.cutoffs(np.stack([found, 0 * null])) == [0] * len(null)


def test_scan_finds_random_strings_and_leaves_ordinary_ones(spark):
    texts = secret_texts()
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    limits = secret_scan.fit(docs)
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.scan(docs, limits).collect()}
    for i, text in enumerate(texts):
        naive = naive_base(text)
        assert ",".join(f"{k}:{s}:{e}" for k, s, e in got[i] if k != "random") == naive
        mine = [(s, e) for k, s, e in got[i] if k == "random"]
        if 1000 <= i < 1005:  # one token of 32 characters and more, after a letter of two bytes
            m = re.search(r"[A-Za-z0-9]{32,}", text)
            assert mine == [m.span()]
        else:
            assert not mine
    assert secret_scan.fit(docs.repartition(7)) == limits  # no matter how the rows are dealt


def test_secret_query_on_awkward_rows(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_secret_scans(spark, str(tmp_path)).collect()
    assert len(got) == len(rows())
    assert sorted(r["base_sha256"] for r in got) == sorted(hashlib.sha256(naive_base(r[1]).encode()).hexdigest() for r in rows())
    empty = table(spark, SMALL, "documents").limit(0)
    assert secret_scan.scan(empty, secret_scan.fit(empty)).collect() == []


def test_secret_query_of_the_table(spark):
    got = {r["doc_id"]: r for r in queries.op11_secret_scans(spark, SMALL).collect()}
    for r in table(spark, SMALL, "documents").collect():
        naive = naive_base(r["text"])
        kinds = Counter(x.split(":")[0] for x in naive.split(",") if x)
        row = got[r["doc_id"]]
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert row["base_sha256"] == hashlib.sha256(naive.encode()).hexdigest()
        assert [x for x in row["spans"].split(",") if x and not x.startswith("random")] == [x for x in naive.split(",") if x]


# ---- ranked search ---------------------------------------------------------------

def naive_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def naive_search(docs, items, k=10):
    counted = [(doc_id, Counter(w), len(w)) for doc_id, w in ((d, naive_terms(t)) for d, t in docs) if w]
    n_docs, n_terms = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        ranked = []
        for doc_id, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(naive_terms(text)) if c[t])
            if score > 0:
                ranked.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(sorted(ranked, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def items_frame(spark, some):
    return spark.createDataFrame([(*r, "clash", "clash", 7) for r in some], "item_id long, text string, row string, score string, doc_id long")


def awkward_items():
    rng = random.Random(8)
    out = [(1, None), (2, ""), (3, "!!! ..."), (4, "absent words only zzzz"), (5, prose(rng, 30)), (5, prose(rng, 30)), (None, "Again, again"),
           (6, "été SEÑOR über"), (7, "x" * 50_000), (8, prose(rng, 3000)), (9, "again again again")]
    return out + [(20 + i, prose(rng, rng.randint(1, 25))) for i in range(30)]


def test_search_equals_brute_force(spark):
    docs, items = frame(spark), items_frame(spark, awkward_items())
    expect = naive_search([(r[0], r[1]) for r in rows()], awkward_items())
    for size in (shared_search.BLOCK_BYTES, 20_000):  # one block of items, and many
        got = [tuple(r) for r in shared_search.search(docs, items, block_bytes=size).collect()]
        assert sorted(got, key=repr) == expect
    assert [f.simpleString() for f in shared_search.search(docs, items).schema] == \
        ["item_id:bigint", "rank:int", "doc_id:bigint", "score:bigint"]
    assert shared_search.search(docs.limit(0), items).collect() == [] and shared_search.search(docs, items.limit(0)).collect() == []


def test_ties_and_small_blocks_of_documents(spark, monkeypatch):
    monkeypatch.setattr(shared_search, "CELLS", 1)
    some = [(i, "alpha beta" if i % 3 else "alpha gamma", "en", "s", 1) for i in range(400)]
    random.Random(1).shuffle(some)
    items = [(1, "alpha beta"), (2, "gamma"), (3, "alpha beta gamma")]
    got = [tuple(r) for r in shared_search.search(frame(spark, some), items_frame(spark, items)).collect()]
    assert sorted(got, key=repr) == naive_search([r[:2] for r in some], items)


def test_sharing_evaluates_each_item_with_fewer_additions():
    rng = random.Random(4)
    common = [f"t{i}".encode() for i in range(40)]
    items = [sorted(set(rng.sample(common[:20], 12) + rng.sample(common, 5) + [f"own{i}".encode()])) for i in range(60)] + [[b"t1", b"t2"]] * 3
    plan = shared_search.mine(items)
    value = {t: rng.randint(1, 10 ** 9) for t in plan.vocabulary}
    sums = [0] * plan.size
    for term, number in plan.vocabulary.items():
        sums[plan.target[number]] += value[term]
    for node, (a, b) in enumerate(plan.pairs, plan.size - len(plan.pairs)):
        assert max(a, b) < node
        sums[node] = sums[a] + sums[b]
    assert [sum(sums[p] for p in parts) for parts in plan.parts] == [sum(value[t] for t in terms) for terms in items]
    additions = len(plan.pairs) + sum(len(p) - 1 for p in plan.parts)
    assert additions < 0.8 * sum(len(t) - 1 for t in items)


# ---- alignment ---------------------------------------------------------------

@pytest.fixture(scope="module")
def aligner():
    return token_alignment.Aligner(*token_alignment._files(queries.tokenizer_path(queries.BYTE_BPE), queries.tokenizer_path(queries.PIECE_MODEL)))


def naive_groups(text):
    """Groups from whole-text encodings and sets of end offsets."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not naive_groups.__dict__:
        naive_groups.a = Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE))
        naive_groups.a.encode_special_tokens = True
        naive_groups.b = SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_MODEL))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        naive_groups.byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    if not text:
        return []
    a, b = naive_groups.a.encode(" " + text, add_special_tokens=False), naive_groups.b.encode(text)
    a_ids = a.ids
    spelled_a = [bytes(naive_groups.byte[c] for c in t) for t in a.tokens]
    pieces = [naive_groups.b.id_to_piece(i) for i in b]
    spelled_b = [bytes([int(p[1:-1], 16)]) if naive_groups.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    if b"".join(spelled_a) != (" " + text).encode() or b"".join(spelled_b) != (" " + text).encode():
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in spelled_a]).tolist(), np.cumsum([len(x) for x in spelled_b]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((a_ids[i:p], b[j:q]))
        i, j = p, q
    return out


def naive_statistics(texts):
    found = [naive_groups(t) for t in texts]
    linked = [Counter((a, b) for x, y in groups for a in x for b in y) for groups in found]
    holders = Counter(pair for c in linked for pair in c)
    best = {}
    for (a, _), n in holders.items():
        best[a] = max(best.get(a, 0), n)
    for groups, c in zip(found, linked):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(c.values()),
               sum(n for (a, b), n in c.items() if holders[a, b] == best[a]), sum(n * holders[p] for p, n in c.items()),
               hashlib.sha256(text.encode()).hexdigest() if groups else "")


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def texts_of(some):
    return [r[1] for r in some]


def test_cuts_equal_common_ends():
    rng = np.random.default_rng(3)
    for _ in range(400):
        total = int(rng.integers(1, 400))
        inner = np.arange(1, total)
        shared = inner[rng.random(total - 1) < rng.choice([0.02, 0.5, 0.95])]
        ends = [np.unique(np.concatenate([shared, inner[rng.random(total - 1) < rng.choice([0, 0.02, 0.4])], [total]])).astype(np.int32) for _ in range(2)]
        at_a, at_b = token_alignment.cuts(*ends)
        common = [0, *sorted(set(ends[0].tolist()) & set(ends[1].tolist()))]
        assert [0, *ends[0][np.array(at_a[1:]) - 1].tolist()] == common == [0, *ends[1][np.array(at_b[1:]) - 1].tolist()]


def test_segments_align_like_the_whole_text(aligner, monkeypatch):
    rng = random.Random(6)
    texts = [t for t in texts_of(rows()) if t] + [prose(rng, 200) + "  spaces   and\n\nlines " + "don't we'll 日本 語 été 12 34 a▁b" + " " * 9 + "x" for _ in range(5)]
    texts += ["".join(rng.choice(" \t\n　a'sé1😀日́\x00<") for _ in range(300)) for _ in range(100)] + ["<s> </s><unk> <0x41> <|endoftext|> a"]
    for size in (1 << 16, 40):
        monkeypatch.setattr(token_alignment, "SEGMENT", size)
        for text in texts:
            parts = list(aligner.align(text))
            joined = ";".join(aligner.text_of(x) for x in parts) if None not in parts else ""
            assert joined == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in naive_groups(text)), text[:80]


def test_documents_of_units_equal_whole_texts(aligner, monkeypatch):
    rng = random.Random(8)
    marks = [".", ",", "'s", "\u0301", "\u200b", "\x1c", "\x85", "\u00a0", "\u3000", "\u180e", "😀", "日本", "_", "12", "a", "É", "'", "<s>", "\n"]
    texts = ["".join(rng.choice([" ", " ", "  ", *marks]) for _ in range(60)) for _ in range(150)]
    texts += [" ".join(rng.choice(["the", "été.", "(un", "x\ny", "long" * 12, "日" * 50, "'ll", "-"]) for _ in range(80)) for _ in range(20)] + [" " * 99 + "x " * 40, "a▁b c", "a", " ", "", None]
    expect = list(naive_statistics(texts))
    holders = Counter(p for x in map(naive_groups, texts) for p in {(a, b) for u, v in x for a in u for b in v})
    for settings in ({}, {"MAX_UNITS": 3, "PART": 2}, {"UNIT": 2, "PART_CHARS": 5}, {"LISTED": 1, "SEGMENT": 30}, {"LISTED": 0}):
        with monkeypatch.context() as m:
            for name, value in settings.items():
                m.setattr(token_alignment, name, value)
            m.setattr(aligner, "known", {})
            m.setattr(aligner, "before", {})
            got = [token_alignment.Document(aligner, t) for t in texts]
        assert [(d.n_a, d.n_b, d.n_groups, d.n_links, d.digest) for d in got] == [(*e[:4], e[6]) for e in expect], settings
        assert Counter((p >> 32, p & 0xFFFFFFFF) for d in got for p in d.pairs.tolist()) == holders
        assert [int(sum(n * holders[p >> 32, p & 0xFFFFFFFF] for p, n in zip(d.pairs.tolist(), d.counts.tolist()))) for d in got] == [e[5] for e in expect]


def test_unseen_units_are_encoded_once_in_short_texts(aligner, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(3000)]
    sent = []
    monkeypatch.setattr(aligner, "a_ids", lambda text, ids=aligner.a_ids: sent.append(text) or ids(text))
    monkeypatch.setattr(token_alignment, "MAX_UNITS", 1000)
    for name in ("known", "before"):
        monkeypatch.setattr(aligner, name, {}, raising=False)
    for start in range(0, 3000, 100):  # the same words at every turn, behind others that fill the store
        token_alignment.Document(aligner, ", ".join(words[start:start + 100]) + " the, same. words")
    assert sum(t.count(" the,") for t in sent) == 1
    sent.clear()
    token_alignment.Document(aligner, " ".join(w[::-1] for w in words))
    assert sum(map(len, sent)) > 8 * 2000 and max(map(len, sent)) < 8000


def test_kept_units_are_bounded_by_bytes(aligner, monkeypatch):
    rng = random.Random(14)
    for name, value in (("known", {}), ("before", {}), ("held", 0)):
        monkeypatch.setattr(aligner, name, value, raising=False)
    monkeypatch.setattr(token_alignment, "STORE_BYTES", 1 << 20, raising=False)
    for _ in range(80):  # few units, but of many tokens each
        token_alignment.Document(aligner, " ".join("".join(chr(rng.randrange(0x1F300, 0x1F5FF)) for _ in range(12)) for _ in range(200)))
        held = [len(u[0]) + len(u[1]) for store in (aligner.known, aligner.before) for u in store.values()]
        assert sum(held) < 2 * (1 << 20) + 200 * 4096
    assert len(held) > 200


def test_both_libraries_of_the_first_tokenizer_agree(aligner):
    assert aligner.by_rank is not None
    rng = random.Random(12)
    letters = [chr(c) for c in range(0x250) if token_alignment._PLAIN.fullmatch(chr(c))]
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(rng.choices("aab'st  \n.,19éß", k=rng.randint(1, 80))) for _ in range(4000)] + ["<|endoftext|> a", "a" * 999, " " * 999, "ab" * 500]
    expect = aligner.a.encode_batch(texts, add_special_tokens=False)
    assert [aligner.a_ids(t) for t in texts] == [e.ids for e in expect]


def test_statistics_equal_brute_force(spark):
    docs = frame(spark)
    expect = sorted(zip((r[0] for r in rows()), naive_statistics(texts_of(rows()))), key=repr)
    for size in (token_alignment.BLOCK_BYTES, 1, 3000):
        got = token_alignment.link_statistics(docs, queries.tokenizer_path(queries.BYTE_BPE), queries.tokenizer_path(queries.PIECE_MODEL), size).collect()
        assert sorted(((r["doc_id"], tuple(r[n] for n in NAMES)) for r in got), key=repr) == expect
    empty = queries.token_alignment.link_statistics(docs.limit(0), queries.tokenizer_path(queries.BYTE_BPE), queries.tokenizer_path(queries.PIECE_MODEL))
    assert empty.collect() == []


def test_blocks_and_texts_move_in_small_parts(spark, monkeypatch):
    rng = random.Random(15)
    docs = spark.createDataFrame([(i, prose(rng, 30)) for i in range(60)], "doc_id long, text string").coalesce(1)
    batch, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(batch)

    def written(*args, write=token_alignment.written, **options):
        size = spark.conf.get(batch)
        blocks = write(*args, **options)
        seen.append((size, blocks))
        return blocks

    monkeypatch.setattr(token_alignment, "written", written)
    files = [queries.tokenizer_path(name) for name in (queries.BYTE_BPE, queries.PIECE_MODEL)]
    assert token_alignment.link_statistics(docs, *files, 500).count() == 60
    (size, blocks), = seen
    assert int(size.rstrip("b")) <= 4 << 20 and spark.conf.get(batch) == before
    stored = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    assert sum(m.num_rows for m in stored) > 20
    assert max(m.row_group(i).num_rows for m in stored for i in range(m.num_row_groups)) <= 8
    # nothing per document and pair is a list, which Spark would take apart
    pairs = blocks.selectExpr("sum(aggregate(n_pairs, 0, (s, n) -> s + n))", "sum(size(pairs))").first()
    assert max(m.row_group(i).column(c).num_values for m in stored for i in range(m.num_row_groups) for c in range(m.num_columns)) < pairs[0] / 4
    assert pairs[0] > 60 * 20


def test_alignment_query_and_groups_of_the_table(spark):
    docs = table(spark, SMALL, "documents").orderBy("doc_id").collect()
    expect = dict(zip((r["doc_id"] for r in docs), naive_statistics([r["text"] for r in docs])))
    assert {r["doc_id"]: tuple(r[n] for n in NAMES) for r in queries.op13_token_alignment(spark, SMALL).collect()} == expect
    some = token_alignment.groups(table(spark, SMALL, "documents").where(F.col("doc_id") < 20), queries.tokenizer_path(queries.BYTE_BPE),
                                  queries.tokenizer_path(queries.PIECE_MODEL)).collect()
    by_id = {r["doc_id"]: r["text"] for r in docs}
    assert all([(g["a"], g["b"]) for g in r["groups"]] == naive_groups(by_id[r["doc_id"]]) for r in some)


def test_links_of_wide_groups_are_counted_without_listing(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 6, 300), rng.integers(0, 6, 200)
    cuts_a, cuts_b = np.array([0, 1, 200, 201, 300]), np.array([0, 3, 100, 101, 200])
    x = token_alignment.Aligned(a, b, cuts_a, cuts_b)
    want = Counter((int(p), int(q)) for i in range(4) for p in a[cuts_a[i]:cuts_a[i + 1]] for q in b[cuts_b[i]:cuts_b[i + 1]])
    for most in (10 ** 9, 50, 0):
        monkeypatch.setattr(token_alignment, "LISTED", most)
        found, n = token_alignment.links(x)
        assert Counter({(int(p) >> 32, int(p) & 0xFFFFFFFF): int(c) for p, c in zip(found, n)}) == want
