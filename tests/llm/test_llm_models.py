"""SentencePiece lattice, token counts, LM scoring."""

import random
from collections import Counter

import numpy as np
import pytest
from llm_cases import frame, rows

from tidings.llm import pseudo_likelihood, queries, sentencepiece_lattice, token_counts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def piece_path():
    return queries.tokenizer_path(queries.PIECE_MODEL)


@pytest.fixture(scope="module")
def library(piece_path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path)


def expected(library, docs):
    return sorted((str(r[0]), library.encode(r[1]) if r[1] else []) for r in docs)


def test_encoding_equals_the_library(spark, piece_path, library):
    for max_units in (sentencepiece_lattice.MAX_UNITS, 20):
        got = sentencepiece_lattice.encode(frame(spark), piece_path, max_units).collect()
        assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == expected(library, rows())
        assert all(r["n_tokens"] == len(r["ids"]) and r["round_trip"] is not False for r in got)
    assert sentencepiece_lattice.encode(frame(spark, []), piece_path).count() == 0


def test_whole_table_equals_the_library(spark, piece_path, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = queries.op3_sentencepiece(spark, SMALL).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == expected(library, [(r["doc_id"], r["text"]) for r in docs])


def test_relational_fold_equals_the_loop(spark, piece_path, library):
    pieces = sentencepiece_lattice.load(piece_path)
    rng = random.Random(6)
    units = {"▁" * rng.randint(0, 5) + "".join(rng.choice("aabcdeinrst é☃日\x01") for _ in range(rng.randint(1, 40))).replace(" ", "") for _ in range(300)}
    units |= {"\n", "▁", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁", "aaaaaaaaaaaaaaaaaaaaaaa"}
    units = sorted(u for u in units if u)
    got = {r["unit"]: list(r["ids"]) for r in sentencepiece_lattice.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), pieces).collect()}
    assert got == {u: sentencepiece_lattice.fold_unit(u, pieces) for u in units}
    assert all(sentencepiece_lattice._merged_long(u, pieces.ranks) == sentencepiece_lattice._merged(u, pieces.ranks) for u in units)


def test_decoding(spark, piece_path, library):
    coded = sentencepiece_lattice.encode(frame(spark), piece_path)
    got = sentencepiece_lattice.decode(coded, piece_path).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(r[0]), (r[1] or "").replace("▁", " ")) for r in rows())
    broken = spark.createDataFrame([(1, None), (2, [3 + 0xC3]), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in sentencepiece_lattice.decode(broken, piece_path).collect()} == {1: None, 2: "\ufffd", 3: ""}


def test_frequent_units_are_bounded(spark):
    counts = Counter(u for r in rows() for u in sentencepiece_lattice.units(r[1]) if len(u) <= sentencepiece_lattice.LONGEST)
    for limit in (1, 5, 50, 10 ** 6):
        got = {r["unit"] for r in sentencepiece_lattice.frequent_units(frame(spark), limit).collect()}
        assert len(got) <= limit
        assert all(counts[u] >= max([counts[v] for v in counts if v not in got], default=0) for u in got)


# ---- token counts ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.WORD_BPE)
    tokenizer = Tokenizer.from_file(path)
    return path, lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(spark, word_bpe):
    path, count = word_bpe
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(frame(spark), path).collect())
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), count(r[1]), count(r[1]) > 2048) for r in rows())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op10_token_counts(spark, SMALL).collect()}
    assert got == {r["doc_id"]: count(r["text"]) for r in docs}
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


def test_any_chunking_gives_the_same_count(word_bpe, monkeypatch):
    path, count = word_bpe
    counter, rng = token_counts.Counter(path), random.Random(7)
    texts = ["".join(rng.choice("abcdeeth'insr  \n.!?éÀ日1２<|\u0301Σσ\x1c\x85\u3000#") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["a<|endoftext|>b <|startoftext|><|end", "it's we'll THEY'D", "ΟΔΟΣ Σ", "İstanbul ﬁ ß ẞ ǅ ½", "x" * 3000, "👍🏽 👩‍👩‍👧"]
    for chunk in (1, 2, 5, 64):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        for t in texts:
            assert counter.count(t) == count(t), (chunk, t)


def test_caches_start_anew(word_bpe, monkeypatch):
    path, count = word_bpe
    monkeypatch.setattr(token_counts, "MAX_STATES", 20)
    monkeypatch.setattr(token_counts, "MAX_WORDS", 3)
    counter = token_counts.Counter(path)
    assert [counter.count(r[1]) for r in rows()] == [count(r[1]) for r in rows()]


def test_prefix_scan():
    count = lambda s: 10 ** 6 * len(s) if s else 0
    rng = random.Random(8)
    maps = [token_counts.StateMap("h" * rng.randint(0, 2), rng.choice([None, 1, 5]), "") for _ in range(37)]
    maps = [m if m.emitted is None else m._replace(tail="t" * rng.randint(0, 2)) for m in maps]
    one_by_one = [maps[0]]
    for m in maps[1:]:
        one_by_one.append(token_counts.compose(one_by_one[-1], m, count))
    assert token_counts.scan(maps, count) == one_by_one


def test_chunks_without_white_space(word_bpe, monkeypatch):
    path, count = word_bpe
    rng = random.Random(10)
    monkeypatch.setattr(token_counts, "EDGE", 0)
    monkeypatch.setattr(token_counts, "BYTES", 2)
    monkeypatch.setattr(token_counts, "MAX_STATES", 30)
    texts = ["".join(rng.choice("abst'lre!/+12éÀ日1２<|\u0301Σ\x1c ") for _ in range(rng.randint(0, 70))) for _ in range(200)]
    texts += ["日本語のテキスト" * 30, "'s's're!'s'" * 20, "ab1+/" * 40, "thequickbrownfox" * 30]
    counter = token_counts.Counter(path)
    for chunk in (1, 3, 16, 64):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        for t in texts:
            counter.clear()
            assert counter.count(t) == count(t), (chunk, t)


def test_long_text_without_white_space(word_bpe):
    import tracemalloc

    path, count = word_bpe
    counter = token_counts.Counter(path)
    for period in ("ab1+/Xyz9Q==", "日本語のテキスト、"):  # each ends where a pre-token does
        once, times = count(period), 20_000_000 // len(period)
        assert count(period * 3) == 3 * once
        assert counter.count(period * times) == times * once
        text = period * (4_000_000 // len(period))
        tracemalloc.start()
        counter.count(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 * 4_000_000 * (4 if "日" in period else 1)  # all prefixes: 16 KB x 122^2 = 240 MB


# ---- LM scoring -------------------------------------------------------------------------

def bytes_of(docs):
    return [None if r[1] is None else r[1].encode() for r in docs]


def by_hand(texts):
    """(word counts, words with a symbol, tokens and words of each bucket)."""
    n = Counter(w for t in texts for w in pseudo_likelihood.words(t))
    own = {w for w in n if n[w] ** 2 >= sum(n.values())}
    tokens, distinct = Counter(), Counter()
    for w in n.keys() - own:
        tokens[pseudo_likelihood.bucket(w)] += n[w]
        distinct[pseudo_likelihood.bucket(w)] += 1
    return n, own, tokens, distinct


def inside(word, hand):
    n, own, tokens, distinct = hand
    b = pseudo_likelihood.bucket(word)
    return 0.0 if word in own else np.log((n[word] + 0.5) / (tokens[b] + (distinct[b] + 1) / 2))


def test_vocabulary_equals_brute_force(spark):
    hand = n, own, tokens, distinct = by_hand(bytes_of(rows()))
    counts = pseudo_likelihood.word_counts(frame(spark)).cache()
    assert {bytes(r["word"]): r["n"] for r in counts.collect()} == n
    assert all(r["b"] == pseudo_likelihood.bucket(bytes(r["word"])) for r in counts.select("word", pseudo_likelihood.bucket_column(counts.word).alias("b")).collect())
    for direct in (1, 30, 10 ** 6):
        v = pseudo_likelihood.vocabulary(counts, direct)
        ranked = sorted(n, key=lambda w: (-n[w], w))
        assert v.direct == ranked[:max(direct, len(own))] and len(v.totals) == len(own) + pseudo_likelihood.BUCKETS
        assert list(v.totals) == sorted([n[w] for w in own] + [tokens[b] for b in range(pseudo_likelihood.BUCKETS)], reverse=True)
        for i, w in enumerate(v.direct):
            assert v.inside[i] == pytest.approx(inside(w, hand))
            assert v.totals[v.symbol[i]] == (n[w] if w in own else tokens[pseudo_likelihood.bucket(w)])
            assert w in own or v.symbol[i] == v.symbol[len(v.direct) + pseudo_likelihood.bucket(w)]
        assert len(set(v.symbol[:len(own)])) == len(own)
    for b in tokens:  # all words of a bucket and the unknown one
        assert sum(np.exp(inside(w, hand)) for w in n.keys() - own if pseudo_likelihood.bucket(w) == b) + 0.5 / (tokens[b] + (distinct[b] + 1) / 2) == pytest.approx(1)


def naive_windows(ids, edge):
    line = [edge, edge, *ids, edge, edge]
    return [([line[i - 2], line[i - 1], line[i + 1], line[i + 2]], line[i]) for i in range(2, len(line) - 2)]


def naive_log_prob(net, near, centre):
    """By the definition, in doubles."""
    h = np.tanh(sum(net.sides[i, x].astype(float) for i, x in enumerate(near)) + net.a)
    k, at = divmod(centre, net.size)
    top, low = h @ net.top + net.top_bias, h @ net.low[k] + net.low_bias[k]
    return top[k] - np.log(np.exp(top).sum()) + low[at] - np.log(np.exp(low).sum())


def test_windows_equal_brute_force():
    rng = random.Random(11)
    texts = [[rng.randrange(9) for _ in range(rng.choice([0, 1, 2, 3, 50]))] for _ in range(30)]
    near, centre = pseudo_likelihood.windows([np.array(t, np.int32) for t in texts], 9)
    assert list(zip(near.T.tolist(), centre.tolist())) == [w for t in texts for w in naive_windows(t, 9)]
    assert pseudo_likelihood.windows([], 9)[0].shape == (4, 0)


def test_network_probabilities_and_gradient(monkeypatch):
    rng = np.random.default_rng(1)
    net = pseudo_likelihood.Network(11, 3)
    net.weights[:] = rng.normal(0, 0.5, len(net.weights))
    net.start(rng.integers(0, 50, 11))
    net.top += rng.normal(0, 0.5, net.top.shape)
    near, centre = rng.integers(0, 12, (4, 40)), rng.integers(0, 11, 40)
    monkeypatch.setattr(pseudo_likelihood, "BLOCK", 7)
    assert net.log_probs(near, centre) == pytest.approx([naive_log_prob(net, near[:, i], centre[i]) for i in range(40)], abs=1e-4)
    total = sum(np.exp(net.log_probs(near[:, :1], np.array([c]))[0]) for c in range(11))
    assert total == pytest.approx(1, abs=1e-5)  # places without a symbol have nothing
    grad = pseudo_likelihood.Network(11, 3, np.zeros_like(net.weights))
    order = net.by_class(centre)
    near, centre = near[:, order], centre[order]
    net.step(near, centre, grad)
    for i in range(0, len(net.weights), 5):
        if net.weights[i] < -1e6:
            continue
        was, losses = net.weights[i], []
        for move in (0.01, -0.01):
            net.weights[i] = was + move
            losses.append(-sum(naive_log_prob(net, near[:, j], centre[j]) for j in range(40)))
        net.weights[i] = was
        assert (losses[0] - losses[1]) / 0.02 == pytest.approx(grad.weights[i], abs=2e-2)


def test_scores_are_summed_conditionals_and_training_helps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model, texts = pseudo_likelihood.fit(docs, 8, 300, 6)
    parts = pseudo_likelihood.PARTS
    assert sum(model.losses[-parts:]) < sum(model.losses[:parts]) - 0.1 * parts
    all_rows = docs.select("doc_id", "text").collect()
    hand = by_hand(bytes_of(all_rows))
    v, number = model.vocab, pseudo_likelihood.Numbers(model.vocab.direct)
    net = pseudo_likelihood.Network(len(v.totals), 8, model.weights)
    got = {r["doc_id"]: r for r in pseudo_likelihood.score(texts, model).collect()}
    assert len(got) == len(all_rows)
    for r in all_rows[:25]:
        w = pseudo_likelihood.words(r["text"].encode())
        ids = [int(v.symbol[number[x]]) for x in w]
        expect = sum(naive_log_prob(net, *x) for x in naive_windows(ids, len(v.totals))) + sum(inside(x, hand) for x in w)
        assert got[r["doc_id"]]["n_tokens"] == len(w) and got[r["doc_id"]]["pll"] == pytest.approx(expect, rel=1e-4)


def test_any_word_changes_the_score(spark):
    """Words of one bucket are told apart by their corpus counts, and a model scores
    texts it was not fitted on, unknown words included."""
    rng = random.Random(12)
    base = [" ".join(rng.choice(["the", "sea", "is", "wide", "and", "cold"]) for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(base), (100, "zzqaing"), (101, "zzqbing"), (102, "zzqbing")], "doc_id long, text string")
    for direct in (1, 1000):
        model, _ = pseudo_likelihood.fit(docs, 4, direct, 2)
        new = spark.createDataFrame([(1, "the zzqaing sea"), (2, "the zzqbing sea"), (3, "the zzqcing sea")], "doc_id long, text string")
        s = {r["doc_id"]: r["pll"] for r in pseudo_likelihood.score(pseudo_likelihood.coded(new, model.vocab), model).collect()}
        assert s[2] - s[1] == pytest.approx(np.log(2.5 / 1.5), abs=1e-5) and s[1] - s[3] == pytest.approx(np.log(1.5 / 0.5), abs=1e-5)


def test_lm_edges(spark):
    empty, texts = pseudo_likelihood.fit(frame(spark, []), 2)
    assert empty.losses == [] and pseudo_likelihood.score(texts, empty).count() == 0
    got = pseudo_likelihood.score(pseudo_likelihood.coded(frame(spark), empty.vocab), empty).collect()
    assert len(got) == len(rows())
    model, texts = pseudo_likelihood.fit(frame(spark), 2, 50, 2)
    got += pseudo_likelihood.score(texts, model).collect()
    assert len(got) == 2 * len(rows())
    for r in got:
        assert (r["mean_pll"] is None) == (r["n_tokens"] == 0) and np.isfinite(r["pll"])
        assert r["n_tokens"] or r["pll"] == 0
    assert sorted(r["n_tokens"] for r in got[len(rows()):]) == sorted(len(pseudo_likelihood.words(t)) for t in bytes_of(rows()))
    repeats = [r["pll"] for r in got[len(rows()):] if r["doc_id"] == 4]
    assert len(repeats) == 3 and repeats[0] == pytest.approx(repeats[1]) == pytest.approx(repeats[2])
