"""The q-gram word join against brute force, by each of its plans."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidings.operators import scoring as G
from tidings.operators import sectors as S
from tidings.operators import words as W


def _data():
    rng = random.Random(4)
    letters = "abé日x😀"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 400))) for _ in range(60)]
    texts += [None, "", "a", "aaaaaaa", "ab" * 200, "x" * 31 + "日本語" + "x" * 40, "a\nb\u2028é", "." * 70]
    words = {"".join(rng.choices(letters, k=rng.choice([1, 1, 2, 3, 4, 5, 8]))) for _ in range(300)}
    words |= {"aa", "aaa", "abab", "ab" * 40, "x" * 40, "日本語", "x日", "a\nb", ".", ".*", "no such word", "\u2028é"}
    words |= {t[i:i + 100] for t in texts if t and len(t) > 200 for i in (3, 40)}
    return [(i % 50, t) for i, t in enumerate(texts)], sorted(words)


@pytest.mark.parametrize("how", [{"few": 10 ** 6}, {"few": 0}, {"few": 0, "broadcast_bytes": 0}])
def test_every_word_is_found_and_counted(spark, how):
    rows, words = _data()
    texts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    table = spark.createDataFrame([(w, len(w)) for w in words] + [(None, 0), ("", 0)], "word string, size int")
    want = Counter()
    for doc_id, t in rows:
        want.update((doc_id, w, len(w), t.count(w)) for w in words if t and w in t)
    got = Counter(tuple(r) for r in W.find_words(texts, table, "text", counts=True, **how).select("id", "word", "size", "hits").collect())
    assert got == want
    pairs = Counter(tuple(r) for r in W.find_words(texts, table, "text", **how).select("id", "word").collect())
    assert pairs == Counter({(i, w): sum(n for k, n in want.items() if k[:2] == (i, w)) for i, w, *_ in want})
    every = W.find_words(texts, table, "text", every_row=True, counts=True, **how)
    assert Counter(tuple(r) for r in every.filter("word IS NOT NULL").select("id", "word", "size", "hits").collect()) == want
    assert every.select("_row").distinct().count() == len(rows) and every.filter("word IS NULL AND hits <> 0").count() == 0


def test_empty_word_table_and_empty_texts(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    none = spark.createDataFrame([], "word string")
    for few in (64, 0):
        assert W.find_words(texts, none, "text", few=few).collect() == []
        assert sorted(r["id"] for r in W.find_words(texts, none, "text", every_row=True, few=few).collect()) == [1, 2]
        assert W.find_words(texts.limit(0), texts.select(F.col("text").alias("word")), "text", every_row=True, few=few).collect() == []


def test_a_hundred_thousand_words(spark, tables):
    """Words cut from the texts at every place, and as many that no text has."""
    news = tables.raw_news.filter(F.col("content").isNotNull())
    rows = [(r["id"], r["title"], r["content"]) for r in news.select("id", "title", "content").collect()]
    rng = random.Random(9)
    inside = [t[i:i + n] for _ in range(20_000) for _, _, t in (rng.choice(rows),) for n in (rng.randint(2, 12),)
              for i in (rng.randrange(max(1, len(t) - n)),)]
    words = list(dict.fromkeys([w for w in inside if w] + [f"{rng.choice(inside)}{i:x}q" for i in range(90_000)]))
    assert len(words) > 100_000
    listed = [(i % 23, w) for i, w in enumerate(words)]
    table = spark.createDataFrame(listed, "sector_id int, word string")
    sizes = Counter(s for s, _ in listed)
    some = [r for r in rows if len(r[2]) < 600][:40]
    chosen = news.join(spark.createDataFrame([(r[0],) for r in some], "id long"), "id", "left_semi")
    got = {(r["news_id"], r["sector_id"]): r["relevance"] for r in S.sector_tagging(chosen, table).collect()}
    want = Counter((i, s) for i, _, t in some for s, w in listed if w in t)
    assert got == {k: n / sizes[k[1]] for k, n in want.items()}
    pairs = {tuple(r) for r in S.theta_join_keyword(chosen, table, "content").collect()}
    assert pairs == set(want)
    lexicon = spark.createDataFrame([("negative" if i % 3 else "positive", w) for i, w in enumerate(words)], "polarity string, word string")
    scored = {r["id"]: (r["pos_hits"], r["neg_hits"]) for r in G.lexicon_score(chosen, lexicon, text=F.col("content")).collect()}
    assert scored == {i: tuple(sum(t.count(w) for k, w in enumerate(words) if bool(k % 3) == neg and w in t) for neg in (False, True))
                      for i, _, t in some}
