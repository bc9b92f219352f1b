from collections import Counter

from pyspark.sql import functions as F

from tidings.functions import core as C
from tidings.operators import rollups as R
from tidings.sources.fixtures import ts


def test_merge_of_two_halves_equals_one_pass(tables):
    e = tables.scored_events
    cut = F.col("analyzed_at") < ts("2024-01-10 12:00:00")
    stored = R.partial_state(e.filter(cut), [C.day("analyzed_at").alias("stat_date")])
    merged = {r.stat_date: r for r in R.daily_running_stats(stored, e.filter(~cut)).collect()}
    one = {r.stat_date: r for r in R.finish_state(R.partial_state(e, [C.day("analyzed_at").alias("stat_date")])).collect()}
    assert merged == one


def test_rerunning_a_merge_is_stable(tables):
    e = tables.scored_events
    st = R.partial_state(e, [C.day("analyzed_at").alias("stat_date")])
    empty = e.limit(0)
    again = R.daily_running_stats(st, empty).drop("avg_sentiment")
    assert sorted(map(tuple, again.select(*R.STATE_COLS).collect())) == sorted(
        map(tuple, R.finish_state(st).select(*R.STATE_COLS).collect()))


def test_top_terms_exact_with_hot_group(spark):
    words = ["w%02d" % (i % 37) for i in range(5000)] + ["z"] * 100
    rows = [("hot", w) for w in words] + [("cold", "a"), ("cold", "b"), ("cold", "b")]
    df = spark.createDataFrame(rows, "g string, word string")
    counts = df.groupBy("g", F.col("word").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    got = {r.g: r.top_keywords for r in R.top_terms(counts, 5, salt_buckets=8, group=("g",)).collect()}
    for g in ("hot", "cold"):
        c = Counter(w for gg, w in rows if gg == g)
        expect = [w for w, _ in sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:5]]
        assert got[g] == expect


def test_ratio_columns_keep_old_values_when_empty(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.25, 0.5), (8, 1, 3, None, None)],
                               "news_count long, positive_count long, negative_count long, op double, on double")
    df = df.select("*", F.col("op").cast("decimal(5,4)").alias("old_p"), F.col("on").cast("decimal(5,4)").alias("old_n"))
    got = [(float(r.positive_ratio), float(r.negative_ratio)) for r in R.ratio_columns(df, "old_p", "old_n").collect()]
    assert got == [(0.25, 0.5), (0.125, 0.375)]


def test_term_counts_merge_like_one_pass(spark, tables):
    """Epochs of news counted apart and added up, with the sets broadcast and joined."""
    sets = R.sector_sets(R.scored_sector_rows(tables))
    terms = R.keyword_terms(tables.raw_news)
    rows = lambda df: sorted(map(str, df.select(*R.TERM_KEYS, "n").collect()))
    one = R.term_counts(sets, terms)
    brute = Counter()
    text = {r.news_id: r.terms for r in terms.collect()}
    for r in R.scored_sector_rows(tables).select("news_id", "sector_id", C.day("published_at").alias("d")).collect():
        brute.update((r.sector_id, r.d, w) for w in text[r.news_id] or [] if w)
    assert Counter({(r.sector_id, r.stat_date, r.term): r.n for r in one.collect()}) == brute
    assert rows(R.term_counts(sets, terms, small=0)) == rows(one)
    epochs = [R.term_counts(sets, terms.filter(F.col("news_id") % 3 == i)) for i in range(3)]
    assert rows(R.merge_terms(*epochs)) == rows(one)
    lines = one._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if " Exchange " in line]
    assert not any("text#" in x or "content#" in x or "terms#" in x for x in below)
