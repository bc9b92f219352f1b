"""Mergeable rollups and declared-but-unfilled statistics (A-12, A-13, D-1 .. D-9).

Rollup state is exact and algebraic: (count, decimal sum, label counts).
Two states of the same key merge by addition, so a stored table plus a
new batch's partials give the same rows as one pass over everything, and
a hot key (one global row per day) is pre-aggregated on every task
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import core as C
from .topn import top_n_per_group

STATE_COLS = ("news_count", "score_sum", "positive_count", "neutral_count", "negative_count")


def partial_state(df: DataFrame, keys: list[Column | str], score="sentiment_score", label="sentiment_label") -> DataFrame:
    """Rows -> mergeable state per key (exact decimal sum of scores)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("news_count"),
        F.sum(score).alias("score_sum"),
        C.count_label(label, "positive").alias("positive_count"),
        C.count_label(label, "neutral").alias("neutral_count"),
        C.count_label(label, "negative").alias("negative_count"),
    )


def signed_state(df: DataFrame, keys: list[Column | str], sign: str, score="sentiment_score", label="sentiment_label") -> DataFrame:
    """As ``partial_state``, each row weighted by ``sign`` (1 adds, -1 takes
    back); keys whose rows cancel out are left out."""
    n = F.col(sign)
    st = df.groupBy(*keys).agg(
        F.sum(n).cast("bigint").alias("news_count"), F.sum(F.col(score) * n.cast("decimal(1,0)")).alias("score_sum"),
        *[F.sum(F.when(F.col(label) == x, n).otherwise(0)).cast("bigint").alias(f"{x}_count") for x in S.LABELS])
    return st.filter(F.greatest(*[F.abs(F.coalesce(F.col(c), F.lit(0))) for c in STATE_COLS]) > 0)


def merge_state(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Stored state + batch state -> merged state (null-safe on keys: a NULL
    key is one group, unlike a NULL in a SQL unique key)."""
    u = stored.select(*keys, *STATE_COLS).unionByName(batch.select(*keys, *STATE_COLS))
    return u.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in STATE_COLS])


def finish_state(state: DataFrame) -> DataFrame:
    """Derive the mean on output (never stored rounded)."""
    return state.withColumns({
        "avg_sentiment": F.col("score_sum").cast("double") / F.nullif(F.col("news_count"), F.lit(0)),
        "score_sum": F.col("score_sum").cast("double"),
    })


# ---- A-12 / U-3 --------------------------------------------------------------------------
def daily_running_stats(stored_state: DataFrame, batch: DataFrame, ts_col: str = "analyzed_at") -> DataFrame:
    """One global row per UTC day; late rows are added to their own day."""
    b = partial_state(batch, [C.day(ts_col).alias("stat_date")])
    return finish_state(merge_state(stored_state, b, ["stat_date"]))


# ---- A-13 ---------------------------------------------------------------------------------
def ratio_columns(stats: DataFrame, old_pos: str | None = None, old_neg: str | None = None) -> DataFrame:
    """Positive / negative fraction as DECIMAL(5,4) when news_count > 0; else
    the old values stay (NULL when there are none)."""
    n = F.col("news_count")
    op = F.col(old_pos) if old_pos else F.lit(None).cast("decimal(5,4)")
    on = F.col(old_neg) if old_neg else F.lit(None).cast("decimal(5,4)")
    return stats.withColumns({
        "positive_ratio": F.when(n > 0, C.round_div(F.col("positive_count"), n, 4).cast("decimal(5,4)")).otherwise(op),
        "negative_ratio": F.when(n > 0, C.round_div(F.col("negative_count"), n, 4).cast("decimal(5,4)")).otherwise(on),
    })


# ---- D-1 / D-2 / D-6 / D-7 sector stats ---------------------------------------------------
def scored_sector_rows(t) -> DataFrame:
    """Scored news with its sectors and publication time (narrow columns only)."""
    sr = t.sentiment_results.select("news_id", "sentiment_score", "sentiment_label", "confidence", "market_impact_score")
    news = t.raw_news.select(F.col("id").alias("news_id"), "published_at")
    return t.news_sectors.select("news_id", "sector_id").join(news.join(sr, "news_id"), "news_id")


def sector_period_stats(rows: DataFrame, bucket: Column, bucket_name: str, high_impact: int = S.HIGH_IMPACT_MIN) -> DataFrame:
    g = rows.groupBy("sector_id", bucket.alias(bucket_name)).agg(
        F.count(F.lit(1)).alias("news_count"),
        C.exact_mean("sentiment_score").alias("avg_sentiment"),
        F.round(F.stddev_samp("sentiment_score"), 4).alias("sentiment_std"),
        C.count_label("sentiment_label", "positive").alias("positive_count"),
        C.count_label("sentiment_label", "neutral").alias("neutral_count"),
        C.count_label("sentiment_label", "negative").alias("negative_count"),
        C.exact_mean("confidence").alias("avg_confidence"),
        F.count(F.when(F.col("market_impact_score") >= high_impact, 1)).alias("high_impact_count"),
    )
    return ratio_columns(g)


def hourly_sector_stats(t) -> DataFrame:
    return sector_period_stats(scored_sector_rows(t), C.hour("published_at").cast("timestamp_ntz"), "stat_time")


def daily_sector_stats(t) -> DataFrame:
    return sector_period_stats(scored_sector_rows(t), C.day("published_at"), "stat_date")


def sentiment_std(events: DataFrame) -> DataFrame:
    return events.groupBy(C.day("analyzed_at").alias("stat_date")).agg(
        F.round(F.stddev_samp("sentiment_score"), 4).alias("sentiment_std"))


def high_impact_count(events: DataFrame, threshold: int = S.HIGH_IMPACT_MIN) -> DataFrame:
    return events.groupBy(C.day("analyzed_at").alias("stat_date")).agg(
        F.count(F.when(F.col("market_impact_score") >= threshold, 1)).alias("high_impact_count"),
        F.count(F.lit(1)).alias("news_count"))


# ---- D-3 / D-4 top-k words per group -------------------------------------------------------
# Sectors of that many news are broadcast to the texts (about 100 bytes each).
SMALL_SETS = 500_000
TERM_KEYS = ("sector_id", "stat_date", "term")


def sector_sets(rows: DataFrame, ts_col: str = "published_at") -> DataFrame:
    """One narrow row per news: its day and the sorted list of its sectors."""
    return rows.groupBy("news_id", C.day(ts_col).alias("stat_date")).agg(F.sort_array(F.collect_list("sector_id")).alias("sectors"))


def term_counts(sets: DataFrame, terms: DataFrame, small: int = SMALL_SETS) -> DataFrame:
    """Count per (sector_id, stat_date, term) over the ``terms`` (an array per
    ``news_id``) of the news in ``sets``; NULL and empty terms are ignored.

    A term is counted once per day and *set* of sectors, then for each sector of
    the set.  Few sets (measured) are broadcast to the terms, so no text is
    shuffled; otherwise terms are first counted per news and these narrow counts
    are joined.  The counts are mergeable: ``merge_terms`` adds stored and new ones."""
    ok = F.col("term").isNotNull() & (F.col("term") != "")
    if sets.limit(small + 1).count() <= small:
        x = terms.join(F.broadcast(sets), "news_id").select("stat_date", "sectors", F.explode("terms").alias("term"))
        per_set = x.filter(ok).groupBy("stat_date", "sectors", "term").agg(F.count(F.lit(1)).alias("n"))
    else:
        per_news = terms.select("news_id", F.explode("terms").alias("term")).filter(ok).groupBy("news_id", "term").agg(F.count(F.lit(1)).alias("n"))
        per_set = per_news.join(sets, "news_id").groupBy("stat_date", "sectors", "term").agg(F.sum("n").alias("n"))
    x = per_set.select(F.explode("sectors").alias("sector_id"), "stat_date", "term", "n")
    return x.groupBy(*TERM_KEYS).agg(F.sum("n").alias("n"))


def merge_terms(*states: DataFrame) -> DataFrame:
    """Term counts of several epochs added up."""
    u = states[0]
    for s in states[1:]:
        u = u.unionByName(s.select(*u.columns))
    return u.groupBy(*TERM_KEYS).agg(F.sum("n").alias("n"))


def top_terms(counts: DataFrame, k: int = 5, salt_buckets: int = 16, out_col: str = "top_keywords",
              group: tuple[str, ...] = ("sector_id", "stat_date")) -> DataFrame:
    """k most frequent terms per group of exact ``counts``, ties by term.

    Ranked first within (group, hash(term) % salt_buckets), so a hot group is
    split over ``salt_buckets`` tasks, then among the <= k * salt_buckets
    survivors: the top k of a group is inside the union of its buckets' top k."""
    top = top_n_per_group(counts, list(group), [F.col("n").desc(), F.col("term").asc()], k, salt_key=F.col("term"), buckets=salt_buckets)
    agg = top.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_rank", "term"))).alias("_l"))
    return agg.select(*group, F.transform("_l", lambda x: x["term"]).alias(out_col))


def keyword_terms(news: DataFrame) -> DataFrame:
    """All tokens of every news."""
    return news.select(F.col("id").alias("news_id"), C.tokens("content").alias("terms"))


def entity_terms(news: DataFrame) -> DataFrame:
    """Entity names of every news: its capitalised tokens."""
    return news.select(F.col("id").alias("news_id"), F.filter(C.tokens("content"), lambda x: x.rlike("^[A-Z]")).alias("terms"))


def top_keywords(t, k: int = 5) -> DataFrame:
    return top_terms(term_counts(sector_sets(scored_sector_rows(t)), keyword_terms(t.raw_news)), k)


def top_entities(t, k: int = 5) -> DataFrame:
    return top_terms(term_counts(sector_sets(scored_sector_rows(t)), entity_terms(t.raw_news)), k, out_col="top_entities")


# ---- D-5 trend ---------------------------------------------------------------------------------
def sentiment_trend(daily: DataFrame, key: str = "sector_id", day_col: str = "stat_date",
                    step: float = 0.1, volatile_std: float = 0.3) -> DataFrame:
    """rising / falling / stable / volatile and a strength in [0, 1] from daily means.

    Window per ``key`` ordered by day: rows per window partition = days."""
    w = Window.partitionBy(key).orderBy(day_col)
    diff = F.col("avg_sentiment") - F.lag("avg_sentiment").over(w)
    std7 = F.stddev_samp("avg_sentiment").over(w.rowsBetween(-6, 0))
    x = daily.select(key, day_col, "avg_sentiment", diff.alias("diff"), std7.alias("std7"))
    trend = (F.when(F.col("std7") > volatile_std, "volatile").when(F.col("diff") > step, "rising")
             .when(F.col("diff") < -step, "falling").otherwise("stable"))
    return x.select(key, day_col, F.round("avg_sentiment", 6).alias("avg_sentiment"), trend.alias("sentiment_trend"),
                    F.round(F.least(F.lit(1.0), F.coalesce(F.abs("diff"), F.lit(0.0))), 6).alias("trend_strength"),
                    F.round("std7", 6).alias("std7"))


# ---- D-8 hourly per-source summary (mergeable) -----------------------------------------------
def hourly_source_summary(events: DataFrame) -> DataFrame:
    st = partial_state(events, [C.hour("analyzed_at").cast("timestamp_ntz").alias("hour"), "source_name"])
    return finish_state(st)


# ---- D-9 correlation with an index series -----------------------------------------------------
def market_correlation(daily: DataFrame, index: DataFrame) -> DataFrame:
    """Pearson correlation of the daily mean and an index value on the same day."""
    j = daily.select("stat_date", "avg_sentiment").join(index.select("stat_date", "index_value"), "stat_date")
    return j.agg(F.count(F.lit(1)).alias("n_days"), F.round(F.corr("avg_sentiment", "index_value"), 6).alias("correlation"))


def order_index(orders: DataFrame, shift_days: int) -> DataFrame:
    """Daily order value as an index series, shifted onto the news calendar."""
    d = F.date_add(F.to_date("o_orderdate"), shift_days)
    return orders.groupBy(d.alias("stat_date")).agg(F.sum("o_totalprice").alias("index_value"))
