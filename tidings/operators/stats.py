"""Statistics, trends and panels (A-1 .. A-11, A-14, A-15, W-2).

All aggregates are algebraic (count / sum / min / max), so Spark runs a
partial aggregate before the shuffle: a hot day or sector costs one row
per task in the exchange, not its row count.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import core as C
from . import news as N


def _scored(news: DataFrame, sentiment: DataFrame) -> DataFrame:
    """news (id, published_at) LEFT JOIN sentiment (score, label): the shape of
    every statistic.  Only the narrow columns travel through the join."""
    return N.join_left_sentiment(news.select("id", "published_at"), sentiment,
                                 cols=("sentiment_score", "sentiment_label"))


def _label_counts():
    return [
        C.count_label("sentiment_label", "positive").alias("positive_count"),
        C.count_label("sentiment_label", "neutral").alias("neutral_count"),
        C.count_label("sentiment_label", "negative").alias("negative_count"),
    ]


# ---- A-1 / A-2 / A-3 -----------------------------------------------------------------------
def sentiment_stats(t, period: str | None = "24h", sector: str | None = None, as_of=S.FIXTURE_AS_OF) -> DataFrame:
    news = N.filter_period(t.raw_news.select("id", "published_at"), period, as_of)
    news = N.semi_join_sector(news, t.news_sectors, t.market_sectors, sector)
    j = _scored(news, t.sentiment_results)
    return j.agg(
        F.count(F.lit(1)).alias("news_count"),
        C.mean_or_zero("sentiment_score").alias("avg_sentiment"),
        *_label_counts(),
    ).select(F.lit(period if period in S.PERIODS_HOURS else period).alias("period"), "*")


def with_ratios(stats: DataFrame) -> DataFrame:
    """Positive / negative percent with 2 digits; 0 when there are no rows."""
    n = F.col("news_count")
    return stats.select(
        "*",
        F.coalesce(C.round_div(F.col("positive_count") * 100, n, 2), F.lit(0.0)).alias("positive_ratio"),
        F.coalesce(C.round_div(F.col("negative_count") * 100, n, 2), F.lit(0.0)).alias("negative_ratio"),
    )


def sentiment_stats_ratio(t, period="24h", sector=None, as_of=S.FIXTURE_AS_OF) -> DataFrame:
    return with_ratios(sentiment_stats(t, period, sector, as_of))


def stats_24h(t, as_of=S.FIXTURE_AS_OF) -> DataFrame:
    return sentiment_stats(t, "24h", None, as_of)


# ---- minimal store adapter ------------------------------------------------------------------
def minimal_news(t, source: bool = True, scores: bool = True, sector: bool = True) -> DataFrame:
    """The single-table store of the minimal variant: score defaults to 0,
    label to '' and ``analyzed`` is 1 once a result exists.  The store is a
    view over joins: a query that needs no source, score or sector leaves
    that join (and its columns) out."""
    j = t.raw_news.select("id", "title", "url", "published_at", "source_id", F.col("published_at").alias("created_at"))
    if source:
        j = j.join(t.news_sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id", "left")
    if scores:
        sr = t.sentiment_results.select(F.col("news_id").alias("id"), F.col("sentiment_score").alias("_s"), F.col("sentiment_label").alias("_l"))
        j = j.join(sr, "id", "left").withColumns({
            "sentiment_score": F.coalesce("_s", F.lit(0).cast("decimal(5,4)")), "sentiment_label": F.coalesce("_l", F.lit("")),
            "analyzed": F.col("_l").isNotNull()}).drop("_s", "_l")
    if sector:
        prim = t.news_sectors.filter("is_primary").select(F.col("news_id").alias("id"), "sector_id")
        sec = t.market_sectors.select(F.col("id").alias("sector_id"), F.col("name").alias("sector"))
        j = j.join(prim.join(sec, "sector_id").drop("sector_id"), "id", "left")
    return j.drop("source_id")


def _minimal_agg(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(C.round_mean("sentiment_score", 2), F.lit(0.0)).alias("avg_sentiment"),
        C.sum_label("sentiment_label", "positive").alias("positive"),
        C.sum_label("sentiment_label", "negative").alias("negative"),
        C.sum_label("sentiment_label", "neutral").alias("neutral"),
    )


# ---- A-4 / A-5 -----------------------------------------------------------------------------
def minimal_report_stats(store: DataFrame, days: int = 7, as_of=S.FIXTURE_AS_OF) -> DataFrame:
    """Total, mean with unscored rows counted as 0 (rounded to 2), label sums."""
    return _minimal_agg(N.filter_last_n_days(store, days, as_of, col="created_at"))


def dashboard_stats(store: DataFrame, source: str | None = None) -> DataFrame:
    return _minimal_agg(N.filter_source(store, source))


# ---- A-6 ---------------------------------------------------------------------------------
def sector_trend_label(avg):
    return F.when(avg > S.POSITIVE_THRESHOLD, "positive").when(avg < S.NEGATIVE_THRESHOLD, "negative").otherwise("stable")


def join_sector_chain(t, period="24h", as_of=S.FIXTURE_AS_OF) -> DataFrame:
    """sectors LEFT JOIN bridge LEFT JOIN (news in period) LEFT JOIN sentiment.

    The time predicate belongs to the ON clause: the news side is filtered
    *before* the outer join so sectors without news stay in the result.

    The linked rows are inner-joined to the sectors and the sectors without a
    link are added: AQE can split a hot sector's rows of an inner join, which
    it cannot do on the null-supplying side of an outer one."""
    news = N.filter_period(t.raw_news.select("id", "published_at"), period, as_of)
    scored = _scored(news, t.sentiment_results).select(F.col("id").alias("news_id"), F.col("id").alias("rn_id"), "sentiment_score")
    bridge = t.news_sectors.select("news_id", "sector_id")
    sectors = t.market_sectors.select(F.col("id").alias("sector_id"), F.col("name").alias("sector_name"))
    linked = bridge.join(scored, "news_id", "left")
    alone = sectors.join(bridge.select("sector_id").distinct(), "sector_id", "left_anti")
    return linked.join(sectors, "sector_id").select("sector_id", "sector_name", "news_id", "rn_id", "sentiment_score").unionByName(
        alone, allowMissingColumns=True)


def _mean_of(sum_col: str, count_col: str):
    """exact_mean from carried (exact sum, count) columns."""
    return F.col(sum_col).cast("double") / F.nullif(F.col(count_col), F.lit(0))


def sector_stats(t, period="24h", as_of=S.FIXTURE_AS_OF) -> DataFrame:
    """Per sector (all sectors, also those without news): news in the period,
    mean score (0 if none) and trend label; order by count desc.

    Equal to aggregating ``join_sector_chain`` per sector, but the bridge x
    news rows are aggregated per sector first (partial aggregation, so a
    hot sector costs one row per task) and only then outer-joined to the
    sector dimension: the big side is never shuffled by sector, where one
    sector could hold a third of the rows."""
    news = N.filter_period(t.raw_news.select("id", "published_at"), period, as_of)
    scored = _scored(news, t.sentiment_results).select(F.col("id").alias("news_id"), "sentiment_score")
    per = t.news_sectors.select("news_id", "sector_id").join(scored, "news_id").groupBy("sector_id").agg(
        F.count(F.lit(1)).alias("news_count"), F.sum("sentiment_score").alias("_s"), F.count("sentiment_score").alias("_n"))
    sectors = t.market_sectors.select(F.col("id").alias("sector_id"), F.col("name").alias("sector_name"))
    g = sectors.join(per, "sector_id", "left").select(
        "sector_id", "sector_name", F.coalesce("news_count", F.lit(0)).alias("news_count"),
        F.coalesce(_mean_of("_s", "_n"), F.lit(0.0)).alias("avg_sentiment"))
    return g.withColumn("sentiment_trend", sector_trend_label(F.col("avg_sentiment"))).orderBy(
        F.col("news_count").desc(), "sector_id")


# ---- A-7 ---------------------------------------------------------------------------------
def sector_summary(t) -> DataFrame:
    """Per active sector: distinct processed news, mean score, label counts,
    mean confidence, latest publish time (processed = has a result).

    Aggregated per sector before the outer join with the sector dimension
    (see ``sector_stats``); the distinct count runs as Spark's two-phase
    distinct aggregation, partial on every task."""
    sectors = N.filter_active(t.market_sectors).select(F.col("id").alias("sector_id"), F.col("name").alias("sector_name"))
    sr = t.sentiment_results.select("news_id", "sentiment_score", "sentiment_label", "confidence")
    news = t.raw_news.select(F.col("id").alias("news_id"), "published_at").join(sr, "news_id", "inner")
    linked = t.news_sectors.select("news_id", "sector_id").join(news, "news_id", "inner")
    per = linked.groupBy("sector_id").agg(
        F.countDistinct("news_id").alias("news_count"),
        F.sum("sentiment_score").alias("_ss"), F.count("sentiment_score").alias("_sn"),
        *_label_counts(),
        F.sum("confidence").alias("_cs"), F.count("confidence").alias("_cn"),
        F.max("published_at").alias("latest_news_time"),
    )
    j = sectors.join(per, "sector_id", "left")
    zero = F.lit(0).cast("bigint")
    return j.select(
        "sector_id", "sector_name", F.coalesce("news_count", zero).alias("news_count"),
        _mean_of("_ss", "_sn").alias("avg_sentiment"),
        F.coalesce("positive_count", zero).alias("positive_count"),
        F.coalesce("neutral_count", zero).alias("neutral_count"),
        F.coalesce("negative_count", zero).alias("negative_count"),
        _mean_of("_cs", "_cn").alias("avg_confidence"),
        "latest_news_time",
    )


# ---- A-8 ---------------------------------------------------------------------------------
def daily_trend(t, days: int = 7, sector: str | None = None, as_of=S.FIXTURE_AS_OF) -> DataFrame:
    """Per UTC day of publication within ``[today - days, today]`` (days + 1
    calendar days; days without news are absent)."""
    if not 1 <= days <= S.TREND_DAYS_MAX:
        raise ValueError(f"days must be in 1..{S.TREND_DAYS_MAX}")
    today = N._as_dt(as_of).date()
    news = N.filter_date_between(t.raw_news.select("id", "published_at"), today - timedelta(days=days), today)
    news = N.semi_join_sector(news, t.news_sectors, t.market_sectors, sector)
    j = _scored(news, t.sentiment_results)
    return (
        j.groupBy(C.day("published_at").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            C.mean_or_zero("sentiment_score").alias("avg_sentiment"),
            C.count_label("sentiment_label", "positive").alias("positive"),
            C.count_label("sentiment_label", "neutral").alias("neutral"),
            C.count_label("sentiment_label", "negative").alias("negative"),
        )
        .orderBy("date")
    )


# ---- A-9 / A-10 / A-11 ------------------------------------------------------------------
def source_facets(store: DataFrame) -> DataFrame:
    return store.groupBy("source").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), "source")


def total_count(t, q: N.NewsQuery) -> DataFrame:
    """Total of all news and of the filtered search set, plus the page count.

    Two aggregates: the total of all reads no text, and the filtered total has
    the date range as a real filter, so the texts of other days are not read
    (the keyword is looked for in what is left)."""
    news = t.raw_news
    if q.start_date is not None:
        news = news.filter(F.col("published_at") >= N.ts_lit(q.start_date))
    if q.end_date is not None:
        news = news.filter(F.col("published_at") < N.ts_lit(q.end_date + timedelta(days=1)))
    news = N.filter_keyword(news, q.keyword).select("id", "source_id")
    news = N.semi_join_sector(news, t.news_sectors, t.market_sectors, q.sector)
    news = news.join(t.news_sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    if q.sentiment:
        news = news.join(t.sentiment_results.filter(F.col("sentiment_label") == q.sentiment).select(F.col("news_id").alias("id")), "id", "left_semi")
    everything = t.raw_news.agg(F.count(F.lit(1))).scalar()
    return news.agg(F.count(F.lit(1)).alias("total")).select(
        everything.alias("total_all"), "total",
        F.lit(q.page_size).alias("page_size"),
        C.idiv(F.col("total") + (q.page_size - 1), F.lit(q.page_size)).alias("pages"),
    )


def top_sectors(store: DataFrame, source: str | None = None, n: int = S.TOP_SECTORS) -> DataFrame:
    rows = N.filter_placeholder(N.filter_source(store, source))
    g = rows.groupBy("sector").agg(F.count(F.lit(1)).alias("cnt"), C.round_mean("sentiment_score", 2).alias("score"))
    return g.orderBy(F.col("cnt").desc(), "sector").limit(n)


# ---- A-14 ------------------------------------------------------------------------------
def ingest_counts(entries: DataFrame, stored: DataFrame, feed_col: str = "feed") -> DataFrame:
    """fetched and saved (= new, not stored before) per feed, with a grand total row."""
    from .ingest import mark_new

    marked = mark_new(entries, stored)
    return marked.rollup(feed_col).agg(
        F.count(F.lit(1)).alias("fetched"), F.count(F.when(F.col("is_new"), 1)).alias("saved"),
    )


# ---- W-2 ---------------------------------------------------------------------------------
def daily_report(t, report_date: date | None = None, as_of=S.FIXTURE_AS_OF) -> DataFrame:
    """Report for one UTC day (default: the day before ``as_of``): counts,
    mean, label and its text, and percent shares of each label."""
    day = report_date or (N._as_dt(as_of).date() - timedelta(days=1))
    news = N.filter_date_between(t.raw_news.select("id", "published_at"), day, day)
    j = _scored(news, t.sentiment_results)
    s = j.agg(
        F.count(F.lit(1)).alias("news_count"),
        C.mean_or_zero("sentiment_score").alias("avg_sentiment"),
        *_label_counts(),
    )
    n = F.col("news_count")
    return s.select(
        F.lit(day).alias("report_date"), "*",
        C.label(F.col("avg_sentiment")).alias("market_label"),
        C.label_text(F.col("avg_sentiment")).alias("market_text"),
        F.coalesce(C.round_div(F.col("positive_count") * 100, n, 1), F.lit(0.0)).alias("positive_pct"),
        F.coalesce(C.round_div(F.col("neutral_count") * 100, n, 1), F.lit(0.0)).alias("neutral_pct"),
        F.coalesce(C.round_div(F.col("negative_count") * 100, n, 1), F.lit(0.0)).alias("negative_pct"),
    )
