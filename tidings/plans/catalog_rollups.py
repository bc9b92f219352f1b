"""Registered rollup queries (A-12, A-13, U-3, D-1 .. D-9) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import rollups as R
from ..sources.fixtures import Tables, ts
from .catalog_sectors import SCORED_ROWS, V, period_stats_sql
from .registry import register, sql_mean, sql_round_div

EV = ("scored_events",)

ONE_PASS_DAILY = """SELECT CAST(analyzed_at AS DATE) AS stat_date, COUNT(*) AS news_count,
       CAST(SUM(sentiment_score) AS DOUBLE) AS score_sum,
       COUNT(CASE WHEN sentiment_label = 'positive' THEN 1 END) AS positive_count,
       COUNT(CASE WHEN sentiment_label = 'neutral' THEN 1 END) AS neutral_count,
       COUNT(CASE WHEN sentiment_label = 'negative' THEN 1 END) AS negative_count,
       CAST(SUM(sentiment_score) AS DOUBLE) / COUNT(*) AS avg_sentiment
FROM scored_events GROUP BY 1"""


@register("daily_running_stats", ONE_PASS_DAILY, views=EV)
def q_daily_running_stats(spark, sf_dir):
    """Stored state (before the 15th) merged with the batch of later rows
    must equal one pass over everything."""
    e = Tables(spark, sf_dir).scored_events
    cut = F.col("analyzed_at") < ts("2024-01-15 00:00:00")
    stored = R.partial_state(e.filter(cut), [C.day("analyzed_at").alias("stat_date")])
    return R.daily_running_stats(stored, e.filter(~cut))


@register("upsert_accumulate", ONE_PASS_DAILY, views=EV)
def q_upsert_accumulate(spark, sf_dir):
    """Both sides hit the same days: conflicting keys add up."""
    e = Tables(spark, sf_dir).scored_events
    first = F.col("source_name").isin("view", "click")
    stored = R.partial_state(e.filter(first), [C.day("analyzed_at").alias("stat_date")])
    return R.daily_running_stats(stored, e.filter(~first))


@register(
    "ratio_columns",
    f"""SELECT stat_date, news_count, positive_count, negative_count,
       CASE WHEN news_count > 0 THEN CAST({sql_round_div('positive_count', 'news_count', 4)} AS DECIMAL(5,4)) END AS positive_ratio,
       CASE WHEN news_count > 0 THEN CAST({sql_round_div('negative_count', 'news_count', 4)} AS DECIMAL(5,4)) END AS negative_ratio
FROM ({ONE_PASS_DAILY}) d""",
    views=EV,
)
def q_ratio_columns(spark, sf_dir):
    e = Tables(spark, sf_dir).scored_events
    st = R.partial_state(e, [C.day("analyzed_at").alias("stat_date")])
    return R.ratio_columns(st).select("stat_date", "news_count", "positive_count", "negative_count", "positive_ratio", "negative_ratio")


@register("hourly_sector_stats", period_stats_sql("date_trunc('hour', published_at)", "stat_time"), views=V)
def q_hourly_sector_stats(spark, sf_dir):
    return R.hourly_sector_stats(Tables(spark, sf_dir))


@register("daily_sector_stats", period_stats_sql("CAST(published_at AS DATE)", "stat_date"), views=V)
def q_daily_sector_stats(spark, sf_dir):
    return R.daily_sector_stats(Tables(spark, sf_dir))


def _top_sql(term_expr: str, out: str, where: str = "") -> str:
    return f"""WITH r AS ({SCORED_ROWS}),
toks AS (SELECT r.sector_id, CAST(r.published_at AS DATE) AS stat_date, unnest({term_expr}) AS term
         FROM r JOIN raw_news rn ON rn.id = r.news_id),
c AS (SELECT sector_id, stat_date, term, COUNT(*) AS cnt FROM toks WHERE term IS NOT NULL AND term <> '' {where} GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY sector_id, stat_date ORDER BY cnt DESC, term) AS rk FROM c)
SELECT sector_id, stat_date, list(term ORDER BY rk) AS {out} FROM k WHERE rk <= 5 GROUP BY 1, 2"""


@register("top_keywords", _top_sql("string_split(rn.content, ' ')", "top_keywords"), views=V)
def q_top_keywords(spark, sf_dir):
    return R.top_keywords(Tables(spark, sf_dir), 5)


@register(
    "top_entities",
    _top_sql("list_filter(string_split(rn.content, ' '), lambda x: regexp_matches(x, '^[A-Z]'))", "top_entities"),
    views=V,
)
def q_top_entities(spark, sf_dir):
    return R.top_entities(Tables(spark, sf_dir), 5)


@register(
    "sentiment_trend",
    f"""WITH d AS (SELECT sector_id, CAST(published_at AS DATE) AS stat_date, {sql_mean('sentiment_score')} AS avg_sentiment
           FROM ({SCORED_ROWS}) r WHERE published_at IS NOT NULL GROUP BY 1, 2),
x AS (SELECT sector_id, stat_date, avg_sentiment,
             avg_sentiment - lag(avg_sentiment) OVER (PARTITION BY sector_id ORDER BY stat_date) AS diff,
             stddev_samp(avg_sentiment) OVER (PARTITION BY sector_id ORDER BY stat_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS std7
      FROM d)
SELECT sector_id, stat_date, round(avg_sentiment, 6) AS avg_sentiment,
       CASE WHEN std7 > 0.3 THEN 'volatile' WHEN diff > 0.1 THEN 'rising' WHEN diff < -0.1 THEN 'falling' ELSE 'stable' END AS sentiment_trend,
       round(least(1.0, coalesce(abs(diff), 0.0)), 6) AS trend_strength,
       round(std7, 6) AS std7
FROM x""",
    views=V,
)
def q_sentiment_trend(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = R.scored_sector_rows(t).filter(F.col("published_at").isNotNull())
    daily = rows.groupBy("sector_id", C.day("published_at").alias("stat_date")).agg(C.exact_mean("sentiment_score").alias("avg_sentiment"))
    return R.sentiment_trend(daily)


@register(
    "sentiment_std",
    "SELECT CAST(analyzed_at AS DATE) AS stat_date, round(stddev_samp(sentiment_score), 4) AS sentiment_std FROM scored_events GROUP BY 1",
    views=EV,
)
def q_sentiment_std(spark, sf_dir):
    return R.sentiment_std(Tables(spark, sf_dir).scored_events)


@register(
    "high_impact_count",
    """SELECT CAST(analyzed_at AS DATE) AS stat_date, COUNT(CASE WHEN market_impact_score >= 70 THEN 1 END) AS high_impact_count,
       COUNT(*) AS news_count FROM scored_events GROUP BY 1""",
    views=EV,
)
def q_high_impact_count(spark, sf_dir):
    return R.high_impact_count(Tables(spark, sf_dir).scored_events)


@register(
    "hourly_source_summary",
    """SELECT date_trunc('hour', analyzed_at) AS hour, source_name, COUNT(*) AS news_count,
       CAST(SUM(sentiment_score) AS DOUBLE) AS score_sum,
       COUNT(CASE WHEN sentiment_label = 'positive' THEN 1 END) AS positive_count,
       COUNT(CASE WHEN sentiment_label = 'neutral' THEN 1 END) AS neutral_count,
       COUNT(CASE WHEN sentiment_label = 'negative' THEN 1 END) AS negative_count,
       CAST(SUM(sentiment_score) AS DOUBLE) / COUNT(*) AS avg_sentiment
FROM scored_events GROUP BY 1, 2""",
    views=EV,
)
def q_hourly_source_summary(spark, sf_dir):
    return R.hourly_source_summary(Tables(spark, sf_dir).scored_events)


# 1995-01-01 .. 2024-01-01 in days: the order calendar laid onto the news calendar
SHIFT_DAYS = 10592


@register(
    "market_correlation",
    f"""WITH d AS (SELECT CAST(analyzed_at AS DATE) AS stat_date, CAST(SUM(sentiment_score) AS DOUBLE) / COUNT(*) AS avg_sentiment
           FROM scored_events GROUP BY 1),
i AS (SELECT CAST(o_orderdate AS DATE) + {SHIFT_DAYS} AS stat_date, SUM(o_totalprice) AS index_value FROM orders GROUP BY 1)
SELECT COUNT(*) AS n_days, round(corr(d.avg_sentiment, i.index_value), 6) AS correlation
FROM d JOIN i ON d.stat_date = i.stat_date""",
    views=EV,
)
def q_market_correlation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    e = t.scored_events
    daily = R.finish_state(R.partial_state(e, [C.day("analyzed_at").alias("stat_date")]))
    return R.market_correlation(daily, R.order_index(t.base("orders"), SHIFT_DAYS))
