"""Registered sector queries (J-6 .. J-10, G-3, D-10, D-11, D-15) with oracle SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import rollups as R
from ..operators import sectors as G
from ..sources.fixtures import Tables
from .registry import register

FRAGS = ", ".join(f"({i}, '{w}')" for i, w in enumerate(G.FIXTURE_FRAGMENTS))
KW = f"""SELECT DISTINCT ms.id AS sector_id, f.word FROM market_sectors ms
JOIN (VALUES {FRAGS}) AS f(pos, word) ON f.pos = ms.id % 10 OR f.pos = (ms.id * 3 + 1) % 10"""
V = ("raw_news", "sentiment_results", "news_sectors", "market_sectors")


def _kw(t):
    return G.fixture_sector_keywords(t.spark, t.market_sectors)


@register(
    "theta_join_keyword",
    f"WITH kw AS ({KW}) SELECT DISTINCT rn.id AS news_id, kw.sector_id FROM raw_news rn JOIN kw ON contains(rn.title, kw.word)",
    views=V,
)
def q_theta_join_keyword(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.theta_join_keyword(t.raw_news, _kw(t), "title")


TAGS = f"""kw AS ({KW}),
hits AS (SELECT rn.id AS news_id, kw.sector_id, COUNT(*) AS hits FROM raw_news rn JOIN kw ON contains(rn.content, kw.word) GROUP BY 1, 2),
sizes AS (SELECT sector_id, COUNT(*) AS list_size FROM kw GROUP BY 1),
scored AS (SELECT h.news_id, h.sector_id, h.hits / s.list_size AS relevance FROM hits h JOIN sizes s ON h.sector_id = s.sector_id),
allrows AS (SELECT * FROM scored UNION ALL SELECT rn.id, -1, 0.0 FROM raw_news rn WHERE rn.id NOT IN (SELECT news_id FROM hits)),
tags AS (SELECT news_id, sector_id, relevance,
                row_number() OVER (PARTITION BY news_id ORDER BY relevance DESC, sector_id) = 1 AS is_primary FROM allrows)"""


@register("sector_tagging", f"WITH {TAGS} SELECT * FROM tags", views=V)
def q_sector_tagging(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.sector_tagging(t.raw_news, _kw(t), "content")


@register("primary_sector", f"WITH {TAGS} SELECT news_id, sector_id, relevance FROM tags WHERE is_primary", views=V)
def q_primary_sector(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.primary_sector(G.sector_tagging(t.raw_news, _kw(t), "content"))


SCORED_ROWS = """SELECT ns.news_id, ns.sector_id, rn.published_at, sr.sentiment_score, sr.sentiment_label, sr.confidence, sr.market_impact_score
FROM news_sectors ns JOIN raw_news rn ON rn.id = ns.news_id JOIN sentiment_results sr ON sr.news_id = rn.id"""


def period_stats_sql(bucket: str, name: str) -> str:
    from .registry import sql_mean, sql_round_div

    return f"""SELECT sector_id, {bucket} AS {name}, COUNT(*) AS news_count,
       {sql_mean('sentiment_score')} AS avg_sentiment,
       round(stddev_samp(sentiment_score), 4) AS sentiment_std,
       COUNT(CASE WHEN sentiment_label = 'positive' THEN 1 END) AS positive_count,
       COUNT(CASE WHEN sentiment_label = 'neutral' THEN 1 END) AS neutral_count,
       COUNT(CASE WHEN sentiment_label = 'negative' THEN 1 END) AS negative_count,
       {sql_mean('confidence')} AS avg_confidence,
       COUNT(CASE WHEN market_impact_score >= 70 THEN 1 END) AS high_impact_count,
       CAST({sql_round_div('COUNT(CASE WHEN sentiment_label = \'positive\' THEN 1 END)', 'COUNT(*)', 4)} AS DECIMAL(5,4)) AS positive_ratio,
       CAST({sql_round_div('COUNT(CASE WHEN sentiment_label = \'negative\' THEN 1 END)', 'COUNT(*)', 4)} AS DECIMAL(5,4)) AS negative_ratio
FROM ({SCORED_ROWS}) r GROUP BY 1, 2"""


DAILY = period_stats_sql("CAST(published_at AS DATE)", "stat_date")


@register(
    "latest_sector_view",
    f"""WITH d AS ({DAILY})
SELECT ms.id AS sector_id, ms.name AS sector_name, COALESCE(d.news_count, 0) AS news_count_24h,
       d.avg_sentiment, d.positive_count, d.neutral_count, d.negative_count,
       CASE WHEN d.avg_sentiment > 0.3 THEN 'positive' WHEN d.avg_sentiment < -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_trend,
       d.stat_date
FROM market_sectors ms LEFT JOIN d ON ms.id = d.sector_id
WHERE d.stat_date = DATE '2024-01-30' OR d.stat_date IS NULL
ORDER BY d.avg_sentiment DESC NULLS LAST, sector_id""",
    views=V,
)
def q_latest_sector_view(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.latest_sector_view(t.market_sectors, R.daily_sector_stats(t), date(2024, 1, 30))


@register(
    "self_join_parent",
    "SELECT c.id, c.name, c.parent_id, p.name AS parent_name FROM market_sectors c LEFT JOIN market_sectors p ON c.parent_id = p.id",
    views=("market_sectors",),
)
def q_self_join_parent(spark, sf_dir):
    return G.self_join_parent(Tables(spark, sf_dir).market_sectors)


PER_SECTOR = """SELECT ns.sector_id, COUNT(*) AS news_count,
       CAST(sum(sr.sentiment_score) AS DOUBLE) / nullif(count(sr.sentiment_score), 0) AS avg_sentiment
FROM news_sectors ns JOIN sentiment_results sr ON sr.news_id = ns.news_id GROUP BY ns.sector_id"""


@register(
    "sector_rollup",
    f"""WITH ps AS ({PER_SECTOR}),
j AS (SELECT ps.*, ms.parent_id, 1 + ms.id % 3 AS weight FROM ps JOIN market_sectors ms ON ms.id = ps.sector_id WHERE ms.parent_id IS NOT NULL)
SELECT parent_id, sector_id, CAST(SUM(news_count) AS BIGINT) AS news_count,
       round(SUM(weight * avg_sentiment) / SUM(weight), 6) AS weighted_sentiment
FROM j GROUP BY ROLLUP (parent_id, sector_id)""",
    views=V,
)
def q_sector_rollup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.sector_rollup(t.market_sectors, G.per_sector_means(t))


def subscriptions(t):
    """Alert subscriptions derived from customers: sector = nation, threshold by key."""
    c = t.base("customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("sector_id"),
                    ((F.col("c_custkey") % 5).cast("double") / 10).alias("alert_threshold"))


@register(
    "subscription_alerts",
    f"""WITH ps AS ({PER_SECTOR}),
subs AS (SELECT c_custkey AS user_id, c_nationkey AS sector_id, CAST(c_custkey % 5 AS DOUBLE) / 10 AS alert_threshold FROM customer)
SELECT s.user_id, s.sector_id, ps.avg_sentiment, s.alert_threshold
FROM subs s JOIN ps ON s.sector_id = ps.sector_id AND abs(ps.avg_sentiment) >= s.alert_threshold""",
    views=V,
)
def q_subscription_alerts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.subscription_alerts(subscriptions(t), G.per_sector_means(t))


@register(
    "cross_join_series",
    f"""WITH h AS (SELECT sector_id, date_trunc('hour', published_at) AS hour, COUNT(*) AS news_count
           FROM ({SCORED_ROWS}) r WHERE published_at IS NOT NULL GROUP BY 1, 2),
b AS (SELECT sector_id, min(hour) AS lo, max(hour) AS hi FROM h GROUP BY 1),
s AS (SELECT sector_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM b)
SELECT s.sector_id, s.hour, COALESCE(h.news_count, 0) AS news_count
FROM s LEFT JOIN h ON s.sector_id = h.sector_id AND s.hour = h.hour""",
    views=V,
)
def q_cross_join_series(spark, sf_dir):
    from ..operators.gaps import hourly_gap_fill

    t = Tables(spark, sf_dir)
    return hourly_gap_fill(R.scored_sector_rows(t), "sector_id", "published_at")
