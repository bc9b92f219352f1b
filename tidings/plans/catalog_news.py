"""Registered news-surface queries (F-*, J-1..J-5, O-*) with oracle SQL."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import news as N
from ..sources.fixtures import Tables, ts
from .registry import register

ITEMS = """SELECT rn.id, rn.title, CAST(NULL AS VARCHAR) AS summary, rn.url, CAST(NULL AS VARCHAR) AS author,
       src.name AS source_name, rn.published_at, sr.sentiment_label, sr.sentiment_score, sr.confidence
FROM raw_news rn
JOIN news_sources src ON rn.source_id = src.id
LEFT JOIN sentiment_results sr ON rn.id = sr.news_id"""
V_ITEMS = ("raw_news", "news_sources", "sentiment_results")
V_ALL = ("raw_news", "news_sources", "sentiment_results", "news_sectors", "market_sectors")


def _items(t, news=None):
    return N.news_items(news if news is not None else t.raw_news, t.news_sources, t.sentiment_results)


@register("news_projection", ITEMS, views=V_ITEMS)
def q_news_projection(spark, sf_dir):
    return _items(Tables(spark, sf_dir))


@register("filter_label", ITEMS + "\nWHERE sr.sentiment_label = 'negative'", views=V_ITEMS)
def q_filter_label(spark, sf_dir):
    return N.filter_label(_items(Tables(spark, sf_dir)), "negative")


@register("filter_date_range", ITEMS + "\nWHERE CAST(rn.published_at AS DATE) <= DATE '2024-01-12'", views=V_ITEMS)
def q_filter_date_range(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _items(t, N.filter_date_range(t.raw_news, None, date(2024, 1, 12)))


@register(
    "filter_date_between",
    ITEMS + "\nWHERE CAST(rn.published_at AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'",
    views=V_ITEMS,
)
def q_filter_date_between(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _items(t, N.filter_date_between(t.raw_news, date(2024, 1, 10), date(2024, 1, 20)))


@register("filter_keyword", ITEMS + "\nWHERE (rn.title ILIKE '%th_n%' OR rn.content ILIKE '%th_n%')", views=V_ITEMS)
def q_filter_keyword(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _items(t, N.filter_keyword(t.raw_news, "th_n"))


@register(
    "filter_unscored",
    "SELECT rn.id, rn.title, rn.published_at FROM raw_news rn WHERE NOT EXISTS (SELECT 1 FROM sentiment_results sr WHERE sr.news_id = rn.id)",
    views=("raw_news", "sentiment_results"),
)
def q_filter_unscored(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return N.filter_unscored(t.raw_news.select("id", "title", "published_at"), t.sentiment_results)


@register("news_by_id", ITEMS + "\nWHERE rn.id = 42", views=V_ITEMS)
def q_news_by_id(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return N.news_by_id(t.raw_news, t.news_sources, t.sentiment_results, 42)


_SEARCH_WHERE = """WHERE sr.sentiment_label = 'positive'
  AND rn.id IN (SELECT ns2.news_id FROM news_sectors ns2 JOIN market_sectors ms ON ns2.sector_id = ms.id WHERE ms.name = 'NATION_2')
  AND CAST(rn.published_at AS DATE) >= DATE '2024-01-03'
  AND (rn.title ILIKE '%the%' OR rn.content ILIKE '%the%')"""


@register(
    "news_search",
    ITEMS + "\n" + _SEARCH_WHERE + "\nORDER BY rn.published_at DESC NULLS FIRST, rn.id LIMIT 20",
    views=V_ALL,
)
def q_news_search(spark, sf_dir):
    q = N.NewsQuery(page=1, page_size=20, sentiment="positive", sector="NATION_2",
                    start_date=date(2024, 1, 3), keyword="the")
    return N.search_news(Tables(spark, sf_dir), q)


@register(
    "join_inner_source",
    "SELECT rn.id, rn.source_id, src.name AS source_name FROM raw_news rn JOIN news_sources src ON rn.source_id = src.id",
    views=("raw_news", "news_sources"),
)
def q_join_inner_source(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return N.join_inner_source(t.raw_news.select("id", "source_id"), t.news_sources).select("id", "source_id", "source_name")


@register(
    "join_left_sentiment",
    "SELECT rn.id, sr.sentiment_score, sr.sentiment_label FROM raw_news rn LEFT JOIN sentiment_results sr ON rn.id = sr.news_id",
    views=("raw_news", "sentiment_results"),
)
def q_join_left_sentiment(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return N.join_left_sentiment(t.raw_news.select("id"), t.sentiment_results, cols=("sentiment_score", "sentiment_label"))


def _details(t):
    """Sentiment results with entities, keywords, industry tags (JSON text) and
    the analysis time, by rule from the news id."""
    i = F.col("news_id").cast("string")
    return t.sentiment_results.withColumns({
        "entities": F.concat(F.lit('[{"name": "org '), i, F.lit('", "type": "company"}]')),
        "keywords": F.concat(F.lit('["kw '), (F.col("news_id") % 7).cast("string"), F.lit('"]')),
        "industry_tags": F.when(F.col("news_id") % 5 != 0, F.concat(F.lit('["tag '), (F.col("news_id") % 5).cast("string"), F.lit('"]'))),
        "analyzed_at": F.timestamp_add("MINUTE", (F.col("news_id") % 1440).cast("int"), ts("2024-01-30 00:00:00"))})


_DETAILS_SQL = """, d AS (SELECT *, '[{"name": "org ' || news_id || '", "type": "company"}]' AS entities, '["kw ' || (news_id % 7) || '"]' AS keywords,
             CASE WHEN news_id % 5 <> 0 THEN '["tag ' || (news_id % 5) || '"]' END AS industry_tags,
             TIMESTAMP '2024-01-30 00:00:00' + to_minutes(news_id % 1440) AS analyzed_at FROM sentiment_results)
"""


@register(
    "news_sentiment_view",
    "WITH x AS (SELECT 1)" + _DETAILS_SQL + """SELECT d.news_id AS id, rn.title, rn.url, rn.published_at, src.name AS source_name, d.sentiment_score,
       d.sentiment_label, d.confidence, d.market_impact_score, d.entities, d.keywords, d.analyzed_at
FROM d JOIN raw_news rn ON rn.id = d.news_id LEFT JOIN news_sources src ON src.id = rn.source_id""",
    views=V_ITEMS,
)
def q_news_sentiment_view(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return N.news_sentiment_view(t.raw_news, t.news_sources, _details(t))


@register(
    "news_sentiment_view_all",
    "WITH x AS (SELECT 1)" + _DETAILS_SQL + """SELECT rn.id, rn.title, rn.content, rn.url, CAST(NULL AS VARCHAR) AS author, rn.published_at,
       src.name AS source_name, d.sentiment_score, d.sentiment_label, d.confidence, d.keywords, d.industry_tags, d.analyzed_at
FROM raw_news rn LEFT JOIN d ON d.news_id = rn.id LEFT JOIN news_sources src ON src.id = rn.source_id
ORDER BY rn.published_at DESC NULLS FIRST, rn.id""",
    views=V_ITEMS,
)
def q_news_sentiment_view_all(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return N.news_sentiment_view_all(t.raw_news, t.news_sources, _details(t))


@register(
    "semi_join_sector",
    """SELECT rn.id, rn.title FROM raw_news rn
WHERE rn.id IN (SELECT ns2.news_id FROM news_sectors ns2 JOIN market_sectors ms ON ns2.sector_id = ms.id WHERE ms.name = 'NATION_7')""",
    views=("raw_news", "news_sectors", "market_sectors"),
)
def q_semi_join_sector(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return N.semi_join_sector(t.raw_news.select("id", "title"), t.news_sectors, t.market_sectors, "NATION_7")


@register("news_page", ITEMS + "\nORDER BY rn.published_at DESC NULLS FIRST, rn.id LIMIT 25 OFFSET 50", views=V_ITEMS)
def q_news_page(spark, sf_dir):
    return N.news_page(_items(Tables(spark, sf_dir)), page=3, page_size=25)


@register(
    "news_page_keyset",
    ITEMS + """
WHERE rn.published_at < TIMESTAMP '2024-01-20 05:00:00'
   OR (rn.published_at = TIMESTAMP '2024-01-20 05:00:00' AND rn.id > 300)
ORDER BY rn.published_at DESC NULLS FIRST, rn.id LIMIT 25""",
    views=V_ITEMS,
)
def q_news_page_keyset(spark, sf_dir):
    return N.news_page_after(_items(Tables(spark, sf_dir)), datetime(2024, 1, 20, 5), 300, 25)


@register(
    "latest_news",
    """WITH store AS (SELECT rn.id, rn.title, rn.url, src.name AS source, rn.published_at
                FROM raw_news rn LEFT JOIN news_sources src ON rn.source_id = src.id)
SELECT * FROM store ORDER BY published_at DESC NULLS LAST, id LIMIT 20""",
    views=("raw_news", "news_sources"),
)
def q_latest_news(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # the left join keeps every row: the 20 rows are taken first
    top = N.latest_news(t.raw_news.select("id", "title", "url", "source_id", "published_at"), 20)
    store = top.join(t.news_sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id", "left")
    return N.latest_news(store.select("id", "title", "url", "source", "published_at"), 20)


@register(
    "scoring_batch",
    """SELECT rn.id, rn.title, rn.content, rn.published_at FROM raw_news rn
WHERE rn.id NOT IN (SELECT news_id FROM sentiment_results)
ORDER BY rn.published_at DESC NULLS LAST, rn.id LIMIT 10""",
    views=("raw_news", "sentiment_results"),
)
def q_scoring_batch(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return N.scoring_batch(t.raw_news, t.sentiment_results, 10)


@register(
    "array_head",
    "SELECT id, array_to_string(string_split(content, ' ')[1:5], ', ') AS keywords_head FROM raw_news",
    views=("raw_news",),
)
def q_array_head(spark, sf_dir):
    t = Tables(spark, sf_dir)
    kw = t.raw_news.select("id", C.tokens("content").alias("keywords"))
    return N.array_head(kw, "keywords", 5).select("id", "keywords_head")


@register(
    "table_scan",
    "SELECT id, source_id, external_id, title, url, language, n_chars, published_at FROM raw_news",
    views=("raw_news",),
)
def q_table_scan(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.raw_news.select("id", "source_id", "external_id", "title", "url", "language", "n_chars", "published_at")


@register(
    "fn_coalesce_zero",
    """SELECT rn.source_id, COUNT(*) AS news_count,
       COALESCE(CAST(sum(sr.sentiment_score) AS DOUBLE) / nullif(count(sr.sentiment_score), 0), 0) AS avg_sentiment
FROM raw_news rn LEFT JOIN sentiment_results sr ON rn.id = sr.news_id GROUP BY rn.source_id""",
    views=("raw_news", "sentiment_results"),
)
def q_fn_coalesce_zero(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = N.join_left_sentiment(t.raw_news.select("id", "source_id"), t.sentiment_results, cols=("sentiment_score",))
    return j.groupBy("source_id").agg(F.count(F.lit(1)).alias("news_count"), C.mean_or_zero("sentiment_score").alias("avg_sentiment"))
