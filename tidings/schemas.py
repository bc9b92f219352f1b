"""Schemas, enumerations and fixed constants of the domain model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the original system's for equal results.
# ---------------------------------------------------------------------------
POSITIVE_THRESHOLD = 0.3          # score > 0.3  -> positive
NEGATIVE_THRESHOLD = -0.3         # score < -0.3 -> negative (borders neutral)
LABELS = ("positive", "neutral", "negative")
PERIODS_HOURS = {"24h": 24, "7d": 24 * 7, "30d": 24 * 30}   # unknown period -> 24h
DEFAULT_PERIOD = "24h"
PAGE_SIZE_MAX = 100
TREND_DAYS_MAX = 90
DEFAULT_RETENTION_DAYS = 90
STATS_CACHE_TTL_HOURS = 1
STATS_CACHE_KEY = "stats:24h"
FEED_ENTRY_LIMIT = 20
DASHBOARD_LATEST = 20
REPORT_LATEST = 5
TOP_SECTORS = 8
HIGH_IMPACT_MIN = 70
CATCH_ALL_SECTOR = "综合"          # placeholder sector of the minimal variant
SOURCE_STATUSES = ("active", "inactive", "error")
JOB_STATUSES = ("pending", "running", "success", "failed", "cancelled")
SOURCE_TYPES = ("rss", "api", "scrape", "webhook")
DEFAULT_FETCH_INTERVAL_S = 300
CONFIG_TYPES = ("string", "integer", "float", "boolean", "json")
TREND_LABELS = ("rising", "falling", "stable", "volatile")
# default reply of the scorer when a reply cannot be parsed
DEFAULT_SCORE_REPLY = {
    "sentiment_score": 0.0,
    "sentiment_label": "neutral",
    "confidence": 0.5,
    "entities": [],
    "keywords": [],
    "market_impact_score": 50,
}
# feed date formats tried in order (after the weekday prefix is cut off)
FEED_DATE_FORMATS = ("d MMM yyyy H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s")

# Fixed clock of the fixtures (every function takes an explicit as_of).
FIXTURE_AS_OF = "2024-01-31 00:00:00"

# ---------------------------------------------------------------------------
# Message and record schemas.
# ---------------------------------------------------------------------------
ENTITY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("sentiment", T.DoubleType()),
    ]
)

NEWS_MESSAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("published_at", T.StringType()),
        T.StructField("collected_at", T.StringType()),
    ]
)

# a feed entry as a message, before it is news
ENTRY_MESSAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("guid", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("published_at", T.StringType()),
    ]
)

SENTIMENT_MESSAGE = T.StructType(
    [
        T.StructField("news_id", T.LongType()),
        T.StructField("sentiment_score", T.DoubleType()),
        T.StructField("sentiment_label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("entities", T.ArrayType(T.StringType())),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("market_impact_score", T.IntegerType()),
        T.StructField("original_data", NEWS_MESSAGE),
        T.StructField("analyzed_at", T.StringType()),
    ]
)

SCORE_REPLY = T.StructType(
    [
        T.StructField("sentiment_score", T.DoubleType()),
        T.StructField("sentiment_label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("entities", T.ArrayType(T.StringType())),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("market_impact_score", T.IntegerType()),
    ]
)

FEED_ITEM = T.StructType(
    [
        T.StructField("guid", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("content:encoded", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("dc:creator", T.StringType()),
        T.StructField("pubDate", T.StringType()),
    ]
)

ATOM_ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("link", T.ArrayType(T.StructType([T.StructField("_href", T.StringType()), T.StructField("_rel", T.StringType())]))),
        T.StructField("summary", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField("published", T.StringType()),
        T.StructField("updated", T.StringType()),
    ]
)
