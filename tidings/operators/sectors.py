"""Sector work: keyword tagging, hierarchy, sector views and alerts
(J-6 .. J-10, G-3, D-10, D-11, D-15).

Keyword lists may be of any size: words are found by the q-gram join of
``operators.words``, and the wide text is read once without being shuffled.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import core as C
from .words import find_words

CATCH_ALL_ID = -1

# Keyword lists of the minimal variant's six sectors (code, name, keywords).
SEED_SECTORS = [
    ("tech", "科技", ["科技", "互联网", "AI", "软件", "芯片"]),
    ("finance", "金融", ["金融", "银行", "证券", "保险", "投资"]),
    ("estate", "房地产", ["房地产", "楼市", "房价", "地产"]),
    ("consumer", "消费", ["消费", "零售", "电商", "食品"]),
    ("energy", "能源", ["能源", "新能源", "光伏", "电力"]),
    ("medicine", "医药", ["医药", "医疗", "健康", "药品"]),
]

# Text fragments used as fixture keyword lists; sector s gets
# fragments s % 10 and (3s + 1) % 10.
FIXTURE_FRAGMENTS = ["tion", "ent", "eau", "ein", "ado", "the", "und", "los", "ier", "ouen"]


def fixture_sector_keywords(spark, sectors: DataFrame) -> DataFrame:
    """(sector_id, word) keyword lists for the fixture sectors, by rule."""
    frags = F.array(*[F.lit(w) for w in FIXTURE_FRAGMENTS])
    s = F.col("sector_id")
    words = F.array_distinct(F.array(F.get(frags, F.pmod(s, F.lit(10)).cast("int")), F.get(frags, F.pmod(s * 3 + 1, F.lit(10)).cast("int"))))
    return sectors.select(F.col("id").alias("sector_id")).distinct().select("sector_id", F.explode(words).alias("word"))


def seed_sector_keywords(spark) -> DataFrame:
    rows = [(i + 1, code, name, kws) for i, (code, name, kws) in enumerate(SEED_SECTORS)]
    df = spark.createDataFrame(rows, "id int, code string, name string, keywords array<string>")
    return df.select(F.col("id").alias("sector_id"), F.explode("keywords").alias("word"))


# ---- J-6 theta join ---------------------------------------------------------------------
def _listed(keywords: DataFrame) -> DataFrame:
    """Distinct (sector_id, word) of the lists; NULL ids and NULL or empty words are ignored."""
    return keywords.select("sector_id", "word").filter(F.col("sector_id").isNotNull() & (F.length("word") > 0)).distinct()


def theta_join_keyword(news: DataFrame, keywords: DataFrame, text_col: str = "title") -> DataFrame:
    """(news_id, sector_id) for every sector with a keyword inside the text, by
    the q-gram join of ``operators.words``: the lists may be of any size."""
    words = _listed(keywords).groupBy("word").agg(F.collect_list("sector_id").alias("_sectors"))
    rows = news.select(F.col("id").alias("news_id"), F.col(text_col).alias("_t"))
    found = find_words(rows, words, "_t")
    return found.select("news_id", F.explode("_sectors").alias("sector_id")).distinct()


# ---- G-3 sector tagging + D-15 primary sector -----------------------------------------
def sector_tagging(news: DataFrame, keywords: DataFrame, text_col: str = "content") -> DataFrame:
    """news -> (news_id, sector_id, relevance, is_primary).

    relevance = distinct keywords of the sector found / size of its list.
    The best sector (highest relevance, then lowest id) is primary.  News
    without any hit gets the catch-all sector (id -1, relevance 0).

    The words of all lists (of any size) are found by the q-gram join of
    ``operators.words``; what is shuffled is one narrow row per news and word,
    then per news and sector.  NULL sector ids and NULL or empty words are
    ignored; a NULL text has no hit."""
    listed = _listed(keywords).withColumn("sector_id", F.col("sector_id").cast("int"))
    sizes = listed.groupBy("sector_id").agg(F.count(F.lit(1)).alias("size"))
    words = listed.join(sizes, "sector_id").groupBy("word").agg(F.collect_list(F.struct("sector_id", "size")).alias("_sectors"))
    rows = news.select(F.col("id").alias("news_id"), F.col(text_col).alias("_t"))
    found = find_words(rows, words, "_t", every_row=True)
    per_sector = found.select("_row", "news_id", F.explode_outer("_sectors").alias("s")).groupBy(
        "_row", "news_id", F.col("s.sector_id").alias("sector_id"), F.col("s.size").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    tag = F.struct((F.col("n") / F.col("size")).alias("relevance"), "sector_id")
    # a news has at most a tag per sector
    tags = per_sector.groupBy("_row", "news_id").agg(F.collect_list(F.when(F.col("sector_id").isNotNull(), tag)).alias("_f"))
    none = F.struct(F.lit(0.0).alias("relevance"), F.lit(CATCH_ALL_ID).alias("sector_id"))
    tags = tags.select("news_id", F.when(F.size("_f") > 0, F.col("_f")).otherwise(F.array(none)).alias("_f"))
    best = F.array_max(F.transform("_f", lambda e: F.struct(e["relevance"], -e["sector_id"])))["col2"]
    e = tags.select("news_id", F.explode("_f").alias("e"), (-best).alias("_best"))
    return e.select("news_id", F.col("e.sector_id").alias("sector_id"), F.col("e.relevance").alias("relevance"),
                    (F.col("e.sector_id") == F.col("_best")).alias("is_primary"))


def primary_sector(tags: DataFrame) -> DataFrame:
    return tags.filter("is_primary").select("news_id", "sector_id", "relevance")


# ---- J-8 latest sector view -----------------------------------------------------------
def latest_sector_view(sectors: DataFrame, daily: DataFrame, today: date) -> DataFrame:
    """sector LEFT JOIN daily stats, kept when the stats are of ``today`` or
    absent: sectors with stats only on other days drop out (as specified)."""
    s = sectors.select(F.col("id").alias("sector_id"), F.col("name").alias("sector_name"))
    j = s.join(daily, "sector_id", "left").filter((F.col("stat_date") == F.lit(today)) | F.col("stat_date").isNull())
    return j.select(
        "sector_id", "sector_name",
        F.coalesce("news_count", F.lit(0)).alias("news_count_24h"),
        "avg_sentiment", "positive_count", "neutral_count", "negative_count",
        F.when(F.col("avg_sentiment") > S.POSITIVE_THRESHOLD, "positive")
        .when(F.col("avg_sentiment") < S.NEGATIVE_THRESHOLD, "negative").otherwise("neutral").alias("sentiment_trend"),
        "stat_date",
    ).orderBy(F.col("avg_sentiment").desc_nulls_last(), "sector_id")


# ---- J-10 hierarchy --------------------------------------------------------------------------
def self_join_parent(sectors: DataFrame) -> DataFrame:
    parent = sectors.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return sectors.select("id", "name", "parent_id").join(parent, "parent_id", "left").select(
        "id", "name", "parent_id", "parent_name")


def sector_weight(sector_id) -> "F.Column":
    """Fixture weight of a sector (the dimension has no weights of its own)."""
    return (1 + F.pmod(F.col(sector_id) if isinstance(sector_id, str) else sector_id, F.lit(3))).cast("int")


# ---- D-11 rollup into parents ----------------------------------------------------------
def sector_rollup(sectors: DataFrame, per_sector: DataFrame) -> DataFrame:
    """Child means rolled into parents, weighted by sector weight; rollup
    gives (parent, child), (parent, all) and (all, all) rows."""
    s = sectors.select(F.col("id").alias("sector_id"), "parent_id", sector_weight("id").alias("weight"))
    j = per_sector.join(s, "sector_id").filter(F.col("parent_id").isNotNull())
    return j.rollup("parent_id", "sector_id").agg(
        F.sum("news_count").alias("news_count"),
        F.round(F.sum(F.col("weight") * F.col("avg_sentiment")) / F.sum("weight"), 6).alias("weighted_sentiment"),
    )


# ---- D-10 subscription alerts -----------------------------------------------------------
def subscription_alerts(subscriptions: DataFrame, per_sector: DataFrame) -> DataFrame:
    """Subscribers whose sector mean reaches their threshold in absolute value.
    Equi-join on sector plus the theta condition on the threshold."""
    ps = per_sector.select("sector_id", "avg_sentiment")
    j = subscriptions.join(ps, (subscriptions.sector_id == ps.sector_id) & (F.abs(ps.avg_sentiment) >= subscriptions.alert_threshold))
    return j.select(subscriptions.user_id, subscriptions.sector_id, ps.avg_sentiment, subscriptions.alert_threshold)


def per_sector_means(t) -> DataFrame:
    """Scored news per sector: count and exact mean score."""
    sr = t.sentiment_results.select("news_id", "sentiment_score")
    j = t.news_sectors.select("news_id", "sector_id").join(sr, "news_id")
    return j.groupBy("sector_id").agg(F.count(F.lit(1)).alias("news_count"), C.exact_mean("sentiment_score").alias("avg_sentiment"))
