"""Registered streaming queries (R-1 .. R-8).

Each query lands the fixture rows as message / Parquet files in the shared
folder, runs the stream with an available-now trigger through a
checkpoint, and returns the sink table read back in batch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import ingest as I
from ..operators import scoring as G
from ..session import scratch_path
from ..sources.fixtures import Tables, scored_events_of, ts
from ..streaming import jobs as J
from .catalog_rollups import ONE_PASS_DAILY
from .catalog_scoring import LEX_SQL
from .registry import register


def land_news_messages(t, path: str, files: int = 8) -> None:
    """raw-news messages (JSON lines, every 50th broken) as text files."""
    src = t.news_sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    n = t.raw_news.join(src, "source_id", "left")
    fmt = "yyyy-MM-dd HH:mm:ss"
    msg = F.to_json(F.struct(
        "id", "title", "content", F.lit(None).cast("string").alias("summary"), "url", F.lit(None).cast("string").alias("author"),
        F.col("source_id").cast("long").alias("source_id"), "source_name",
        F.date_format("published_at", fmt).alias("published_at"), F.date_format("published_at", fmt).alias("collected_at")))
    value = F.when(F.col("id") % 50 == 0, F.lit("not json {")).otherwise(msg)
    n.select(F.concat(F.col("id").cast("string"), F.lit("\t"), value).alias("line")).repartition(files).write.mode("overwrite").text(path)


def news_stream(spark, path: str, max_files: int | None = None):
    lines = J.file_source(spark, path, "text", max_files=max_files)
    parts = F.split(F.col("value"), "\t", 2)
    return lines.select(parts[0].alias("key"), parts[1].alias("value"))


def land_events(t, path: str, files: int = 8) -> None:
    t.events.repartition(files).write.mode("overwrite").parquet(path)


def events_stream(spark, t, path: str, max_files: int | None = None):
    return J.file_source(spark, path, "parquet", schema=t.events.schema, max_files=max_files)


def land_entries(news, path: str) -> None:
    """Feed entries of ``news`` as messages (JSON lines, every 50th broken);
    every third entry has no guid, every fourth no content."""
    msg = F.to_json(F.struct(
        "id", F.col("source_id").cast("long").alias("source_id"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.col("external_id")).alias("guid"), "title", F.col("url").alias("link"),
        F.col("title").alias("description"), F.when(F.col("id") % 4 != 0, F.col("content")).alias("content"),
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at")))
    value = F.when(F.col("id") % 50 == 0, "not json {").otherwise(msg)
    news.select(F.concat(F.col("id").cast("string"), F.lit("\t"), value).alias("line")).repartition(8).write.text(path)


@register(
    "stream_ingest",
    """WITH e AS (SELECT id, source_id, title, url, CASE WHEN id % 3 = 0 THEN url ELSE external_id END AS external_id,
                 md5(CASE WHEN id % 4 <> 0 AND content <> '' THEN content ELSE title END) AS content_md5, id % 2 = 0 AS late
          FROM raw_news WHERE id % 50 <> 0)
SELECT id, source_id, external_id, title, url, content_md5 FROM e
WHERE source_id IS NULL OR external_id IS NULL
   OR NOT EXISTS (SELECT 1 FROM e o WHERE o.source_id = e.source_id AND o.external_id = e.external_id
                  AND (o.late < e.late OR (o.late = e.late AND o.id < e.id)))""",
    views=("raw_news",),
)
def q_stream_ingest(spark, sf_dir):
    """Entry messages -> parsed (broken ones skipped) -> appended -> first
    writer per (source_id, guid or link).  The odd ids arrive first; then all
    entries with a source are polled again, and the even ids arrive."""
    t = Tables(spark, sf_dir)
    land, target, ckpt = (scratch_path(spark, n) for n in ("land-entries", "raw_news", "ckpt-ingest"))
    odd = F.col("id") % 2 == 1
    for part, rows in enumerate((t.raw_news.filter(odd), t.raw_news.filter(~odd | F.col("source_id").isNotNull()))):
        land_entries(rows, f"{land}/poll={part}")
        J.stream_ingest(news_stream(spark, land), target, ckpt)
    got = J.stored_news(J.appended(spark, target))
    return got.select("id", F.col("source_id").cast("int").alias("source_id"), "external_id", "title", "url",
                      F.md5("content").alias("content_md5"))


@register(
    "stream_score",
    LEX_SQL + """
SELECT s.id AS news_id, s.sentiment_score,
       CASE WHEN s.sentiment_score > 0.3 THEN 'positive' WHEN s.sentiment_score < -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       s.confidence, rn.title
FROM s JOIN raw_news rn ON rn.id = s.id WHERE s.id % 50 <> 0""",
    views=("raw_news", "lexicon"),
)
def q_stream_score(spark, sf_dir):
    """Each message scored, ≤ 2 files per micro-batch, input carried as a nested struct."""
    t = Tables(spark, sf_dir)
    land = scratch_path(spark, "land-raw-news")
    land_news_messages(t, land)
    target, ckpt = scratch_path(spark, "scored"), scratch_path(spark, "ckpt-score")
    J.stream_score(news_stream(spark, land, max_files=2), S.NEWS_MESSAGE, t.lexicon, target, ckpt)
    out = spark.read.parquet(target)
    return out.select("news_id", "sentiment_score", "sentiment_label", "confidence", F.col("original_data.title").alias("title"))


@register(
    "stream_quarantine",
    LEX_SQL + """
SELECT 'quarantine' AS sink, CAST(id AS VARCHAR) AS key, 'not json {' AS value, 'undecodable' AS reason, NULL::BIGINT AS news_id,
       NULL::DECIMAL(5,4) AS sentiment_score, NULL::VARCHAR AS sentiment_label, NULL::DECIMAL(5,4) AS confidence
FROM raw_news WHERE id % 50 = 0
UNION ALL
SELECT 'scored', NULL, NULL, NULL, id, sentiment_score,
       CASE WHEN sentiment_score > 0.3 THEN 'positive' WHEN sentiment_score < -0.3 THEN 'negative' ELSE 'neutral' END, confidence
FROM s WHERE id % 50 <> 0""",
    views=("raw_news", "lexicon"),
)
def q_stream_quarantine(spark, sf_dir):
    """Two sinks from one micro-batch, both read back: scored rows and the quarantine."""
    t = Tables(spark, sf_dir)
    land = scratch_path(spark, "land-raw-news")
    land_news_messages(t, land)
    target, quarantine, ckpt = scratch_path(spark, "scored"), scratch_path(spark, "quarantine"), scratch_path(spark, "ckpt-q")
    J.stream_score(news_stream(spark, land, max_files=4), S.NEWS_MESSAGE, t.lexicon, target, ckpt, quarantine)
    bad = J.appended(spark, quarantine).select(F.lit("quarantine").alias("sink"), "key", "value", "reason")
    good = J.appended(spark, target).select(F.lit("scored").alias("sink"), "news_id", "sentiment_score", "sentiment_label", "confidence")
    return bad.unionByName(good, allowMissingColumns=True)


@register(
    "stream_append_fact",
    """SELECT news_id, source_name, sentiment_score, sentiment_label, CAST(analyzed_at AS DATE) AS date,
       CAST(strftime(analyzed_at, '%Y%m') AS INT) AS yyyymm FROM scored_events""",
    views=("scored_events",),
)
def q_stream_append_fact(spark, sf_dir):
    t = Tables(spark, sf_dir)
    land = scratch_path(spark, "land-events")
    land_events(t, land)
    target, ckpt = scratch_path(spark, "fact"), scratch_path(spark, "ckpt-fact")
    J.stream_append_fact(scored_events_of(events_stream(spark, t, land, max_files=3)), target, ckpt)
    return spark.read.parquet(target).select("news_id", "source_name", "sentiment_score", "sentiment_label", "date", "yyyymm")


@register("stream_daily_stats", ONE_PASS_DAILY, views=("scored_events",))
def q_stream_daily_stats(spark, sf_dir):
    """Running per-day state in the state store; equals one batch pass."""
    t = Tables(spark, sf_dir)
    land = scratch_path(spark, "land-events")
    land_events(t, land)
    target, ckpt = scratch_path(spark, "daily"), scratch_path(spark, "ckpt-daily")
    J.stream_daily_stats(scored_events_of(events_stream(spark, t, land, max_files=3)), target, ckpt)
    return J.newest_by_key(J.appended(spark, target), ["stat_date"]).select("stat_date", "news_count", "score_sum", "positive_count",
                                                                            "neutral_count", "negative_count", "avg_sentiment")


def first_and_second_scores(t):
    """First scores (version 1) and re-scores (version 2, two news of three)."""
    v1 = t.sentiment_results.select("news_id", "sentiment_score", "sentiment_label", F.lit(1).alias("version"),
                                    ts("2024-01-20 00:00:00").alias("created_at"))
    lx = G.lexicon_score(t.raw_news, t.lexicon).select(F.col("id").alias("news_id"), "sentiment_score", "sentiment_label")
    v2 = lx.join(v1.select("news_id"), "news_id", "left_semi").filter(F.col("news_id") % 3 != 0).select(
        "news_id", "sentiment_score", "sentiment_label", F.lit(2).alias("version"), ts("2024-01-25 00:00:00").alias("created_at"))
    return v1, v2


@register(
    "stream_upsert_result",
    LEX_SQL + """
SELECT sr.news_id,
       CASE sr.news_id % 3 WHEN 0 THEN CAST(sr.sentiment_score AS DOUBLE) WHEN 1 THEN -CAST(s.sentiment_score AS DOUBLE)
                           ELSE CAST(s.sentiment_score AS DOUBLE) END + 0.0 AS sentiment_score,
       CASE WHEN sr.news_id % 3 = 0 THEN sr.sentiment_label WHEN s.sentiment_score > 0.3 THEN 'positive'
            WHEN s.sentiment_score < -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       CASE WHEN sr.news_id % 3 = 0 THEN 1 ELSE 2 END AS version, TIMESTAMP '2024-01-20 00:00:00' AS created_at
FROM sentiment_results sr JOIN s ON s.id = sr.news_id""",
    views=("raw_news", "lexicon", "sentiment_results"),
)
def q_stream_upsert_result(spark, sf_dir):
    """First scores (version 1) and re-scores (version 2, two news of three);
    then the first scores come again, late, and one re-score of two again with
    an equal version and the sign turned.  The highest version wins, of equal
    versions the later delivery, and the first creation time stays."""
    t = Tables(spark, sf_dir)
    v1, v2 = first_and_second_scores(t)
    v1, v2 = (x.withColumn("sentiment_score", F.col("sentiment_score").cast("double")) for x in (v1, v2))
    again = v2.filter(F.col("news_id") % 3 == 1).withColumn("sentiment_score", -F.col("sentiment_score") + 0.0)
    land, target, ckpt = (scratch_path(spark, n) for n in ("land-results", "results", "ckpt-upsert"))
    for part, rows in enumerate((v1.unionByName(v2), v1.withColumn("created_at", ts("2024-01-30 00:00:00")).unionByName(again))):
        rows.write.parquet(f"{land}/delivery={part}")
        stream = J.file_source(spark, land, "parquet", schema=v1.schema).select(*v1.columns)
        J.stream_upsert_result(stream, target, ckpt)
    return J.latest_results(J.appended(spark, target), "news_id", "version").select(
        "news_id", "sentiment_score", "sentiment_label", "version", "created_at")


@register(
    "stream_hourly_window",
    """SELECT date_trunc('hour', analyzed_at) AS hour, source_name, COUNT(*) AS news_count,
       CAST(SUM(sentiment_score) AS DOUBLE) AS score_sum,
       COUNT(CASE WHEN sentiment_label = 'positive' THEN 1 END) AS positive_count,
       COUNT(CASE WHEN sentiment_label = 'neutral' THEN 1 END) AS neutral_count,
       COUNT(CASE WHEN sentiment_label = 'negative' THEN 1 END) AS negative_count
FROM scored_events GROUP BY 1, 2""",
    views=("scored_events",),
)
def q_stream_hourly_window(spark, sf_dir):
    """Event-time hourly windows per source: partial states appended, summed on read."""
    t = Tables(spark, sf_dir)
    land = scratch_path(spark, "land-events")
    land_events(t, land)
    target, ckpt = scratch_path(spark, "hourly"), scratch_path(spark, "ckpt-hourly")
    J.stream_hourly_window(scored_events_of(events_stream(spark, t, land, max_files=3)), target, ckpt)
    return J.hourly_stats(J.appended(spark, target))


@register(
    "stream_dedup",
    """SELECT min(id) AS id, source_id, external_id FROM raw_news WHERE source_id IS NOT NULL GROUP BY source_id, external_id
UNION ALL
SELECT id, source_id, external_id FROM raw_news WHERE source_id IS NULL""",
    views=("raw_news",),
)
def q_stream_dedup(spark, sf_dir):
    """Duplicate (source_id, external_id) dropped inside the stream; NULL sources
    never collide.  Each key's first ids arrive with the odd days, all rows of
    keys already stored come again with the even ones."""
    t = Tables(spark, sf_dir)
    land, target, ckpt = (scratch_path(spark, n) for n in ("land-news", "dedup", "ckpt-dedup"))
    news = t.raw_news.select("id", "source_id", "external_id", "published_at")
    keys = ["source_id", "external_id"]
    marked = I.mark_new(news, news.limit(0), keys)
    early = F.col("is_new") & (F.col("id") % 2 == 1)
    for part, rows in enumerate((marked.filter(early), marked.filter(~early))):
        rows.drop("is_new").select(*news.columns).write.parquet(f"{land}/poll={part}")
        s = J.file_source(spark, land, "parquet", schema=news.schema).select(*news.columns)
        J.stream_dedup(s, keys, target, ckpt)
    return J.appended(spark, target).select("id", "source_id", "external_id")


@register(
    "stream_result_stats",
    LEX_SQL + """,
r AS (SELECT sr.news_id, CAST(CASE sr.news_id % 3 WHEN 0 THEN sr.sentiment_score WHEN 1 THEN -s.sentiment_score ELSE s.sentiment_score END AS DECIMAL(5,4)) AS score,
             TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST(CASE WHEN sr.news_id % 3 = 0 THEN sr.news_id % 20 ELSE sr.news_id % 25 END AS INT) AS analyzed_at,
             CASE WHEN sr.news_id % 3 = 0 THEN sr.sentiment_label WHEN s.sentiment_score > 0.3 THEN 'positive'
                  WHEN s.sentiment_score < -0.3 THEN 'negative' ELSE 'neutral' END AS label
      FROM sentiment_results sr JOIN s ON s.id = sr.news_id)
SELECT CAST(analyzed_at AS DATE) AS stat_date, COUNT(*) AS news_count, CAST(SUM(score) AS DOUBLE) AS score_sum,
       COUNT(CASE WHEN label = 'positive' THEN 1 END) AS positive_count, COUNT(CASE WHEN label = 'neutral' THEN 1 END) AS neutral_count,
       COUNT(CASE WHEN label = 'negative' THEN 1 END) AS negative_count, CAST(SUM(score) AS DOUBLE) / COUNT(*) AS avg_sentiment
FROM r GROUP BY 1""",
    views=("raw_news", "lexicon", "sentiment_results"),
)
def q_stream_result_stats(spark, sf_dir):
    """Daily statistics under re-delivery: first scores and re-scores (version 2,
    another day, two news of three); then the first scores come again, and one
    re-score of two again with the sign turned.  Each result counts once, on the
    day of the row that stays."""
    t = Tables(spark, sf_dir)
    v1, v2 = first_and_second_scores(t)

    def day(n: int):
        return F.timestamp_add("DAY", F.col("news_id") % n, ts("2024-01-01 00:00:00")).alias("analyzed_at")

    def row(rows, n: int):
        return rows.select("news_id", F.col("sentiment_score").cast("decimal(5,4)").alias("sentiment_score"), "sentiment_label", "version", "created_at", day(n))

    again = v2.filter(F.col("news_id") % 3 == 1).withColumn("sentiment_score", -F.col("sentiment_score"))
    land, target, ckpt = (scratch_path(spark, n) for n in ("land-results", "result-stats", "ckpt-result-stats"))
    for part, rows in enumerate((row(v1, 20).unionByName(row(v2, 25)), row(v1, 20).unionByName(row(again, 25)))):
        rows.write.parquet(f"{land}/delivery={part}")
        stream = J.file_source(spark, land, "parquet", schema=rows.schema).select(*rows.columns)
        J.stream_result_stats(stream, "news_id", "version", target, ckpt)
    return J.result_stats(spark, target).select("stat_date", "news_count", "score_sum", "positive_count", "neutral_count", "negative_count",
                                                "avg_sentiment")
