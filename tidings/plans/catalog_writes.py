"""Registered write-semantics queries (U-2 .. U-6, J-11, J-12, A-15, S-8, S-9,
W-1, D-12, D-16, D-18) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import scoring as G
from ..operators import stats as A
from ..operators import writes as W
from ..operators import rollups as R
from ..session import scratch_path
from ..sources import seeds as S
from ..sources.fixtures import Tables, ts
from .catalog_scoring import LEX_SQL
from .catalog_sectors import period_stats_sql
from .registry import register, sql_mean

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
T0 = "TIMESTAMP '2024-01-20 00:00:00'"


def _lexicon_results(t):
    s = G.lexicon_score(t.raw_news, t.lexicon)
    return s.select(F.col("id").alias("news_id"), "sentiment_score", "sentiment_label", "confidence")


@register(
    "upsert_last_wins",
    LEX_SQL + f"""
SELECT s.id AS news_id, s.sentiment_score,
       CASE WHEN s.sentiment_score > 0.3 THEN 'positive' WHEN s.sentiment_score < -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       s.confidence, 2 AS version,
       CASE WHEN sr.news_id IS NOT NULL THEN {T0} ELSE {AS_OF} END AS created_at
FROM s LEFT JOIN sentiment_results sr ON sr.news_id = s.id""",
    views=("raw_news", "lexicon", "sentiment_results"),
)
def q_upsert_last_wins(spark, sf_dir):
    """Stored results (version 1) re-scored for every news (version 2)."""
    t = Tables(spark, sf_dir)
    old = t.sentiment_results.select("news_id", "sentiment_score", "sentiment_label", "confidence",
                                     F.lit(1).alias("version"), ts("2024-01-20 00:00:00").alias("created_at"))
    new = _lexicon_results(t).select("*", F.lit(2).alias("version"), ts("2024-01-31 00:00:00").alias("created_at"))
    return W.upsert_last_wins(old, new, "news_id", "version")


@register(
    "touch_updated_at",
    LEX_SQL + f"""
SELECT sr.news_id, s.sentiment_score,
       CASE WHEN s.sentiment_score > 0.3 THEN 'positive' WHEN s.sentiment_score < -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       CASE WHEN s.sentiment_score = sr.sentiment_score
                 AND (CASE WHEN s.sentiment_score > 0.3 THEN 'positive' WHEN s.sentiment_score < -0.3 THEN 'negative' ELSE 'neutral' END) = sr.sentiment_label
            THEN {T0} ELSE {AS_OF} END AS updated_at
FROM sentiment_results sr JOIN s ON s.id = sr.news_id""",
    views=("raw_news", "lexicon", "sentiment_results"),
)
def q_touch_updated_at(spark, sf_dir):
    t = Tables(spark, sf_dir)
    old = t.sentiment_results.select("news_id", "sentiment_score", "sentiment_label", ts("2024-01-20 00:00:00").alias("updated_at"))
    new = _lexicon_results(t).join(old.select("news_id"), "news_id", "left_semi").select("news_id", "sentiment_score", "sentiment_label")
    return W.touch_updated_at(old, new, "news_id", ["sentiment_score", "sentiment_label"], ts("2024-01-31 00:00:00"))


@register(
    "update_by_key",
    LEX_SQL + """,
store AS (SELECT rn.id, COALESCE(sr.sentiment_score, CAST(0 AS DECIMAL(5,4))) AS sentiment_score,
                 COALESCE(sr.sentiment_label, '') AS sentiment_label, '[]' AS keywords, sr.news_id IS NOT NULL AS analyzed
          FROM raw_news rn LEFT JOIN sentiment_results sr ON sr.news_id = rn.id),
upd AS (SELECT s.id, s.sentiment_score,
               CASE WHEN s.sentiment_score > 0.3 THEN 'positive' WHEN s.sentiment_score < -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
               CAST(to_json(string_split(rn.content, ' ')) AS VARCHAR) AS keywords
        FROM s JOIN raw_news rn ON rn.id = s.id WHERE s.id NOT IN (SELECT news_id FROM sentiment_results))
SELECT st.id,
       CASE WHEN u.id IS NOT NULL THEN u.sentiment_score ELSE st.sentiment_score END AS sentiment_score,
       CASE WHEN u.id IS NOT NULL THEN u.sentiment_label ELSE st.sentiment_label END AS sentiment_label,
       CASE WHEN u.id IS NOT NULL THEN u.keywords ELSE st.keywords END AS keywords,
       CASE WHEN u.id IS NOT NULL THEN true ELSE st.analyzed END AS analyzed
FROM store st LEFT JOIN upd u ON u.id = st.id""",
    views=("raw_news", "lexicon", "sentiment_results"),
)
def q_update_by_key(spark, sf_dir):
    """Minimal store updated with scores for the rows not analysed yet."""
    t = Tables(spark, sf_dir)
    sr = t.sentiment_results.select(F.col("news_id").alias("id"), "sentiment_score", "sentiment_label")
    store = t.raw_news.select("id").join(sr, "id", "left").select(
        "id", F.coalesce("sentiment_score", F.lit(0).cast("decimal(5,4)")).alias("sentiment_score"),
        F.coalesce("sentiment_label", F.lit("")).alias("sentiment_label"), F.lit("[]").alias("keywords"),
        F.col("sentiment_label").isNotNull().alias("analyzed"))
    unscored = t.raw_news.join(sr.select("id"), "id", "left_anti")
    upd = G.lexicon_score(unscored, t.lexicon).join(
        unscored.select("id", C.to_json_list(C.tokens("content")).alias("keywords")), "id").select(
        "id", "sentiment_score", "sentiment_label", "keywords", F.lit(True).alias("analyzed"))
    return W.update_by_key(store, upd, "id", ["sentiment_score", "sentiment_label", "keywords", "analyzed"])


# the stored news of the purges: times spread over three months
STORED = "(SELECT id, published_at - to_days(CAST(id % 3 * 25 AS INT)) AS published_at FROM raw_news)"
KEEP = f"(published_at IS NULL OR published_at >= {AS_OF} - INTERVAL 20 DAY)"
GONE = f"(SELECT id FROM {STORED} x WHERE NOT {KEEP})"


def _purged(spark, sf_dir):
    """News, results and sector links stored by the news' month, then purged in
    place of all news older than 20 days."""
    t = Tables(spark, sf_dir)
    news = t.raw_news.select("id", F.timestamp_add("DAY", -(F.col("id") % 3 * 25), F.col("published_at")).alias("published_at"))
    month = news.select(F.col("id").alias("news_id"), "published_at")
    paths = {n: scratch_path(spark, f"stored-{n}") for n in ("raw_news", "sentiment_results", "news_sectors")}
    W.write_by_month(news, paths["raw_news"], "published_at")
    for n in ("sentiment_results", "news_sectors"):
        W.write_by_month(getattr(t, n).join(month, "news_id"), paths[n], "published_at")
    cutoff = F.timestamp_add("DAY", F.lit(-20), ts("2024-01-31 00:00:00"))
    log = W.purge_stored(spark, paths["raw_news"], "published_at", cutoff,
                         {n: (paths[n], "news_id") for n in ("sentiment_results", "news_sectors")})
    return paths, log


@register("retention_purge", f"SELECT id, published_at FROM {STORED} x WHERE {KEEP}", views=("raw_news",))
def q_retention_purge(spark, sf_dir):
    paths, _ = _purged(spark, sf_dir)
    return spark.read.parquet(paths["raw_news"]).select("id", "published_at")


@register(
    "cascade_purge",
    f"SELECT ns.news_id, ns.sector_id, ns.is_primary FROM news_sectors ns WHERE ns.news_id NOT IN {GONE}",
    views=("raw_news", "news_sectors"),
)
def q_cascade_purge(spark, sf_dir):
    paths, _ = _purged(spark, sf_dir)
    return spark.read.parquet(paths["news_sectors"]).select("news_id", "sector_id", "is_primary")


@register(
    "affected_rows",
    f"""SELECT 'raw_news' AS table_name, COUNT(*) AS records_processed FROM {GONE} g
UNION ALL
SELECT 'sentiment_results', COUNT(*) FROM sentiment_results WHERE news_id IN {GONE}
UNION ALL
SELECT 'news_sectors', COUNT(*) FROM news_sectors WHERE news_id IN {GONE}""",
    views=("raw_news", "sentiment_results", "news_sectors"),
)
def q_affected_rows(spark, sf_dir):
    """Rows removed, as the purge's own writes counted them."""
    _, log = _purged(spark, sf_dir)
    return log.select("table_name", "records_processed")


@register(
    "set_null_purge",
    "SELECT id, CASE WHEN source_id IN (3, 7) THEN NULL ELSE source_id END AS source_id, title FROM raw_news",
    views=("raw_news",),
)
def q_set_null_purge(spark, sf_dir):
    t = Tables(spark, sf_dir)
    kept_sources = t.news_sources.filter(~F.col("name").isin("src3", "src7"))
    return W.set_null_purge(t.raw_news.select("id", "source_id", "title"), kept_sources)


@register(
    "rollup_retention",
    f"""WITH d AS ({period_stats_sql("CAST(published_at AS DATE)", "stat_date")}),
h AS ({period_stats_sql("date_trunc('hour', published_at)", "stat_time")}),
r AS (SELECT 'raw_news' AS table_name, CAST(id AS VARCHAR) AS row_key, published_at AS ts, 20 AS days FROM raw_news
      UNION ALL SELECT 'daily_sector_stats', CAST(sector_id AS VARCHAR), CAST(stat_date AS TIMESTAMP), 25 FROM d
      UNION ALL SELECT 'hourly_sector_stats', CAST(sector_id AS VARCHAR), stat_time, 25 FROM h
      UNION ALL SELECT 'job_logs', CAST(event_id AS VARCHAR), ts, 30 FROM events)
SELECT table_name, row_key, ts FROM r WHERE ts IS NULL OR ts >= {AS_OF} - to_days(days)""",
    views=("raw_news", "sentiment_results", "news_sectors", "market_sectors"),
)
def q_rollup_retention(spark, sf_dir):
    """What is left of each table after a purge by the configured days: the
    seed configuration with shorter times (the fixture spans 30 days), run
    logs at the seed's 30."""
    t = Tables(spark, sf_dir)
    days = {"data_retention_days": "20", "aggregated_data_retention_days": "25"}
    config = S.seed_configs(spark).withColumn("config_value", F.coalesce(
        *[F.when(F.col("config_key") == k, v) for k, v in days.items()], "config_value"))
    kept = W.purge_by_config({
        "raw_news": (t.raw_news.select(F.col("id").alias("k"), F.col("published_at").alias("ts")), "ts", "data_retention_days"),
        "daily_sector_stats": (R.daily_sector_stats(t).select(F.col("sector_id").alias("k"), F.col("stat_date").cast("timestamp_ntz").alias("ts")),
                               "ts", "aggregated_data_retention_days"),
        "hourly_sector_stats": (R.hourly_sector_stats(t).select(F.col("sector_id").alias("k"), F.col("stat_time").alias("ts")),
                                "ts", "aggregated_data_retention_days"),
        "job_logs": (t.events.select(F.col("event_id").alias("k"), "ts"), "ts", "log_retention_days"),
    }, config, ts("2024-01-31 00:00:00"))
    out = None
    for name, df in kept.items():
        x = df.select(F.lit(name).alias("table_name"), F.col("k").cast("string").alias("row_key"), "ts")
        out = x if out is None else out.unionByName(x)
    return out


@register(
    "partitioned_fact_sink",
    """SELECT news_id, source_name, sentiment_score, sentiment_label, date, CAST(strftime(date, '%Y%m') AS INT) AS yyyymm
FROM (SELECT *, CAST(analyzed_at AS DATE) - CAST(news_id % 3 * 25 AS INT) AS date FROM scored_events) e""",
    views=("scored_events",),
)
def q_partitioned_fact_sink(spark, sf_dir):
    """Append the wide fact by month (the events, spread over three months) and
    read the whole sink back."""
    e = Tables(spark, sf_dir).scored_events
    date = F.date_sub(C.day("analyzed_at"), (F.col("news_id") % 3 * 25).cast("int"))
    fact = e.select("news_id", "source_name", "sentiment_score", "sentiment_label", date.alias("date"))
    path = scratch_path(spark, "news_sentiment")
    W.write_partitioned_fact(fact, path)
    return spark.read.parquet(path).select("news_id", "source_name", "sentiment_score", "sentiment_label", "date", "yyyymm")


@register(
    "stats_snapshot_sink",
    f"""SELECT 'stats:24h' AS cache_key, COUNT(*) AS total,
       CAST(round(COALESCE({sql_mean('sr.sentiment_score')}, 0), 6) AS DECIMAL(12,6)) AS avg_sentiment,
       COUNT(*) FILTER (sr.sentiment_label = 'positive') AS positive, COUNT(*) FILTER (sr.sentiment_label = 'neutral') AS neutral,
       COUNT(*) FILTER (sr.sentiment_label = 'negative') AS negative, '2024-01-30T12:00:00Z' AS value_updated_at,
       TIMESTAMP '2024-01-30 12:00:00' AS updated_at, TIMESTAMP '2024-01-30 13:00:00' AS expires_at
FROM raw_news rn LEFT JOIN sentiment_results sr ON rn.id = sr.news_id
WHERE rn.published_at >= TIMESTAMP '2024-01-29 12:00:00'""",
    views=("raw_news", "sentiment_results"),
)
def q_stats_snapshot_sink(spark, sf_dir):
    """Write the 24h stats snapshot (1h time to live), read it back 30 minutes later."""
    t = Tables(spark, sf_dir)
    snap = W.stats_snapshot(A.stats_24h(t, as_of="2024-01-30 12:00:00"), ts("2024-01-30 12:00:00"))
    path = scratch_path(spark, "stats_snapshot")
    snap.write.mode("overwrite").parquet(path)
    got = W.read_snapshot(spark.read.parquet(path), "stats:24h", ts("2024-01-30 12:30:00"))
    v = F.from_json("value", "total long, avg_sentiment decimal(12,6), positive long, neutral long, negative long, updated_at string")
    return got.select("cache_key", v.alias("v"), "updated_at", "expires_at").select(
        "cache_key", "v.total", "v.avg_sentiment", "v.positive", "v.neutral", "v.negative",
        F.col("v.updated_at").alias("value_updated_at"), "updated_at", "expires_at")


def job_log(t):
    """Run-log records derived from events: views/clicks start runs, other
    events finish (errors fail) the open runs of their job."""
    e = t.events
    odd = F.col("event_id") % 10
    status = (F.when((F.col("event_type") == "click") & (odd == 3), "pending").when((F.col("event_type") == "click") & (odd == 4), "cancelled")
              .when((F.col("event_type") == "click") & (odd == 5), F.lit(None))
              .when(F.col("event_type").isin("view", "click"), "running")
              .when(F.col("event_type") == "error", "failed").otherwise("success"))
    return e.select(
        F.col("event_id").alias("run_id"), F.concat(F.lit("job_"), (F.col("user_id") % 4).cast("string")).alias("job_name"),
        F.col("ts").alias("event_time"), status.alias("status"),
        F.when(status == "success", F.floor("value").cast("int")).alias("records_processed"),
        F.when(status == "failed", F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("error_message"))


@register(
    "job_log_fold",
    """WITH log AS (
  SELECT event_id AS run_id, 'job_' || CAST(user_id % 4 AS VARCHAR) AS job_name, ts AS event_time,
         CASE WHEN event_type = 'click' AND event_id % 10 = 3 THEN 'pending' WHEN event_type = 'click' AND event_id % 10 = 4 THEN 'cancelled'
              WHEN event_type = 'click' AND event_id % 10 = 5 THEN NULL WHEN event_type IN ('view', 'click') THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         CASE WHEN event_type NOT IN ('view', 'click', 'error') THEN CAST(floor(value) AS INT) END AS records_processed,
         CASE WHEN event_type = 'error' THEN 'error ' || CAST(event_id AS VARCHAR) END AS error_message
  FROM events),
s AS (SELECT * FROM log WHERE status IS NULL OR status NOT IN ('success', 'failed')),
f AS (SELECT * FROM log WHERE status IN ('success', 'failed')),
m AS (SELECT s.run_id, s.job_name, s.event_time AS started_at, s.status AS own,
             min(f.event_time) AS c_time,
             arg_min({'s': f.status, 'r': f.records_processed, 'e': f.error_message}, f.event_time) AS c
      FROM s LEFT JOIN f ON f.job_name = s.job_name AND f.event_time >= s.event_time AND coalesce(s.status, 'running') = 'running'
      GROUP BY 1, 2, 3, 4)
SELECT run_id, job_name, started_at, COALESCE(c.s, own, 'running') AS status, c_time AS completed_at,
       CASE WHEN c_time IS NOT NULL THEN (date_diff('microsecond', started_at, c_time) * 2 + 1000) // 2000 END AS duration_ms,
       COALESCE(c.r, 0) AS records_processed, c.e AS error_message
FROM m""",
)
def q_job_log_fold(spark, sf_dir):
    return W.job_log_fold(job_log(Tables(spark, sf_dir)))


def analyzed_results(t):
    """Sentiment results with an analysis time after publication."""
    n = t.raw_news.select(F.col("id").alias("news_id"), "published_at")
    lag = F.col("news_id") % 120 * 60 + F.col("news_id") % 7
    return t.sentiment_results.join(n, "news_id").select(
        "news_id", F.timestamp_add("SECOND", lag, F.col("published_at")).alias("analyzed_at"))


@register(
    "processing_lag",
    """WITH l AS (SELECT date_diff('second', rn.published_at, rn.published_at + to_seconds(CAST(sr.news_id % 120 * 60 + sr.news_id % 7 AS BIGINT))) AS lag_s
           FROM sentiment_results sr JOIN raw_news rn ON rn.id = sr.news_id WHERE rn.published_at IS NOT NULL)
SELECT COUNT(*) AS n, SUM(lag_s) / (COUNT(*) * 60.0) AS mean_lag_min,
       quantile_cont(lag_s, 0.5) / 60.0 AS median_lag_min, quantile_cont(lag_s, 0.95) / 60.0 AS p95_lag_min
FROM l""",
    views=("raw_news", "sentiment_results"),
)
def q_processing_lag(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return W.processing_lag(t.raw_news, analyzed_results(t))


def emotion_json(t):
    sr = t.sentiment_results
    s = F.col("sentiment_score").cast("double")
    m = F.create_map(F.lit("joy"), F.greatest(s, F.lit(0.0)), F.lit("fear"), F.greatest(-s, F.lit(0.0)),
                     F.lit("surprise"), F.col("confidence").cast("double") - 0.5)
    return sr.select("news_id", F.to_json(m).alias("emotions"))


EMOTION_ROWS = """WITH e AS (SELECT news_id, CAST(sentiment_score AS DOUBLE) AS s, CAST(confidence AS DOUBLE) AS c FROM sentiment_results),
r AS (SELECT news_id, 'joy' AS emotion, greatest(s, 0.0) AS score FROM e
      UNION ALL SELECT news_id, 'fear', greatest(-s, 0.0) FROM e
      UNION ALL SELECT news_id, 'surprise', c - 0.5 FROM e)"""


@register("emotion_breakdown", EMOTION_ROWS + """
SELECT emotion, COUNT(*) AS n, AVG(score) AS avg_score FROM r GROUP BY 1""", views=("sentiment_results",))
def q_emotion_breakdown(spark, sf_dir):
    per_emotion, _ = W.emotion_breakdown(emotion_json(Tables(spark, sf_dir)))
    return per_emotion


@register("emotion_strongest", EMOTION_ROWS + """,
k AS (SELECT news_id, emotion, score, row_number() OVER (PARTITION BY news_id ORDER BY score DESC, emotion DESC) AS rk FROM r)
SELECT news_id, emotion AS top_emotion, score AS top_score FROM k WHERE rk = 1""", views=("sentiment_results",))
def q_emotion_strongest(spark, sf_dir):
    _, strongest = W.emotion_breakdown(emotion_json(Tables(spark, sf_dir)))
    return strongest
