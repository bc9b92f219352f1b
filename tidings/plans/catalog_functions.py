"""Registered scalar-function queries (C-1 .. C-13), each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C
from ..sources.fixtures import Tables, ts
from .registry import register

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


@register(
    "fn_label",
    """SELECT news_id,
       CASE WHEN sentiment_score > 0.3 THEN 'positive' WHEN sentiment_score < -0.3 THEN 'negative'
            WHEN sentiment_score IS NOT NULL THEN 'neutral' END AS label,
       CASE WHEN sentiment_score > 0.3 THEN '偏正面' WHEN sentiment_score < -0.3 THEN '偏负面' ELSE '中性' END AS label_text,
       CASE WHEN sentiment_score > 0 THEN 'positive' WHEN sentiment_score < 0 THEN 'negative' ELSE 'neutral' END AS sign_label
FROM scored_events""",
    views=("scored_events",),
)
def q_fn_label(spark, sf_dir):
    e = Tables(spark, sf_dir).scored_events
    s = F.col("sentiment_score")
    return e.select("news_id", C.label(s).alias("label"), C.label_text(s).alias("label_text"), C.sign_label(s).alias("sign_label"))


@register(
    "fn_day_hour_month",
    """SELECT news_id, CAST(analyzed_at AS DATE) AS day, date_trunc('hour', analyzed_at) AS hour,
       date_trunc('day', analyzed_at) AS day_start, CAST(strftime(analyzed_at, '%Y%m') AS INT) AS yyyymm,
       substring(CAST(analyzed_at AS VARCHAR), 1, 10) AS first10
FROM scored_events""",
    views=("scored_events",),
)
def q_fn_day_hour_month(spark, sf_dir):
    e = Tables(spark, sf_dir).scored_events
    a = F.col("analyzed_at")
    return e.select(
        "news_id", C.day(a).alias("day"), C.hour(a).cast("timestamp_ntz").alias("hour"),
        C.day_start(a).cast("timestamp_ntz").alias("day_start"), C.yyyymm(a).alias("yyyymm"),
        C.first10(a.cast("string")).alias("first10"),
    )


@register(
    "fn_interval",
    """SELECT news_id, analyzed_at + INTERVAL 5 MINUTE AS plus_5m, analyzed_at - INTERVAL 3 HOUR AS minus_3h,
       analyzed_at - INTERVAL 7 DAY AS minus_7d
FROM scored_events""",
    views=("scored_events",),
)
def q_fn_interval(spark, sf_dir):
    e = Tables(spark, sf_dir).scored_events
    a = F.col("analyzed_at")
    return e.select("news_id", C.plus_minutes(a, 5).alias("plus_5m"), C.plus_hours(a, -3).alias("minus_3h"),
                    C.minus_days(a, 7).alias("minus_7d"))


def feed_date_strings(events):
    """Feed-style date strings derived from event times, six shapes."""
    k = F.col("event_id") % 6
    raw = (
        F.when(k == 0, F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
        .when(k == 1, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" GMT")))
        .when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 3, F.concat(F.date_format("ts", "EEE, d MMM yyyy H:m:s"), F.lit(" GMT")))
        .when(k == 4, F.date_format("ts", "yyyy-M-d H:m:s"))
        .otherwise(F.lit(""))
    )
    return events.select("event_id", raw.alias("raw"))


@register(
    "fn_parse_date",
    f"""WITH s AS (
  SELECT event_id, CASE event_id % 6
      WHEN 0 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0000'
      WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' GMT'
      WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
      WHEN 3 THEN strftime(ts, '%a, ') || day(ts) || strftime(ts, ' %b %Y ') || hour(ts) || ':' || minute(ts) || ':' || second(ts) || ' GMT'
      WHEN 4 THEN year(ts) || '-' || month(ts) || '-' || day(ts) || ' ' || hour(ts) || ':' || minute(ts) || ':' || second(ts)
      ELSE '' END AS raw
  FROM events),
c AS (SELECT event_id, raw, substring(trim(split_part(split_part(raw, '+', 1), 'GMT', 1)), 1, 25) AS cleaned FROM s)
SELECT event_id, raw,
       COALESCE(CASE WHEN raw IS NOT NULL AND raw <> '' THEN COALESCE(
                  try_strptime(cleaned, '%a, %d %b %Y %H:%M:%S'),
                  try_strptime(cleaned, '%Y-%m-%d %H:%M:%S'),
                  try_strptime(cleaned, '%Y-%m-%dT%H:%M:%S')) END, {AS_OF}) AS published_at
FROM c""",
)
def q_fn_parse_date(spark, sf_dir):
    d = feed_date_strings(Tables(spark, sf_dir).events)
    return d.select("event_id", "raw", C.parse_feed_date("raw", ts("2024-01-31 00:00:00")).alias("published_at"))


@register(
    "fn_first_nonempty",
    """SELECT id,
       COALESCE(nullif(CASE WHEN id % 3 = 0 THEN '' ELSE external_id END, ''), url) AS guid,
       md5(COALESCE(nullif(CASE WHEN id % 4 = 0 THEN '' ELSE content END, ''), title)) AS body_md5,
       CASE id % 5 WHEN 0 THEN 'a' || id WHEN 1 THEN 'b' || id WHEN 2 THEN 'b' || id ELSE '' END AS author,
       COALESCE(CASE WHEN id % 7 > 1 THEN title END, url) AS summary
FROM raw_news""",
    views=("raw_news",),
)
def q_fn_first_nonempty(spark, sf_dir):
    n = Tables(spark, sf_dir).raw_news
    i, text = F.col("id"), F.col("id").cast("string")
    guid = F.when(i % 3 == 0, F.lit("")).otherwise(F.col("external_id"))
    body = F.when(i % 4 == 0, F.lit("")).otherwise(F.col("content"))
    # kinds: an author; '' or none with two authors; authors whose first is ''; no author at all
    author = F.when(i % 5 == 0, F.concat(F.lit("a"), text)).when(i % 5 == 1, F.lit(""))
    authors = F.when(i % 5 < 3, F.array(F.concat(F.lit("b"), text), F.lit("c"))).when(i % 5 == 3, F.array(F.lit(""), F.lit("c")))
    summary = F.when(i % 7 > 1, F.col("title")).when(i % 7 == 1, F.lit(""))
    return n.select("id", C.first_nonempty(guid, "url").alias("guid"), F.md5(C.first_nonempty(body, "title")).alias("body_md5"),
                    C.entry_author(author, authors).alias("author"), C.first_nonempty(summary, "url").alias("summary"))


@register(
    "fn_truncate",
    """SELECT id,
       CASE WHEN length(content) > 50 THEN substring(content, 1, 50) || '...' ELSE content END AS short_text,
       substring(title, 1, 20) AS cut_title,
       length(substring(content, 1, 500)) AS cut_len
FROM raw_news""",
    views=("raw_news",),
)
def q_fn_truncate(spark, sf_dir):
    n = Tables(spark, sf_dir).raw_news
    return n.select("id", C.truncate("content", 50).alias("short_text"), C.hard_cut("title", 20).alias("cut_title"),
                    F.length(C.hard_cut("content", 500)).alias("cut_len"))


@register(
    "fn_concat_text",
    "SELECT id, md5(concat_ws(' ', title, content)) AS text_md5, length(concat_ws(' ', title, content)) AS text_len FROM raw_news",
    views=("raw_news",),
)
def q_fn_concat_text(spark, sf_dir):
    n = Tables(spark, sf_dir).raw_news
    t = C.scoring_text("title", "content")
    return n.select("id", F.md5(t).alias("text_md5"), F.length(t).alias("text_len"))


@register(
    "fn_share",
    """SELECT sentiment_label, n, n / sum(n) OVER () AS share
FROM (SELECT sentiment_label, COUNT(*) AS n FROM scored_events GROUP BY sentiment_label) g""",
    views=("scored_events",),
)
def q_fn_share(spark, sf_dir):
    e = Tables(spark, sf_dir).scored_events
    g = e.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n"))
    # the grouped result has one row per label: the empty-partition window is tiny
    return g.select("sentiment_label", "n", C.share(g, "n").alias("share"))


@register(
    "fn_json_list",
    """SELECT id, CAST(to_json(string_split(content, ' ')) AS VARCHAR) AS keywords_json,
       len(string_split(content, ' ')) AS n_keywords
FROM raw_news""",
    views=("raw_news",),
)
def q_fn_json_list(spark, sf_dir):
    n = Tables(spark, sf_dir).raw_news
    js = C.to_json_list(C.tokens("content"))
    return n.select("id", js.alias("keywords_json")).select(
        "id", "keywords_json", F.size(C.json_list_lenient("keywords_json")).alias("n_keywords"))


def config_rows(events):
    """Typed configuration records derived from events: type by id, text by type."""
    k = F.col("event_id") % 5
    vtype = (F.when(k == 0, "integer").when(k == 1, "float").when(k == 2, "boolean").when(k == 3, "json").otherwise("string"))
    value = (
        F.when(k == 0, F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("user_id").cast("string")))
        .when(k == 1, F.concat(F.col("user_id").cast("string"), F.lit(".5")))
        .when(k == 2, F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"))
        .when(k == 3, F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.col("props")))
        .otherwise(F.col("event_type"))
    )
    return events.select(F.concat(F.lit("cfg."), F.col("event_id").cast("string")).alias("config_key"),
                         value.alias("config_value"), vtype.alias("value_type"))


@register(
    "fn_typed_config",
    """WITH c AS (
  SELECT 'cfg.' || CAST(event_id AS VARCHAR) AS config_key,
         CASE event_id % 5
           WHEN 0 THEN CASE WHEN event_type = 'error' THEN '' ELSE CAST(user_id AS VARCHAR) END
           WHEN 1 THEN CAST(user_id AS VARCHAR) || '.5'
           WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END
           WHEN 3 THEN CASE WHEN event_type = 'error' THEN '{broken' ELSE props END
           ELSE event_type END AS config_value,
         CASE event_id % 5 WHEN 0 THEN 'integer' WHEN 1 THEN 'float' WHEN 2 THEN 'boolean' WHEN 3 THEN 'json' ELSE 'string' END AS value_type
  FROM events)
SELECT config_key, config_value, value_type,
       CASE WHEN value_type = 'integer' THEN TRY_CAST(config_value AS BIGINT) END AS int_value,
       CASE WHEN value_type = 'float' THEN TRY_CAST(config_value AS DOUBLE) END AS float_value,
       CASE WHEN value_type = 'boolean' THEN TRY_CAST(config_value AS BOOLEAN) END AS bool_value,
       CASE WHEN value_type = 'json' THEN CASE WHEN json_valid(config_value) THEN config_value END END AS json_value,
       CASE WHEN value_type = 'string' THEN config_value END AS string_value,
       CASE WHEN value_type = 'integer' THEN COALESCE(TRY_CAST(config_value AS BIGINT), 90) END AS retention_days
FROM c""",
)
def q_fn_typed_config(spark, sf_dir):
    c = config_rows(Tables(spark, sf_dir).events)
    typed = C.typed_config("config_value", "value_type")
    return c.select(
        "config_key", "config_value", "value_type",
        *[v.alias(k) for k, v in typed.items()],
        F.when(F.col("value_type") == "integer", C.config_int("config_value", 90)).alias("retention_days"),
    )


@register(
    "fn_duration_ms",
    """WITH r AS (SELECT event_id, ts AS started_at,
     CASE WHEN event_type = 'error' THEN NULL
          ELSE ts + to_milliseconds(CAST(floor(value * 1000) AS BIGINT)) END AS completed_at FROM events)
SELECT event_id, started_at, completed_at,
       CASE WHEN started_at IS NOT NULL AND completed_at IS NOT NULL THEN (date_diff('microsecond', started_at, completed_at) * 2 + 1000) // 2000 END AS duration_ms
FROM r""",
)
def q_fn_duration_ms(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    done = F.when(F.col("event_type") == "error", F.lit(None).cast("timestamp_ntz")).otherwise(
        F.timestamp_add("MILLISECOND", F.floor(F.col("value") * 1000).cast("bigint"), F.col("ts")))
    r = e.select("event_id", F.col("ts").alias("started_at"), done.alias("completed_at"))
    return r.select("*", C.duration_ms("started_at", "completed_at").alias("duration_ms"))
