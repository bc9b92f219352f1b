"""Registered ingestion queries (S-1 .. S-6, S-10, S-11, T-1, U-1, J-9, J-13,
A-14, F-14, D-13, D-14, D-17) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import core as C
from ..operators import ingest as I
from ..operators import sectors as G
from ..session import scratch_path
from ..sources import seeds as D
from ..sources.fixtures import Tables, ts
from .registry import register

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
CUT = "TIMESTAMP '2024-01-15 00:00:00'"


def feed_entries(t):
    """Feed entries derived from the news fixture (one feed per source)."""
    n = t.raw_news.join(t.news_sources.select(F.col("id").alias("source_id"), F.col("name").alias("src")), "source_id", "left")
    return n.select(
        F.coalesce("src", F.lit("unknown")).alias("feed"),
        F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("external_id")).alias("guid"),
        "title", F.col("url").alias("link"), F.col("title").alias("description"),
        F.when(F.col("id") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("content")).alias("content"),
        F.when(F.col("id") % 6 < 2, F.concat(F.lit("author "), F.col("id").cast("string"))).alias("author"),
        F.concat(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("pubDate"),
        F.when(F.col("id") % 5 == 0, "atom").when(F.col("id") % 5 == 1, "json").otherwise("rss").alias("format"),
        F.floor(F.col("id") / 500).alias("payload"),
    )


@register(
    "feed_items_scan",
    f"""SELECT COALESCE(src.name, 'unknown') AS feed,
       COALESCE(nullif(CASE WHEN rn.id % 3 = 0 THEN '' ELSE rn.external_id END, ''), rn.url) AS guid,
       rn.title, rn.url AS link, rn.title AS description,
       md5(COALESCE(nullif(CASE WHEN rn.id % 4 = 0 THEN NULL ELSE rn.content END, ''), rn.title)) AS content_md5,
       CASE WHEN rn.id % 6 < 2 THEN 'author ' || CAST(rn.id AS VARCHAR) ELSE '' END AS author,
       COALESCE(date_trunc('second', rn.published_at), {AS_OF}) AS published
FROM raw_news rn LEFT JOIN news_sources src ON rn.source_id = src.id""",
    views=("raw_news", "news_sources"),
)
def q_feed_items_scan(spark, sf_dir):
    """RSS payloads, and Atom and JSON Feed payloads for every fifth entry each."""
    t = Tables(spark, sf_dir)
    path = scratch_path(spark, "feeds")
    entries = feed_entries(t)
    of = lambda name: entries.filter(F.col("format") == name).drop("format")
    I.write_feed_files(of("rss").drop("payload"), path)
    I.write_atom_files(of("atom").drop("payload"), path)
    I.write_json_feed_files(of("json"), path, "payload")
    items = I.read_feed_items(spark, path, ts("2024-01-31 00:00:00"))
    return items.select("feed", "guid", "title", "link", "description", F.md5("content").alias("content_md5"), "author", "published")


@register(
    "feed_items_topn",
    """SELECT source_id AS feed, id AS pos, title FROM (
  SELECT source_id, id, title, row_number() OVER (PARTITION BY source_id ORDER BY id) AS rn FROM raw_news) x
WHERE rn <= 20""",
    views=("raw_news",),
)
def q_feed_items_topn(spark, sf_dir):
    n = Tables(spark, sf_dir).raw_news.select(F.col("source_id").alias("feed"), F.col("id").alias("pos"), "title")
    return I.limit_per_feed(n, 20, "feed", "pos")


@register(
    "page_items_scan",
    """WITH clean AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                                  '(?is)<(script)[^>]*>.*?</script *>|<style[^>]*>.*?</style *>', '', 'g') AS h FROM pages),
t AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') AS origin,
             regexp_extract(h, '(?is)<title[^>]*>(.*?)</title *>', 1) AS raw_title, regexp_extract(h, '(?i)<html[^>]* lang="([^"]*)"', 1) AS lang,
             list_transform(regexp_extract_all(h, '(?is)<[a-z][^>]* href="[^"]*"'), lambda x: regexp_extract(x, '(?is) href="([^"]*)"$', 1)) AS hrefs
      FROM clean)
SELECT page_id, url, host, replace(replace(replace(replace(replace(raw_title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS title,
       lang, list_transform(hrefs, lambda x: CASE WHEN x LIKE '/%' AND x NOT LIKE '//%' THEN origin || replace(x, '&amp;', '&') ELSE replace(x, '&amp;', '&') END) AS links,
       len(hrefs) AS n_links
FROM t""",
)
def q_page_items_scan(spark, sf_dir):
    return I.extract_pages(Tables(spark, sf_dir).pages)


def messages(t):
    """Scored-news messages (JSON) as the scorer publishes them; of 50 five are
    broken: no JSON, a wrong type, no object (twice), a bad time."""
    src = t.news_sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    sr = t.sentiment_results
    n = t.raw_news.join(src, "source_id", "left").join(sr.withColumnRenamed("news_id", "id"), "id")
    fmt = "yyyy-MM-dd HH:mm:ss"
    original = F.struct(
        F.col("id").alias("id"), "title", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("summary"),
        "url", F.lit(None).cast("string").alias("author"), F.col("source_id").cast("long").alias("source_id"), "source_name",
        F.date_format("published_at", fmt).alias("published_at"), F.lit(None).cast("string").alias("collected_at"))
    msg = F.to_json(F.struct(
        F.col("id").alias("news_id"), F.col("sentiment_score").cast("double").alias("sentiment_score"), "sentiment_label",
        F.col("confidence").cast("double").alias("confidence"), F.array().cast("array<string>").alias("entities"),
        C.tokens("title").alias("keywords"), "market_impact_score", original.alias("original_data"),
        F.when(F.col("id") % 50 == 4, "garbage").otherwise(
            F.date_format(F.timestamp_add("MINUTE", F.lit(5), F.col("published_at")), fmt)).alias("analyzed_at")))
    value = F.coalesce(*[F.when(F.col("id") % 50 == i, F.lit(v)) for i, v in enumerate(("not json {", '{"news_id": "abc"}', "[1, 2]", "5"))], msg)
    return n.select(F.col("id").cast("string").alias("key"), value.alias("value"))


MSG_BASE = """SELECT rn.id, rn.title, rn.url, src.name AS source_name, date_trunc('second', rn.published_at) AS published_at,
       CAST(sr.sentiment_score AS DOUBLE) AS sentiment_score, sr.sentiment_label, CAST(sr.confidence AS DOUBLE) AS confidence,
       sr.market_impact_score, date_trunc('second', rn.published_at) + INTERVAL 5 MINUTE AS analyzed_at,
       rn.id % 50 <= 4 AS is_corrupt
FROM raw_news rn LEFT JOIN news_sources src ON rn.source_id = src.id JOIN sentiment_results sr ON sr.news_id = rn.id"""


@register(
    "json_message_scan",
    f"""SELECT CAST(id AS VARCHAR) AS key, is_corrupt,
       CASE WHEN NOT is_corrupt THEN id END AS news_id,
       CASE WHEN NOT is_corrupt THEN sentiment_score END AS sentiment_score,
       CASE WHEN NOT is_corrupt THEN sentiment_label END AS sentiment_label,
       CASE WHEN NOT is_corrupt THEN market_impact_score END AS market_impact_score,
       CASE WHEN NOT is_corrupt THEN title END AS title
FROM ({MSG_BASE}) m""",
    views=("raw_news", "news_sources", "sentiment_results"),
)
def q_json_message_scan(spark, sf_dir):
    p = I.parse_messages(messages(Tables(spark, sf_dir)), S.SENTIMENT_MESSAGE)
    return p.select("key", "is_corrupt", "news_id", "sentiment_score", "sentiment_label", "market_impact_score",
                    F.col("original_data.title").alias("title"))


@register(
    "message_flatten",
    f"""SELECT id AS news_id, title, url, source_name, published_at, sentiment_score, sentiment_label, confidence,
       market_impact_score, analyzed_at FROM ({MSG_BASE}) m WHERE NOT is_corrupt""",
    views=("raw_news", "news_sources", "sentiment_results"),
)
def q_message_flatten(spark, sf_dir):
    p = I.parse_messages(messages(Tables(spark, sf_dir)), S.SENTIMENT_MESSAGE)
    return I.flatten_message(p.filter(~F.col("is_corrupt")))


MSG_JSON = """CAST(to_json({'id': id, 'source_id': source_id, 'external_id': external_id, 'title': title, 'url': url,
                      'published_at': strftime(published_at, '%Y-%m-%d %H:%M:%S.%f')}) AS VARCHAR)"""


@register("json_message_sink", f"SELECT CAST(id AS VARCHAR) AS key, {MSG_JSON} AS value FROM raw_news", views=("raw_news",))
def q_json_message_sink(spark, sf_dir):
    n = Tables(spark, sf_dir).raw_news.select("id", "source_id", "external_id", "title", "url", "published_at")
    return I.to_messages(n, "id")


@register(
    "raw_payload_column",
    f"SELECT id, source_id, external_id, title, url, published_at, {MSG_JSON} AS raw_data FROM raw_news",
    views=("raw_news",),
)
def q_raw_payload_column(spark, sf_dir):
    n = Tables(spark, sf_dir).raw_news.select("id", "source_id", "external_id", "title", "url", "published_at")
    return I.raw_payload(n)


@register(
    "union_feeds",
    "SELECT language AS feed, id, title FROM raw_news",
    views=("raw_news",),
)
def q_union_feeds(spark, sf_dir):
    return I.tag_feeds(Tables(spark, sf_dir).raw_news, "language").select("feed", "id", "title")


SPLIT = f"""s AS (SELECT id, source_id, external_id FROM raw_news WHERE published_at < {CUT}),
i AS (SELECT id, source_id, external_id FROM raw_news WHERE published_at >= {CUT} OR published_at IS NULL)"""


@register(
    "anti_join_existing",
    f"""WITH {SPLIT}
SELECT i.id FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source_id = i.source_id AND s.external_id = i.external_id)""",
    views=("raw_news",),
)
def q_anti_join_existing(spark, sf_dir):
    n = Tables(spark, sf_dir).raw_news.select("id", "source_id", "external_id", "published_at")
    cut = F.col("published_at") < ts("2024-01-15 00:00:00")
    stored, incoming = n.filter(cut), n.filter(~cut | F.col("published_at").isNull())
    return I.anti_join_existing(incoming, stored, ["source_id", "external_id"]).select("id")


@register(
    "insert_or_ignore",
    f"""WITH {SPLIT},
d AS (SELECT * FROM i WHERE source_id IS NULL OR external_id IS NULL
      OR id = (SELECT min(i2.id) FROM i i2 WHERE i2.source_id = i.source_id AND i2.external_id = i.external_id)),
new AS (SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source_id = d.source_id AND s.external_id = d.external_id))
SELECT id, source_id, external_id FROM s UNION ALL SELECT id, source_id, external_id FROM new""",
    views=("raw_news",),
)
def q_insert_or_ignore(spark, sf_dir):
    n = Tables(spark, sf_dir).raw_news.select("id", "source_id", "external_id", "published_at")
    cut = F.col("published_at") < ts("2024-01-15 00:00:00")
    stored = n.filter(cut).drop("published_at")
    incoming = n.filter(~cut | F.col("published_at").isNull()).drop("published_at")
    return I.insert_or_ignore(stored, incoming, ["source_id", "external_id"], "id")


@register(
    "ingest_counts",
    f"""WITH {SPLIT.replace('SELECT id, source_id, external_id FROM raw_news WHERE published_at >=', 'SELECT id, source_id, external_id, language FROM raw_news WHERE published_at >=')},
m AS (SELECT i.*, (i.source_id IS NULL OR i.external_id IS NULL
                   OR i.id = (SELECT min(i2.id) FROM i i2 WHERE i2.source_id = i.source_id AND i2.external_id = i.external_id))
                  AND NOT EXISTS (SELECT 1 FROM s WHERE s.source_id = i.source_id AND s.external_id = i.external_id) AS is_new
      FROM i)
SELECT language AS feed, COUNT(*) AS fetched, COUNT(CASE WHEN is_new THEN 1 END) AS saved FROM m GROUP BY ROLLUP (language)""",
    views=("raw_news",),
)
def q_ingest_counts(spark, sf_dir):
    from ..operators import stats as A

    n = Tables(spark, sf_dir).raw_news.select("id", "source_id", "external_id", "published_at", F.col("language").alias("feed"))
    cut = F.col("published_at") < ts("2024-01-15 00:00:00")
    return A.ingest_counts(n.filter(~cut | F.col("published_at").isNull()), n.filter(cut), "feed")


def candidate_results(t):
    """Scorer output candidates from events, before validation (unclamped)."""
    e = t.events
    score = ((F.col("value") - 50) / 50).cast("decimal(10,4)")
    lab = F.when(F.col("event_type") == "error", F.lit("unknown")).otherwise(C.label(score))
    return e.select(
        F.when(F.col("event_type") != "purchase", F.col("event_id")).alias("news_id"),
        score.alias("sentiment_score"), lab.alias("sentiment_label"),
        (F.col("value") / 100).cast("decimal(10,4)").alias("confidence"),
        F.regexp_replace(F.regexp_replace("props", r'\{"k": ', ""), r"\}", "").cast("int").alias("market_impact_score"),
        F.col("event_id").alias("event_id"),
    )


def dimension_candidates(t):
    """Source, bridge, trend, config and run-log rows, some outside their domains."""
    e, kind = t.events, F.col("event_id") % 7
    pick = lambda vals: F.get(F.array(*[F.lit(v).cast("string") for v in vals]), kind.cast("int"))
    return {
        "news_sources": (t.raw_news.select(
            F.col("id").alias("row_id"), F.lit("s").alias("name"), F.when(F.col("id") % 11 != 0, F.col("url")).alias("url"),
            F.get(F.array(*[F.lit(v) for v in (*S.SOURCE_TYPES, "ftp")]), (F.col("id") % 5).cast("int")).alias("type"),
            F.when(F.col("id") % 2 == 0, "active").when(F.col("id") % 3 == 0, "asleep").alias("status")), I.source_checks()),
        "news_sectors": (t.news_sectors.filter("is_primary").select(
            F.col("news_id").alias("row_id"), (F.col("sector_id") / 16).alias("relevance_score")), I.bridge_checks()),
        "daily_stats": (e.select(F.col("event_id").alias("row_id"), F.when(F.col("event_id") % 13 != 0, C.day("ts")).alias("stat_date"),
                                 pick((*S.TREND_LABELS, "up", None, "")).alias("sentiment_trend")), I.trend_checks()),
        "system_configs": (e.select(F.col("event_id").alias("row_id"), F.col("event_type").alias("config_key"),
                                    F.when(F.col("event_id") % 13 != 0, F.col("props")).alias("config_value"),
                                    pick((*S.CONFIG_TYPES, "date", None)).alias("value_type")), I.config_checks()),
        "job_logs": (e.select(F.col("event_id").alias("row_id"), F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("job_name"),
                              pick((*S.JOB_STATUSES, "done", None)).alias("status")), I.job_checks()),
    }


@register(
    "validate_rows",
    """WITH c AS (
  SELECT event_id, CASE WHEN event_type <> 'purchase' THEN event_id END AS news_id,
         CAST((value - 50) / 50 AS DECIMAL(10,4)) AS s, CAST(value / 100 AS DECIMAL(10,4)) AS conf,
         CAST(replace(replace(props, '{"k": ', ''), '}', '') AS INT) AS imp, event_type
  FROM events),
l AS (SELECT *, CASE WHEN event_type = 'error' THEN 'unknown'
                     WHEN s > 0.3 THEN 'positive' WHEN s < -0.3 THEN 'negative' WHEN s IS NOT NULL THEN 'neutral' END AS lab FROM c),
r AS (
SELECT 'sentiment_results' AS table_name, event_id AS row_id,
       [CASE WHEN news_id IS NULL THEN 'news_id_null' END, CASE WHEN NOT COALESCE(s BETWEEN -1 AND 1, false) THEN 'score_range' END,
        CASE WHEN NOT COALESCE(conf BETWEEN 0 AND 1, false) THEN 'confidence_range' END,
        CASE WHEN imp NOT BETWEEN 0 AND 100 THEN 'impact_range' END,
        CASE WHEN NOT COALESCE(lab IN ('positive', 'neutral', 'negative'), false) THEN 'label_enum' END] AS failed FROM l
UNION ALL
SELECT 'news_sources', id, [CASE WHEN id % 11 = 0 THEN 'url_null' END, CASE WHEN id % 5 = 4 THEN 'type_enum' END,
                            CASE WHEN id % 2 <> 0 AND id % 3 = 0 THEN 'status_enum' END] FROM raw_news
UNION ALL
SELECT 'news_sectors', news_id, [CASE WHEN sector_id > 16 THEN 'relevance_range' END] FROM news_sectors WHERE is_primary
UNION ALL
SELECT 'daily_stats', event_id, [CASE WHEN event_id % 13 = 0 THEN 'stat_date_null' END, CASE WHEN event_id % 7 IN (4, 6) THEN 'trend_enum' END] FROM events
UNION ALL
SELECT 'system_configs', event_id, [CASE WHEN event_id % 13 = 0 OR props IS NULL THEN 'value_null' END, CASE WHEN event_id % 7 = 5 THEN 'type_enum' END] FROM events
UNION ALL
SELECT 'job_logs', event_id, [CASE WHEN event_id % 13 = 0 THEN 'job_name_null' END, CASE WHEN event_id % 7 IN (5, 6) THEN 'status_enum' END] FROM events)
SELECT table_name, row_id, list_filter(failed, lambda x: x IS NOT NULL) AS reasons,
       len(list_filter(failed, lambda x: x IS NOT NULL)) = 0 AS is_valid FROM r""",
    views=("raw_news", "news_sectors"),
)
def q_validate_rows(spark, sf_dir):
    """Valid rows and rejects of six tables."""
    t = Tables(spark, sf_dir)
    tables = {"sentiment_results": (candidate_results(t).withColumnRenamed("event_id", "row_id"), I.sentiment_checks()), **dimension_candidates(t)}
    out = None
    for name, (rows, checks) in tables.items():
        valid, rejects = I.split_valid(rows, checks)
        x = valid.select("row_id", F.array().cast("array<string>").alias("reasons"), F.lit(True).alias("is_valid")).unionByName(
            rejects.select("row_id", "reasons", F.lit(False).alias("is_valid"))).withColumn("table_name", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out.select("table_name", "row_id", "reasons", "is_valid")


@register(
    "quality_filter",
    """WITH f AS (SELECT rn.*, min(id) OVER (PARTITION BY external_id) AS first_id FROM raw_news rn),
r AS (SELECT id, CASE WHEN content IS NULL OR trim(content) = '' THEN 'empty'
                      WHEN n_chars < 50 THEN 'too_short'
                      WHEN external_id IS NOT NULL AND id <> first_id THEN 'duplicate' END AS filter_reason FROM f)
SELECT id, filter_reason IS NOT NULL AS is_filtered, filter_reason FROM r""",
    views=("raw_news",),
)
def q_quality_filter(spark, sf_dir):
    return I.quality_filter(Tables(spark, sf_dir).raw_news, 50)


@register(
    "text_profile",
    """SELECT language, COUNT(*) AS news_count, SUM(len(string_split(content, ' '))) AS total_words,
       SUM(len(string_split(content, ' '))) / COUNT(content) AS avg_words,
       SUM(length(content)) / COUNT(content) AS avg_chars
FROM raw_news GROUP BY language""",
    views=("raw_news",),
)
def q_text_profile(spark, sf_dir):
    return I.text_profile(Tables(spark, sf_dir).raw_news)


def source_table(t):
    """Source dimension with fetch settings: last fetch = newest news of the source."""
    last = t.raw_news.groupBy("source_id").agg(F.max("published_at").alias("last_fetch_at"))
    s = t.news_sources.join(last.withColumnRenamed("source_id", "id"), "id", "left")
    return s.select("id", "name", (F.col("id") % 7 != 3).alias("is_active"),
                    (F.lit(S.DEFAULT_FETCH_INTERVAL_S) * (1 + F.col("id") % 4 * 12)).cast("int").alias("fetch_interval"),
                    F.when(F.col("id") % 5 != 4, F.col("last_fetch_at")).alias("last_fetch_at"))


@register(
    "sources_due",
    """WITH last AS (SELECT source_id, max(published_at) AS last_fetch_at FROM raw_news GROUP BY source_id),
s AS (SELECT ns.id, ns.name, ns.id % 7 <> 3 AS is_active, CAST(300 * (1 + ns.id % 4 * 12) AS INT) AS fetch_interval,
             CASE WHEN ns.id % 5 <> 4 THEN last.last_fetch_at END AS last_fetch_at
      FROM news_sources ns LEFT JOIN last ON last.source_id = ns.id)
SELECT * FROM s WHERE is_active AND (last_fetch_at IS NULL OR last_fetch_at + to_seconds(fetch_interval) <= TIMESTAMP '2024-01-30 22:00:00')""",
    views=("raw_news", "news_sources"),
)
def q_sources_due(spark, sf_dir):
    return I.sources_due(source_table(Tables(spark, sf_dir)), ts("2024-01-30 22:00:00"))


@register(
    "update_last_fetch",
    """WITH last AS (SELECT source_id, max(published_at) AS last_fetch_at FROM raw_news GROUP BY source_id)
SELECT ns.id, ns.name, CASE WHEN EXISTS (SELECT 1 FROM raw_news rn WHERE rn.source_id = ns.id AND rn.published_at >= TIMESTAMP '2024-01-30 12:00:00')
                            THEN TIMESTAMP '2024-01-31 00:00:00' WHEN ns.id % 5 <> 4 THEN last.last_fetch_at END AS last_fetch_at
FROM news_sources ns LEFT JOIN last ON last.source_id = ns.id""",
    views=("raw_news", "news_sources"),
)
def q_update_last_fetch(spark, sf_dir):
    """A poll brings the news of the last twelve hours."""
    t = Tables(spark, sf_dir)
    polled = t.raw_news.select("source_id", "published_at").filter(F.col("published_at") >= ts("2024-01-30 12:00:00"))
    return I.touch_last_fetch(source_table(t).select("id", "name", "last_fetch_at"), polled, ts("2024-01-31 00:00:00"))


def _by_n(vals, kind: str = "VARCHAR") -> str:
    """SQL text: the sample value of n % 3."""
    return "CAST(list_extract([" + ", ".join(f"'{v}'" for v in vals) + f"], CAST(n % 3 + 1 AS BIGINT)) AS {kind})"


@register(
    "series_source",
    f"""WITH g AS (SELECT ns.id AS source_id, s.n FROM news_sources ns, (SELECT unnest(generate_series(1, 5)) AS n) s)
SELECT source_id, n, concat('sample-', source_id, '-', n) AS external_id, {_by_n(I.SAMPLE_TITLES)} AS title,
       {_by_n(I.SAMPLE_CONTENTS)} AS content, {_by_n(I.SAMPLE_SUMMARIES)} AS summary, concat('https://example.com/news/', n) AS url,
       concat('记者', n) AS author, {AS_OF} - to_hours(n) AS published_at, {_by_n(I.SAMPLE_SCORES, 'DECIMAL(5,4)')} AS sentiment_score,
       {_by_n(I.SAMPLE_LABELS)} AS sentiment_label, CAST({I.SAMPLE_CONFIDENCE} AS DECIMAL(5,4)) AS confidence,
       {_by_n(I.SAMPLE_ENTITIES)} AS entities, {_by_n(I.SAMPLE_KEYWORDS)} AS keywords, {_by_n(I.SAMPLE_IMPACT, 'INT')} AS market_impact_score,
       {AS_OF} - to_hours(n) + INTERVAL 5 MINUTE AS analyzed_at
FROM g""",
    views=("news_sources",),
)
def q_series_source(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return I.sample_series(t.news_sources, 5, ts("2024-01-31 00:00:00"))


def _seed_rows() -> str:
    """SQL VALUES of all seed rows: dimension, variant, code, name, detail, items."""
    quote = lambda v: "NULL" if v is None else "'" + str(v) + "'"
    rows = [("sector", "full", c, n, w, "|".join(k), p) for c, n, k, w, p in D.SECTORS]
    rows += [("sector", v, c, n, None, "|".join(k), None) for v, lst in (("simple", D.SIMPLE_SECTORS), ("minimal", G.SEED_SECTORS)) for c, n, k in lst]
    rows += [("source", "full", n, u, i, "", None) for n, u, i in D.SOURCES]
    rows += [("source", v, n, u, 300, "", None) for v, lst in (("simple", D.SIMPLE_SOURCES), ("minimal", D.MINIMAL_SOURCES)) for n, u in lst]
    rows += [("config", "full", k, v, t, "", None) for k, v, t in D.CONFIGS]
    rows += [("config", "simple", k, v, "string", "", None) for k, v in D.SIMPLE_CONFIGS]
    return ",\n".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)


@register(
    "seed_dimension",
    f"""SELECT 'sector' AS dimension, 'fixture' AS variant, CAST(id AS VARCHAR) AS code, name, CAST(NULL AS VARCHAR) AS detail,
       CAST([] AS VARCHAR[]) AS keywords, CAST(parent_id AS VARCHAR) AS parent FROM market_sectors
UNION ALL
SELECT d, v, code, name, detail, CASE WHEN kw = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(kw, '|') END, parent
FROM (VALUES {_seed_rows()}) AS x(d, v, code, name, detail, kw, parent)""",
    views=("market_sectors",),
)
def q_seed_dimension(spark, sf_dir):
    """The fixture sectors completed with the seed sectors (keyword lists given
    as JSON text, parsed into arrays), sources and configurations."""
    t = Tables(spark, sf_dir)
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")

    def rows(df, dimension, variant, code, name, detail=none, keywords=empty, parent=none):
        return df.select(F.lit(dimension).alias("dimension"), F.col(variant).alias("variant") if isinstance(variant, str) else variant.alias("variant"),
                         F.col(code).cast("string").alias("code"), F.col(name).alias("name"), detail.cast("string").alias("detail"),
                         keywords.alias("keywords"), parent.cast("string").alias("parent"))

    out = rows(t.market_sectors, "sector", F.lit("fixture"), "id", "name", parent=F.col("parent_id"))
    out = out.unionByName(rows(D.seed_sectors(spark), "sector", "variant", "code", "name", F.col("weight"),
                               C.json_list_lenient("keywords"), F.col("parent_code")))
    out = out.unionByName(rows(D.seed_sources(spark), "source", "variant", "name", "url", F.col("fetch_interval")))
    for v in ("full", "simple"):
        out = out.unionByName(rows(D.seed_configs(spark, v), "config", F.lit(v), "config_key", "config_value", F.col("value_type")))
    return out
