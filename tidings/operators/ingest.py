"""Ingestion: feed and page parsing, messages, dedupe, validation, profiles
(S-1 .. S-6, S-10, S-11, T-1, U-1, J-9, A-14, F-14, D-13, D-14, D-17).

Duplicate handling never ranks a whole key group inside one task: the
first writer of a key is found with ``min_by`` (partially aggregated on
every task before the shuffle), so a key holding a third of all rows
costs one row per task in the exchange.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import core as C
from ..functions import html as H
from .skew import group_for_join
from .topn import top_n_per_group


# ---- S-1 feeds landed as XML files ------------------------------------------------
def write_feed_files(items: DataFrame, path: str, feed_col: str = "feed") -> None:
    """Land entries as RSS-style XML payloads, one folder per feed."""
    (items.write.mode("overwrite").partitionBy(feed_col).format("xml")
     .option("rootTag", "channel").option("rowTag", "item").save(path))


def write_atom_files(items: DataFrame, path: str, feed_col: str = "feed") -> None:
    """Land entries as Atom payloads, one folder per feed."""
    entry = items.select(
        feed_col, F.col("guid").alias("id"), "title", F.struct(F.col("link").alias("_href"), F.lit("alternate").alias("_rel")).alias("link"),
        F.col("description").alias("summary"), "content", F.when(F.col("author").isNotNull(), F.struct(F.col("author").alias("name"))).alias("author"),
        F.col("pubDate").alias("published"))
    (entry.write.mode("append").partitionBy(feed_col).format("xml")
     .option("rootTag", "feed").option("rowTag", "entry").save(path))


def write_json_feed_files(items: DataFrame, path: str, payload_col: str, feed_col: str = "feed") -> None:
    """Land entries as JSON Feed payloads, a document per feed and ``payload_col``, one folder per feed."""
    entry = F.struct(F.col("guid").alias("id"), F.col("link").alias("url"), "title", F.col("description").alias("summary"),
                     F.col("content").alias("content_html"), F.col("pubDate").alias("date_published"),
                     F.when(F.col("author").isNotNull(), F.array(F.struct(F.col("author").alias("name")))).alias("authors"))
    docs = items.groupBy(feed_col, payload_col).agg(F.to_json(F.struct(
        F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.first(feed_col).alias("title"), F.collect_list(entry).alias("items"))).alias("value"))
    # a file per document: a reader takes a file as one payload
    docs.select(feed_col, "value").write.mode("append").option(
        "maxRecordsPerFile", 1).partitionBy(feed_col).text(path)


def _links(links: Column) -> Column:
    """The page an Atom entry is about: its first link without ``rel`` or with
    ``rel="alternate"``, else its first link."""
    page = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.get(page, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"])


# entries of an RSS or Atom document; what stands in CDATA is no markup
_ENTRY = r"(?s)<(item|entry)(?=[\s>])[^>]*>(?:[^<]++|<!\[CDATA\[.*?\]\]>|<(?!/\1\s*>|!\[CDATA\[)){0,100000}+</\1\s*>"
_XML = {"ignoreSurroundingSpaces": "false"}


def read_feed_items(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Payload files, RSS, Atom and JSON Feed side by side, -> entry rows (feed,
    guid, title, link, description, content, author, published).

    Every payload is read once and its format found from its content: a JSON
    object by its ``items`` (VARIANT), else the ``item`` and ``entry`` elements
    (``from_xml``).  A payload that is neither has no rows.  The feed is the
    folder name.  Author: the entry's, of several the first, else ''.  Content: else the description."""
    raw = spark.read.schema("value string, feed string").text(path, wholetext=True)
    is_json = F.col("value").rlike(r"^\ufeff?\s*[\{\[]")
    x = raw.select("feed", F.when(is_json, F.try_parse_json("value")).alias("_doc"), F.when(~is_json, F.col("value")).alias("_text"))
    none = F.array().cast("array<struct<xml:string,json:variant>>")
    listed = F.try_variant_get("_doc", "$.items", "array<variant>")
    entry = F.concat(
        F.coalesce(F.transform(listed, lambda v: F.struct(F.lit(None).cast("string").alias("xml"), v.alias("json"))), none),
        F.coalesce(F.transform(F.regexp_extract_all("_text", F.lit(_ENTRY), 0),
                               lambda e: F.struct(e.alias("xml"), F.lit(None).cast("variant").alias("json"))), none))
    x = x.select("feed", F.explode(entry).alias("e")).select("feed", "e.xml", "e.json")
    x = x.select("feed", "json",
                 F.from_xml(F.when(F.startswith("xml", F.lit("<item")), F.col("xml")), S.FEED_ITEM, {**_XML, "rowTag": "item"}).alias("r"),
                 F.from_xml(F.when(F.startswith("xml", F.lit("<entry")), F.col("xml")), S.ATOM_ENTRY, {**_XML, "rowTag": "entry"}).alias("a"))
    field = lambda at: F.try_variant_get("json", at, "string")
    x = x.select("*", F.coalesce(C.first_nonempty("a.published", "a.updated"),
                                 C.first_nonempty(field("$.date_published"), field("$.date_modified"))).alias("_when"))
    stamp = F.when(F.col("r").isNotNull(), C.parse_feed_date("r.pubDate", now)).otherwise(
        F.coalesce(F.try_to_timestamp("_when").cast("timestamp_ntz"), C.parse_feed_date("_when", now)))
    return x.select(
        "feed", F.coalesce("r.guid", "a.id", field("$.id")).alias("guid"), F.coalesce("r.title", "a.title", field("$.title")).alias("title"),
        F.coalesce(F.col("r.link"), _links(F.col("a.link")), C.first_nonempty(field("$.url"), field("$.external_url"))).alias("link"),
        F.coalesce(F.col("r.description"), F.col("a.summary"), field("$.summary")).alias("description"),
        F.coalesce(C.first_nonempty("r.content", "r.`content:encoded`"), F.col("a.content"),
                   C.first_nonempty(field("$.content_html"), field("$.content_text"))).alias("content"),
        F.coalesce(C.first_nonempty("r.author", "r.`dc:creator`"), F.get("a.author", F.lit(0))["name"],
                   C.first_nonempty(field("$.authors[0].name"), field("$.author.name")), F.lit("")).alias("author"),
        stamp.alias("published")).select(
        "feed", C.first_nonempty("guid", "link").alias("guid"), "title", "link", "description",
        C.first_nonempty("content", "description").alias("content"), "author", "published")


# ---- S-2 first n entries per feed ------------------------------------------------------------
def limit_per_feed(df: DataFrame, n: int = S.FEED_ENTRY_LIMIT, feed_col: str = "feed", pos_col: str = "pos") -> DataFrame:
    return top_n_per_group(df, [feed_col], [F.col(pos_col).asc()], n, salt_key=F.col(pos_col)).drop("_rank")


# ---- S-3 HTML pages ----------------------------------------------------------------------------------
def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, title, lang, links, n_links of every page
    (``functions.html``: tags in any case and quoting, nothing out of comments,
    scripts and styles, character references decoded).

    Links are the ``href`` of all tags but ``base``, in order, absolute against
    the page's ``base`` if it has one, else its address."""
    wanted = F.filter(H.tags(F.col("html")), lambda t: t.rlike(r"(?i)^<(html|base|title)\b|\bhref\b"))
    x = pages.select("page_id", "url", wanted.alias("_tags"))
    first = lambda name: F.get(F.filter("_tags", lambda t: H.tag_name(t) == name), F.lit(0))
    linked = F.filter("_tags", lambda t: t.rlike(r"(?i)\bhref\b") & (H.tag_name(t) != "base"))
    x = x.select("page_id", "url", H.title(F.col("_tags")).alias("title"), F.coalesce(H.attribute(first("html"), "lang"), F.lit("")).alias("lang"),
                 H.attribute(first("base"), "href").alias("_base"), F.transform(linked, lambda t: H.attribute(t, "href")).alias("_links"))
    x = x.withColumn("_url", H.address(F.coalesce("url", F.lit(""))))
    x = x.withColumn("_at", F.when(F.col("_base").isNotNull(), H.address(H.resolved(F.col("_base"), F.col("_url")))).otherwise(F.col("_url")))
    links = F.transform(F.filter("_links", lambda h: h.isNotNull()), lambda h: H.resolved(h, F.col("_at")))
    return x.select("page_id", "url", F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1).alias("host"), "title", "lang",
                    F.coalesce(links, F.array().cast("array<string>")).alias("links")).withColumn("n_links", F.size("links"))


# ---- S-4 / S-5 / S-6 messages ----------------------------------------------------------------------
def _field(path: str, name: str, kind: T.DataType) -> tuple[Column, Column]:
    """(value, wrong) of the field at ``path`` of the variant ``_v``.  An absent
    field and a JSON null are NULL; any other kind of value than the schema's is
    wrong, as is text that is no timestamp in a field named ``*_at``."""
    item = F.try_variant_get("_v", path, "variant")
    found = F.schema_of_variant(item)
    absent = item.isNull() | (found == "VOID")
    if isinstance(kind, T.StructType):
        parts = [(f.name, *_field(f"{path}['{f.name}']", f.name, f.dataType)) for f in kind.fields]
        wrong = ~F.startswith(found, F.lit("OBJECT"))
        for _, _, w in parts:
            wrong = wrong | w
        value = F.when(~absent, F.struct(*[v.alias(n) for n, v, _ in parts]))
    elif isinstance(kind, T.ArrayType):
        items = F.try_variant_get("_v", path, "array<variant>")
        wrong = items.isNull() | F.exists(items, lambda e: ~F.schema_of_variant(e).isin("STRING", "VOID"))
        value = F.try_variant_get("_v", path, "array<string>")
    elif isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        text = F.try_variant_get("_v", path, "string")
        value = text if isinstance(kind, T.StringType) else F.try_to_timestamp(text).cast(kind)
        wrong = found != "STRING"
        if name.endswith("_at") or not isinstance(kind, T.StringType):
            wrong = wrong | F.try_to_timestamp(text).isNull()
    else:
        value = F.try_variant_get("_v", path, kind.simpleString())
        kinds = {T.BooleanType: "^BOOLEAN", T.DoubleType: "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", T.FloatType: "^(BIGINT|DOUBLE|FLOAT|DECIMAL)",
                 T.DecimalType: "^(BIGINT|DECIMAL)"}
        wrong = ~found.rlike(kinds.get(type(kind), "^BIGINT")) | value.isNull()
    return value, ~absent & wrong


def parse_messages(df: DataFrame, schema: T.StructType, value_col: str = "value", key: str | None = None) -> DataFrame:
    """JSON text -> typed columns plus ``is_corrupt`` (undecodable rows are
    kept, with NULL fields, for the quarantine sink instead of failing the job).

    Strict, by VARIANT: the text is one JSON object and nothing else, read once;
    a field holds the schema's kind of value (text, whole number in range, number,
    list of texts, object) or null or is absent, and nothing is converted; the
    ``key`` (the schema's first field unless given) is there; a text field named
    ``*_at`` holds a timestamp.  Of repeated names the last counts; names outside
    the schema are ignored."""
    key = key or schema.fieldNames()[0]
    value = F.col(value_col)
    # the parser ignores what follows a complete text: the seal behind the value is
    # only found where the value was exactly one element
    seal = F.xxhash64(value)
    sealed = F.concat(F.lit("["), value, F.lit(","), seal.cast("string"), F.lit("]"))
    x = df.select("*", F.try_parse_json(sealed).alias("_v"))
    whole = (F.try_variant_get("_v", "$[1]", "bigint") == seal) & F.try_variant_get("_v", "$[2]", "variant").isNull() \
        & F.startswith(F.schema_of_variant(F.try_variant_get("_v", "$[0]", "variant")), F.lit("OBJECT"))
    fields = {f.name: _field(f"$[0]['{f.name}']", f.name, f.dataType) for f in schema.fields}
    bad = ~F.coalesce(whole, F.lit(False)) | fields[key][0].isNull()
    for _, wrong in fields.values():
        bad = bad | wrong
    read = F.struct(bad.alias("is_corrupt"), *[v.alias(n) for n, (v, _) in fields.items()])
    # a filter on the result stops at the generator; below it Catalyst would parse the text once per use
    x = x.select(*df.columns, read.alias("_m")).select(*df.columns, F.explode(F.array("_m")).alias("_m"))
    return x.select(*df.columns, *[F.when(~F.col("_m.is_corrupt"), F.col(f"_m.{n}")).alias(n) for n in fields], "_m.is_corrupt")


# Message text: every field present (NULL as null), timestamps as
# "yyyy-MM-dd HH:mm:ss.ffffff" in the session zone (UTC); parse_messages
# reads this and the ISO form alike.
MESSAGE_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}


def to_messages(df: DataFrame, key_col: str) -> DataFrame:
    """Rows -> keyed JSON messages (key, value) for a message sink."""
    return df.select(F.col(key_col).cast("string").alias("key"), F.to_json(F.struct(*df.columns), MESSAGE_JSON).alias("value"))


def raw_payload(df: DataFrame, name: str = "raw_data") -> DataFrame:
    return df.withColumn(name, F.to_json(F.struct(*df.columns), MESSAGE_JSON))


def flatten_message(parsed: DataFrame) -> DataFrame:
    """J-13: the scored message carries its news as a nested struct."""
    return parsed.select(
        "news_id", F.col("original_data.title").alias("title"), F.col("original_data.url").alias("url"),
        F.col("original_data.source_name").alias("source_name"),
        F.try_to_timestamp("original_data.published_at").cast("timestamp_ntz").alias("published_at"),
        "sentiment_score", "sentiment_label", "confidence", "market_impact_score",
        F.try_to_timestamp("analyzed_at").cast("timestamp_ntz").alias("analyzed_at"),
    )


def tag_feeds(df: DataFrame, by: str, feed_col: str = "feed") -> DataFrame:
    """The feeds that one table holds, as ``union_feeds`` would give them, in one
    scan: every value of ``by`` is a feed, NULL too."""
    return df.withColumn(feed_col, F.col(by))


# ---- T-1 union of feeds ---------------------------------------------------------------------------
def union_feeds(feeds: Mapping[str, DataFrame], feed_col: str = "feed") -> DataFrame:
    out = None
    for name, df in feeds.items():
        tagged = df.withColumn(feed_col, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no feeds")
    return out


# ---- U-1 / J-9 first writer wins ------------------------------------------------------------------
def key_not_null(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def dedupe_first_wins(df: DataFrame, keys: list[str], seq_col: str) -> DataFrame:
    """Keep the first row (lowest ``seq_col``) of every non-NULL key; rows with
    a NULL key part never collide and are all kept."""
    cols = df.columns
    nn = key_not_null(keys)
    firsts = (df.filter(nn).groupBy(*keys)
              .agg(F.min_by(F.struct(*cols), F.col(seq_col)).alias("_r")).select("_r.*"))
    return firsts.unionByName(df.filter(~nn))


def anti_join_existing(incoming: DataFrame, stored: DataFrame, keys: list[str], skew_safe: bool = True) -> DataFrame:
    """Entries whose key is not stored yet; plain equality, so NULL keys never
    match and always count as new (a SQL unique key treats NULLs as distinct)."""
    # distinct first: a key stored many times (a hot key) becomes one row per
    # task before the shuffle, so the anti join never sees a skewed build side
    live = stored.select(*keys).filter(key_not_null(keys))
    if not skew_safe:  # callers whose incoming rows are unique per key
        return incoming.join(live.distinct(), keys, "left_anti")
    # copies of one entry on the incoming side: the join gets its own shuffle,
    # so AQE can split their partition (operators.skew)
    stored_keys = group_for_join(live, keys).agg(F.count(F.lit(1)).alias("_n")).drop("_n", "_g")
    return incoming.join(stored_keys, keys, "left_anti")


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str], seq_col: str) -> DataFrame:
    """stored + (first writer of each new key in the batch)."""
    new = anti_join_existing(dedupe_first_wins(incoming, keys, seq_col), stored, keys, skew_safe=False)
    return stored.unionByName(new.select(*stored.columns))


def mark_new(entries: DataFrame, stored: DataFrame, keys: list[str] = ("source_id", "external_id"),
             seq_col: str = "id") -> DataFrame:
    """is_new = first in the batch for its key and not stored before."""
    keys = list(keys)
    nn = key_not_null(keys)
    # one right side with one row per key (first id in the batch, stored or
    # not), grouped so that AQE can split a hot key (copies) of the entries
    # in the single join (operators.skew)
    u = entries.select(*keys, F.col(seq_col).alias("_s"), F.lit(False).alias("_st")).unionByName(
        stored.select(*keys, F.lit(None).cast(entries.schema[seq_col].dataType).alias("_s"), F.lit(True).alias("_st")))
    per_key = group_for_join(u.filter(nn), keys).agg(
        F.min("_s").alias("_first"), F.max("_st").alias("_stored")).drop("_g")
    j = entries.join(per_key, keys, "left")
    first_in_batch = (~nn) | (F.col(seq_col) == F.col("_first"))
    return j.withColumn("is_new", first_in_batch & ~F.coalesce(F.col("_stored"), F.lit(False))).drop("_first", "_stored")


# ---- F-14 domain checks -----------------------------------------------------------------------------
def validation_reasons(checks: Mapping[str, Column]) -> Column:
    """array of the names of failed checks (a check is failed when it is not true)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))


def _in(col: str, values) -> Column:
    return F.col(col).isin(*values)


def _or_null(col: str, check: Column) -> Column:
    """A domain check of a column that may be NULL."""
    return F.col(col).isNull() | check


def sentiment_checks() -> dict[str, Column]:
    return {
        "news_id_null": F.col("news_id").isNotNull(),
        "score_range": F.col("sentiment_score").between(-1, 1),
        "confidence_range": F.col("confidence").between(0, 1),
        "impact_range": _or_null("market_impact_score", F.col("market_impact_score").between(0, 100)),
        "label_enum": _in("sentiment_label", S.LABELS),
    }


def source_checks() -> dict[str, Column]:
    return {"name_null": F.col("name").isNotNull(), "url_null": F.col("url").isNotNull(), "type_enum": _in("type", S.SOURCE_TYPES),
            "status_enum": _or_null("status", _in("status", S.SOURCE_STATUSES))}


def bridge_checks() -> dict[str, Column]:
    return {"relevance_range": F.col("relevance_score").between(0, 1)}


def trend_checks() -> dict[str, Column]:
    return {"stat_date_null": F.col("stat_date").isNotNull(), "trend_enum": _or_null("sentiment_trend", _in("sentiment_trend", S.TREND_LABELS))}


def config_checks() -> dict[str, Column]:
    return {"key_null": F.col("config_key").isNotNull(), "value_null": F.col("config_value").isNotNull(),
            "type_enum": _or_null("value_type", _in("value_type", S.CONFIG_TYPES))}


def job_checks() -> dict[str, Column]:
    return {"job_name_null": F.col("job_name").isNotNull(), "status_enum": _in("status", S.JOB_STATUSES)}


def split_valid(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with their ``reasons``)."""
    v = validate_rows(df, checks)
    return v.filter("is_valid").select(*df.columns), v.filter(~F.col("is_valid")).drop("is_valid")


def validate_rows(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Rows with ``reasons`` and ``is_valid``; split by ``is_valid``."""
    return df.withColumn("reasons", validation_reasons(checks)).withColumn("is_valid", F.size("reasons") == 0)


# ---- D-13 quality filter ---------------------------------------------------------------------------
def quality_filter(news: DataFrame, min_chars: int = 50, key: str = "external_id", seq_col: str = "id") -> DataFrame:
    """is_filtered + first applicable reason: empty, too_short, duplicate."""
    # a group of copies can hold a large share of the rows: the join-back gets
    # its own shuffle, so AQE can split that partition (operators.skew)
    firsts = group_for_join(news.filter(F.col(key).isNotNull()), [key]).agg(F.min(seq_col).alias("_first")).drop("_g")
    # what the row alone tells is worked out before the join: no text is shuffled
    own = F.when(F.col("content").isNull() | (F.trim("content") == ""), "empty").when(F.col("n_chars") < min_chars, "too_short")
    j = news.select(seq_col, key, own.alias("_own")).join(firsts, key, "left")
    reason = F.coalesce("_own", F.when(F.col("_first").isNotNull() & (F.col(seq_col) != F.col("_first")), "duplicate"))
    return j.select(seq_col, reason.isNotNull().alias("is_filtered"), reason.alias("filter_reason"))


# ---- D-14 text profile ---------------------------------------------------------------------------
def text_profile(news: DataFrame) -> DataFrame:
    # blank-separated tokens = blanks + 1 (as the size of the split), counted
    # without building an array of every word
    c = F.col("content")
    words = F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit(""))) + 1
    x = news.select("language", words.alias("words"), F.length("content").alias("chars"))
    return x.groupBy("language").agg(
        F.count(F.lit(1)).alias("news_count"), F.sum("words").alias("total_words"),
        (F.sum("words") / F.count("words")).alias("avg_words"), (F.sum("chars") / F.count("chars")).alias("avg_chars"),
    )


# ---- D-17 sources due for fetching ----------------------------------------------------------------
def sources_due(sources: DataFrame, as_of: Column) -> DataFrame:
    """Active sources never fetched, or whose last fetch + interval has passed."""
    due_at = F.timestamp_add("SECOND", F.col("fetch_interval"), F.col("last_fetch_at"))
    return sources.filter(F.col("is_active") & (F.col("last_fetch_at").isNull() | (due_at <= as_of)))


# ---- U-5 last fetch ---------------------------------------------------------------------------------
def touch_last_fetch(sources: DataFrame, polled: DataFrame, at: Column, key: str = "source_id") -> DataFrame:
    """Sources of which a poll brought entries were last fetched ``at``; the others keep their time."""
    from .writes import update_by_key

    hit = polled.filter(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct().withColumn("last_fetch_at", at)
    return update_by_key(sources, hit, "id", ["last_fetch_at"])


# ---- S-10 generated series --------------------------------------------------------------------------
# The three sample rows of the seed data, chosen by n % 3.
SAMPLE_TITLES = ["科技巨头发布新款AI芯片，性能提升50%", "新能源汽车销量创新高，市场前景广阔", "金融市场波动加剧，投资者需谨慎"]
SAMPLE_CONTENTS = [
    "某科技公司今日发布了最新一代AI处理器，相比上一代产品性能提升了50%，能效比也有显著改善。业内专家普遍认为，这一突破将推动人工智能应用的进一步普及。",
    "最新数据显示，新能源汽车市场持续高速增长，上月销量同比增长超过80%。多家车企宣布扩产计划，产业链上下游企业纷纷受益。",
    "受国际局势影响，全球金融市场出现较大波动。分析师建议投资者保持谨慎，关注政策动向，合理配置资产。",
]
SAMPLE_SUMMARIES = ["新一代AI处理器发布，性能大幅提升", "新能源汽车销量创新高", "金融市场波动加剧"]
SAMPLE_SCORES = ["0.65", "0.45", "-0.25"]
SAMPLE_LABELS = ["positive", "neutral", "negative"]
SAMPLE_IMPACT = [75, 60, 45]
SAMPLE_CONFIDENCE = "0.85"
SAMPLE_ENTITIES = [
    '[{"name": "AI芯片", "type": "product", "sentiment": "positive"}, {"name": "科技公司", "type": "company", "sentiment": "positive"}]',
    '[{"name": "新能源汽车", "type": "industry", "sentiment": "positive"}]',
    '[{"name": "金融市场", "type": "market", "sentiment": "negative"}]',
]
SAMPLE_KEYWORDS = ['["AI", "芯片", "性能", "提升"]', '["新能源", "汽车", "销量", "增长"]', '["金融", "市场", "波动", "投资"]']


def sample_series(sources: DataFrame, per_source: int, as_of: Column) -> DataFrame:
    """``per_source`` sample news with their scores for every source, one per
    hour back from ``as_of``, analysed five minutes later; texts, scores,
    entities and keywords by n % 3 (generated, no cross join)."""
    x = sources.select(F.col("id").alias("source_id"), F.explode(F.sequence(F.lit(1), F.lit(per_source))).alias("n"))
    k = F.col("n") % 3
    n = F.col("n").cast("string")
    at = F.timestamp_add("HOUR", -F.col("n"), as_of)

    def pick(vals, kind: str = "string"):
        return F.when(k == 0, F.lit(vals[0])).when(k == 1, F.lit(vals[1])).otherwise(F.lit(vals[2])).cast(kind)

    return x.select(
        "source_id", "n",
        F.concat(F.lit("sample-"), F.col("source_id").cast("string"), F.lit("-"), n).alias("external_id"),
        pick(SAMPLE_TITLES).alias("title"), pick(SAMPLE_CONTENTS).alias("content"), pick(SAMPLE_SUMMARIES).alias("summary"),
        F.concat(F.lit("https://example.com/news/"), n).alias("url"), F.concat(F.lit("记者"), n).alias("author"),
        at.alias("published_at"), pick(SAMPLE_SCORES, "decimal(5,4)").alias("sentiment_score"), pick(SAMPLE_LABELS).alias("sentiment_label"),
        F.lit(SAMPLE_CONFIDENCE).cast("decimal(5,4)").alias("confidence"), pick(SAMPLE_ENTITIES).alias("entities"),
        pick(SAMPLE_KEYWORDS).alias("keywords"), pick(SAMPLE_IMPACT, "int").alias("market_impact_score"),
        F.timestamp_add("MINUTE", F.lit(5), at).alias("analyzed_at"),
    )
