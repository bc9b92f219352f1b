"""Domain tables derived from the driver's Parquet files.

Each view of FIXTURES.md §3 is built twice: as a lazy Spark DataFrame over
``sf_dir`` (``Tables``) and as DuckDB SQL text (``VIEW_SQL``) for the
independent oracle.  Both read whole tables; nothing is sampled.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_session

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def ts(text: str) -> Column:
    """Timestamp literal without zone (the driver files use timestamp_ntz)."""
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def source_id_of(name: Column) -> Column:
    """'src7' -> 7."""
    return F.substring(name, 4, 1 << 20).cast("int")


_SCHEMAS: dict[tuple[str, int], T.StructType] = {}


class Tables:
    """Lazy access to base tables and fixture views of one scale-factor dir."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = ensure_session(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        """A driver table.  Its schema is read from the Parquet footers once per
        process (keyed by path and modification time) and then given to the
        reader, which then only lists the files."""
        path = f"{self.sf_dir}/{name}.parquet"
        jvm = getattr(self.spark, "_jvm", None)
        if jvm is None:  # no JVM handle (e.g. a remote session): plain read
            return self.spark.read.parquet(path)
        jpath = jvm.org.apache.hadoop.fs.Path(path)
        fs = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
        key = (path, fs.getFileStatus(jpath).getModificationTime())
        schema = _SCHEMAS.get(key)
        if schema is None:
            df = self.spark.read.parquet(path)
            _SCHEMAS[key] = df.schema
            return df
        return self.spark.read.schema(schema).parquet(path)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)

    # ---- dimension: sources ------------------------------------------------
    @cached_property
    def news_sources(self) -> DataFrame:
        docs = self.base("documents")
        return docs.select(source_id_of(F.col("source")).alias("id"), F.col("source").alias("name")).distinct()

    # ---- fact: raw news ------------------------------------------------------
    @cached_property
    def raw_news(self) -> DataFrame:
        d = self.base("documents")
        hours = (F.col("doc_id") * 7 % 720).cast("int")
        return d.select(
            F.col("doc_id").alias("id"),
            F.when(F.col("doc_id") % 17 == 0, F.lit(None).cast("int"))
            .otherwise(source_id_of(F.col("source")))
            .alias("source_id"),
            F.md5("text").alias("external_id"),
            F.substring("text", 1, 60).alias("title"),
            F.col("text").alias("content"),
            F.concat(F.lit("https://example.com/news/"), F.col("doc_id").cast("string")).alias("url"),
            F.col("lang").alias("language"),
            "n_chars",
            F.when(F.col("doc_id") % 97 == 0, F.lit(None).cast("timestamp_ntz"))
            .otherwise(F.timestamp_add("HOUR", hours, ts("2024-01-01 00:00:00")))
            .alias("published_at"),
        )

    # ---- fact: sentiment results -------------------------------------------
    @cached_property
    def sentiment_results(self) -> DataFrame:
        lab = self.base("labels")
        score = ((F.col("doc_id") * 37 % 201 - 100) / F.lit(100.0)).cast("decimal(5,4)")
        x = lab.select(F.col("doc_id").alias("news_id"), score.alias("score"))
        return x.select(
            "news_id",
            F.col("score").alias("sentiment_score"),
            F.when(F.col("score") > 0.3, "positive")
            .when(F.col("score") < -0.3, "negative")
            .otherwise("neutral")
            .alias("sentiment_label"),
            ((50 + F.col("news_id") % 50) / F.lit(100.0)).cast("decimal(5,4)").alias("confidence"),
            (F.col("news_id") % 101).cast("int").alias("market_impact_score"),
        )

    # ---- dimension: sectors (nations under regions) --------------------------
    @cached_property
    def market_sectors(self) -> DataFrame:
        n = self.base("nation").select(
            F.col("n_nationkey").alias("id"),
            F.col("n_name").alias("name"),
            (100 + F.col("n_regionkey")).alias("parent_id"),
            (F.col("n_nationkey") % 7 != 6).alias("is_active"),
        )
        r = self.base("region").select(
            (100 + F.col("r_regionkey")).alias("id"),
            F.col("r_name").alias("name"),
            F.lit(None).cast("int").alias("parent_id"),
            F.lit(True).alias("is_active"),
        )
        return n.unionByName(r)

    # ---- bridge: news <-> sectors -------------------------------------------
    @cached_property
    def news_sectors(self) -> DataFrame:
        d = self.base("documents").select("doc_id")
        primary = d.select(
            F.col("doc_id").alias("news_id"),
            (F.col("doc_id") % 20).cast("int").alias("sector_id"),
            F.lit(True).alias("is_primary"),
        )
        second = d.filter(F.col("doc_id") % 2 == 0).select(
            F.col("doc_id").alias("news_id"),
            ((F.col("doc_id") * 3 + 1) % 20).cast("int").alias("sector_id"),
            F.lit(False).alias("is_primary"),
        )
        return primary.unionByName(second)

    # ---- stream: scored events ----------------------------------------------
    @cached_property
    def scored_events(self) -> DataFrame:
        return scored_events_of(self.base("events"))

    # ---- lexicon of polarity fragments --------------------------------------
    @cached_property
    def lexicon(self) -> DataFrame:
        return self.spark.createDataFrame(LEXICON_ROWS, "polarity string, word string")


def scored_events_of(events: DataFrame) -> DataFrame:
    """The `sentiment-news` stream shape from the events table (batch or stream)."""
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 50)).cast("decimal(5,4)")
    impact = F.regexp_replace(F.regexp_replace("props", r'\{"k": ', ""), r"\}", "").cast("int")
    x = events.select("event_id", "event_type", "user_id", "ts", score.alias("s"), impact.alias("impact"))
    return x.select(
        F.col("event_id").alias("news_id"),
        F.col("event_type").alias("source_name"),
        "user_id",
        F.col("ts").alias("analyzed_at"),
        F.col("s").alias("sentiment_score"),
        F.when(F.col("s") > 0.3, "positive").when(F.col("s") < -0.3, "negative").otherwise("neutral").alias("sentiment_label"),
        F.col("impact").alias("market_impact_score"),
    )


# Polarity fragments of the fixture lexicon (FIXTURES.md §3).
LEXICON_ROWS = [
    ("positive", "tion"),
    ("positive", "the"),
    ("positive", "ei"),
    ("negative", "ou"),
    ("negative", "her"),
    ("negative", "ch"),
]

# ---------------------------------------------------------------------------
# DuckDB text of the same views, used by the oracle SQL.
# ---------------------------------------------------------------------------
VIEW_SQL = {
    "news_sources": "SELECT DISTINCT CAST(substring(source, 4) AS INT) AS id, source AS name FROM documents",
    "raw_news": """SELECT doc_id AS id,
       CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(substring(source, 4) AS INT) END AS source_id,
       md5(text) AS external_id,
       substring(text, 1, 60) AS title,
       text AS content,
       concat('https://example.com/news/', CAST(doc_id AS VARCHAR)) AS url,
       lang AS language,
       n_chars,
       CASE WHEN doc_id % 97 = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id * 7 % 720 AS INT)
       END AS published_at
FROM documents""",
    "sentiment_results": """SELECT news_id,
       score AS sentiment_score,
       CASE WHEN score > 0.3 THEN 'positive' WHEN score < -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       CAST((50 + news_id % 50) / 100.0 AS DECIMAL(5,4)) AS confidence,
       CAST(news_id % 101 AS INT) AS market_impact_score
FROM (SELECT doc_id AS news_id,
             CAST(((doc_id * 37) % 201 - 100) / 100.0 AS DECIMAL(5,4)) AS score
      FROM labels) x""",
    "market_sectors": """SELECT n_nationkey AS id, n_name AS name, 100 + n_regionkey AS parent_id, n_nationkey % 7 <> 6 AS is_active FROM nation
UNION ALL
SELECT 100 + r_regionkey, r_name, NULL, true FROM region""",
    "news_sectors": """SELECT doc_id AS news_id, CAST(doc_id % 20 AS INT) AS sector_id, true AS is_primary FROM documents
UNION ALL
SELECT doc_id, CAST((doc_id * 3 + 1) % 20 AS INT), false FROM documents WHERE doc_id % 2 = 0""",
    "scored_events": """SELECT event_id AS news_id, event_type AS source_name, user_id, ts AS analyzed_at, sentiment_score,
       CASE WHEN sentiment_score > 0.3 THEN 'positive' WHEN sentiment_score < -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       market_impact_score
FROM (SELECT event_id, event_type, user_id, ts,
             CAST(greatest(-1.0, least(1.0, (value - 50) / 50)) AS DECIMAL(5,4)) AS sentiment_score,
             CAST(replace(replace(props, '{"k": ', ''), '}', '') AS INT) AS market_impact_score
      FROM events) x""",
    "lexicon": """SELECT * FROM (VALUES ('positive','tion'), ('positive','the'), ('positive','ei'),
                      ('negative','ou'), ('negative','her'), ('negative','ch')) AS t(polarity, word)""",
}

# view dependencies (a view may read another view)
_VIEW_DEPS: dict[str, tuple[str, ...]] = {}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with a WITH clause defining the named fixture views."""
    if not names:
        return body
    ordered: list[str] = []
    for n in names:
        for dep in _VIEW_DEPS.get(n, ()):
            if dep not in ordered:
                ordered.append(dep)
        if n not in ordered:
            ordered.append(n)
    ctes = ",\n".join(f"{n} AS (\n{VIEW_SQL[n]}\n)" for n in ordered)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
