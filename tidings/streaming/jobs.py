"""Structured Streaming jobs (R-1 .. R-8).

Every job takes any streaming DataFrame (file source in tests, Kafka in
production), writes through a checkpointed sink, and is exactly-once into
files: ``foreachBatch`` writers overwrite a per-epoch output folder, so a
re-run epoch (after an executor or driver failure) replaces its own output
instead of appending twice.  Late rows are never dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..functions import core as C
from ..operators import ingest as I
from ..operators import rollups as R
from ..operators import scoring as G
from ..operators.skew import group_for_join


# ---- sources ------------------------------------------------------------------------------
def file_source(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None = None,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(path)


POLL_RECORDS = 10  # fixed value: messages that the scorer takes per poll


def land_messages(messages: DataFrame, path: str, per_file: int = POLL_RECORDS) -> None:
    """(key, value) messages appended as files of at most ``per_file`` records;
    ``message_source`` with one file a poll then takes at most that many records
    at a time, earliest files first (a Kafka source is bounded by its offsets)."""
    line = F.concat(F.coalesce("key", F.lit("")), F.lit("\t"), F.col("value"))
    messages.filter(F.col("value").isNotNull()).select(line.alias("value")).write.mode("append").option("maxRecordsPerFile", per_file).text(path)


def message_source(spark: SparkSession, path: str, max_files: int | None = 1) -> DataFrame:
    """(key, value) messages of the files of ``land_messages``."""
    parts = F.split(F.col("value"), "\t", 2)
    return file_source(spark, path, "text", max_files=max_files).select(parts[0].alias("key"), parts[1].alias("value"))


def kafka_source(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """(key, value) strings from a Kafka topic, earliest offset first.
    Needs the Kafka connector on the classpath (not present in the test image)."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic).option("startingOffsets", "earliest"))
    if max_offsets:
        r = r.option("maxOffsetsPerTrigger", str(max_offsets))
    return r.load().select(F.col("key").cast("string"), F.col("value").cast("string"))


def run_available(writer, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Process everything available now, then stop.  With ``every`` (such as
    "300 seconds", the poll of the original system) the query keeps running on
    that trigger and is returned at once."""
    w = writer.option("checkpointLocation", checkpoint)
    if every:
        return w.trigger(processingTime=every).start()
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def epoch_writer(target: str, fmt: str = "parquet", partition_cols: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: idempotent write of one epoch into ``target/epoch=N``."""

    def write(batch: DataFrame, epoch: int) -> None:
        w = batch.write.mode("overwrite")
        if partition_cols:
            w = w.partitionBy(*partition_cols)
        w.format(fmt).save(f"{target}/epoch={epoch}")

    return write


def start_table(target: str, empty: DataFrame) -> None:
    """An epoch -1 without rows: a table that no epoch has written yet reads as empty."""
    epoch_writer(target)(empty, -1)


def run_epochs(stream: DataFrame, body: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each epoch's ``body(batch)`` appended to the table ``target``."""
    start_table(target, body(stream.sparkSession.createDataFrame([], stream.schema)))
    write = epoch_writer(target)
    return run_available(stream.writeStream.foreachBatch(lambda batch, epoch: write(body(batch), epoch)), checkpoint, every)


# ---- the store behind R-1, R-5, R-6 and R-7 ---------------------------------------------------
# A sink table is a folder of appended epochs, ``target/epoch=N``.  An epoch
# writes only its own rows (as many files as tasks) and reads nothing that is
# stored; keys are resolved when the table is read, in one aggregate per key.
def appended(spark: SparkSession, target: str, base: DataFrame | None = None, after: int = -1) -> DataFrame:
    """Rows of all epochs, with their ``epoch``.  ``base`` is a table resolved
    earlier (``resolved.write.parquet(...)``, a plain batch job) that holds the
    epochs up to ``after``; only later epochs are then read (partition pruning)."""
    rows = spark.read.parquet(target)
    if base is None:
        return rows
    return base.withColumn("epoch", F.lit(after)).unionByName(rows.filter(F.col("epoch") > after))


def newest_by_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the highest epoch (update-mode sinks: one row per
    key and epoch).  NULL is a key value like any other."""
    cols = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "epoch").alias("_r")).select(*keys, "_r.*")


# ---- R-1 ingest, first writer wins ------------------------------------------------------------
ENTRY_KEYS = ("source_id", "external_id")


def entries_to_news(entries: DataFrame) -> DataFrame:
    """Feed entries -> news rows: the key is the guid, else the link; the text
    is the content, else the description."""
    return entries.select(
        "id", "source_id", C.first_nonempty("guid", "link").alias("external_id"), "title",
        C.first_nonempty("content", "description").alias("content"), F.col("description").alias("summary"),
        F.col("link").alias("url"), F.coalesce("author", F.lit("")).alias("author"), "published_at")


def ingest_batch_writer(target: str, keys: list[str] = ENTRY_KEYS, seq_col: str = "id") -> Callable[[DataFrame, int], None]:
    """Per epoch: the first writer per key inside the epoch, appended."""
    write = epoch_writer(target)
    return lambda batch, epoch: write(I.dedupe_first_wins(batch, list(keys), seq_col), epoch)


def stored_news(rows: DataFrame, keys: list[str] = ENTRY_KEYS) -> DataFrame:
    """First writer wins over all epochs: of a key stored by several epochs the
    earliest epoch's row stays (an epoch holds a key once).  Rows with a NULL key
    part never collide.  The aggregate carries keys and a number, no text."""
    keys = list(keys)
    first = group_for_join(rows.select(*keys, "epoch").filter(I.key_not_null(keys)), keys).agg(
        F.min("epoch").alias("epoch")).drop("_g")
    kept = rows.join(first, [*keys, "epoch"], "left_semi")
    return kept.select(*rows.columns).unionByName(rows.filter(~I.key_not_null(keys))).drop("epoch")


def stream_ingest(messages: DataFrame, target: str, checkpoint: str, schema: T.StructType = S.ENTRY_MESSAGE,
                  every: str | None = None) -> StreamingQuery:
    """Entry messages -> parsed (undecodable ones skipped) -> appended news;
    read with ``stored_news(appended(...))``."""
    parsed = I.parse_messages(messages, schema).filter(~F.col("is_corrupt")).drop("is_corrupt", "key", "value")
    return run_epochs(entries_to_news(parsed), lambda batch: I.dedupe_first_wins(batch, list(ENTRY_KEYS), "id"), target, checkpoint, every)


# ---- R-2 / R-3 scoring with quarantine ------------------------------------------------------------
def score_writer(target: str, schema: T.StructType, lexicon: DataFrame, quarantine: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: the batch's messages parsed once, the decodable ones
    scored and written to ``target`` with the message as a nested struct, the
    others to ``quarantine`` if given."""

    def write(batch: DataFrame, epoch: int) -> None:
        # messages may share an id, so scores return by a number of the row's own
        p = I.parse_messages(batch, schema).withColumn("_no", F.monotonically_increasing_id()).persist()
        try:
            ok = p.filter(~F.col("is_corrupt"))
            scores = G.lexicon_score(ok, lexicon, keep=("_no",)).select("_no", "sentiment_score", "sentiment_label", "confidence")
            rows = ok.join(scores, "_no").select(
                F.col("id").alias("news_id"), "sentiment_score", "sentiment_label", "confidence",
                F.struct(*schema.fieldNames()).alias("original_data"), F.current_timestamp().alias("analyzed_at"))
            epoch_writer(target)(rows, epoch)
            if quarantine:
                bad = p.filter("is_corrupt").select("key", "value", F.lit("undecodable").alias("reason"))
                epoch_writer(quarantine)(bad, epoch)
        finally:
            p.unpersist()

    return write


def stream_score(messages: DataFrame, schema: T.StructType, lexicon: DataFrame, target: str, checkpoint: str,
                 quarantine: str | None = None, every: str | None = None) -> StreamingQuery:
    """News messages -> scored rows, and undecodable ones to the quarantine.  No
    state: an epoch depends on its own messages only."""
    write = score_writer(target, schema, lexicon, quarantine)
    write(messages.sparkSession.createDataFrame([], messages.schema), -1)
    return run_available(messages.writeStream.foreachBatch(write), checkpoint, every)


# ---- R-4 append to the partitioned fact ------------------------------------------------------------
def stream_append_fact(scored: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    fact = scored.select("news_id", "source_name", "sentiment_score", "sentiment_label",
                         C.day("analyzed_at").alias("date")).withColumn("yyyymm", C.yyyymm("date"))
    w = fact.writeStream.format("parquet").option("path", target).partitionBy("yyyymm").outputMode("append")
    return run_available(w, checkpoint)


# ---- R-5 running daily stats (state store) ---------------------------------------------------------
def stream_daily_stats(scored: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Stateful per-day (count, exact sum, label counts) kept by the state
    store; an epoch appends the new state of the days it touched.  Read with
    ``newest_by_key(appended(...), ["stat_date"])``."""
    st = R.finish_state(R.partial_state(scored, [C.day("analyzed_at").alias("stat_date")]))
    start_table(target, scored.sparkSession.createDataFrame([], st.schema))
    return run_available(st.writeStream.outputMode("update").foreachBatch(epoch_writer(target)), checkpoint, every)


# ---- R-6 idempotent upsert of re-delivered results ---------------------------------------------
def stream_upsert_result(results: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Every delivery is appended; ``latest_results`` resolves them."""
    return run_epochs(results, lambda batch: batch, target, checkpoint, every)


def latest_results(rows: DataFrame, key: str, version_col: str, created_col: str = "created_at") -> DataFrame:
    """Highest version per key wins, of equal versions the later epoch, of equal
    epochs the row with the larger hash; the earliest ``created_col`` stays."""
    cols = [c for c in rows.columns if c not in (key, created_col, "epoch")]
    order = F.struct(F.col(version_col), F.col("epoch"), F.xxhash64(*cols))
    g = rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r"), F.min(created_col).alias(created_col))
    return g.select(key, "_r.*", created_col)


# ---- A-12 / U-3 under re-delivery: R-6 and R-5 as one job -------------------------------------------
def stream_result_stats(results: DataFrame, key: str, version_col: str, target: str, checkpoint: str, ts_col: str = "analyzed_at",
                        every: str | None = None) -> StreamingQuery:
    """Daily statistics of the results that ``latest_results`` keeps, each counted
    once however often it is delivered.

    An epoch appends its deliveries to ``target/results`` and, to
    ``target/daily``, signed states: every key it touches takes its old row back
    from the old row's day and adds its new one to the new row's day, so a replay
    or a stale version adds nothing and a re-score moves.  Stored rows are read
    for the touched keys only (a join on the key).  Read with
    ``result_stats``."""
    spark = results.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        stored = appended(spark, f"{target}/results").filter(F.col("epoch") < epoch)
        touched = stored.join(batch.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_semi").select(*stored.columns)
        # a NULL key is no key: nothing can overwrite such a result
        new = batch.select(*batch.columns, F.lit(epoch).alias("epoch"))
        now = latest_results(touched.unionByName(new.filter(F.col(key).isNotNull())), key, version_col)
        old = latest_results(touched, key, version_col)
        cols = [ts_col, "sentiment_score", "sentiment_label"]
        signed = old.select(*cols, F.lit(-1).alias("_sign")).unionByName(
            now.select(*cols, F.lit(1).alias("_sign"))).unionByName(new.filter(F.col(key).isNull()).select(*cols, F.lit(1).alias("_sign")))
        epoch_writer(f"{target}/daily")(R.signed_state(signed, [C.day(ts_col).alias("stat_date")], "_sign"), epoch)
        epoch_writer(f"{target}/results")(batch, epoch)

    empty = spark.createDataFrame([], results.schema)
    start_table(f"{target}/results", empty)
    write(empty, -1)
    return run_available(results.writeStream.foreachBatch(write), checkpoint, every)


def result_stats(spark: SparkSession, target: str) -> DataFrame:
    """Daily statistics that ``stream_result_stats`` has stored, days without a result left out."""
    rows = appended(spark, f"{target}/daily")
    state = rows.groupBy("stat_date").agg(*[F.sum(c).alias(c) for c in R.STATE_COLS])
    return R.finish_state(state.filter(F.col("news_count") != 0))


# ---- R-7 hourly windows per source ----------------------------------------------------------------------
HOUR_KEYS = ["hour", "source_name"]


def hourly_state(scored: DataFrame) -> DataFrame:
    """Mergeable state per (hour, source): counts and an exact sum."""
    return scored.groupBy(F.date_trunc("hour", "analyzed_at").cast("timestamp_ntz").alias("hour"), "source_name").agg(
        F.count(F.lit(1)).alias("news_count"), F.sum("sentiment_score").alias("score_sum"),
        C.count_label("sentiment_label", "positive").alias("positive_count"),
        C.count_label("sentiment_label", "neutral").alias("neutral_count"),
        C.count_label("sentiment_label", "negative").alias("negative_count"))


def stream_hourly_window(scored: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Event-time hourly stats per source.  An epoch appends the partial state
    of its own rows: no watermark and no state store, so a row counts in its
    hour however late it is.  Read with ``hourly_stats(appended(...))``."""
    return run_epochs(scored, hourly_state, target, checkpoint, every)


def hourly_stats(rows: DataFrame) -> DataFrame:
    """Partial states summed per (hour, source)."""
    counts = ["news_count", "positive_count", "neutral_count", "negative_count"]
    return rows.groupBy(*HOUR_KEYS).agg(F.sum("score_sum").cast("double").alias("score_sum"),
                                        *[F.sum(c).alias(c) for c in counts])


# ---- R-8 dedupe inside the stream ---------------------------------------------------------------------
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stream_dedup(news: DataFrame, keys: list[str], target: str, checkpoint: str, id_col: str = "id", span: str = "1 hour",
                 every: str | None = None) -> StreamingQuery:
    """The first row of every key (earliest epoch, then lowest ``id_col``), ever.

    Copies that arrive within ``span`` of each other meet in the state store
    (RocksDB, off the heap): one row per key and span, let go when the span has
    passed.  The span is one of arrival, not of the rows' own time, so a late
    first row is not dropped.  Copies of what is older are dropped by an anti join
    against the stored keys of earlier epochs.  A key with a NULL part never
    collides: its rows are told apart by their id."""
    spark = news.sparkSession
    own = F.when(~I.key_not_null(keys), F.col(id_col)).alias("_own")
    rest = [c for c in news.columns if c not in keys]
    arrived = news.select("*", own, F.current_timestamp().alias("_arrived")).withWatermark("_arrived", span)
    first = arrived.groupBy(F.window("_arrived", span), *keys, "_own").agg(
        F.min_by(F.struct(*rest), F.struct("_arrived", id_col)).alias("_r")).select(*keys, "_r.*").select(*news.columns)
    start_table(target, spark.createDataFrame([], first.schema))

    def write(batch: DataFrame, epoch: int) -> None:
        stored = appended(spark, target).filter(F.col("epoch") < epoch)
        epoch_writer(target)(I.anti_join_existing(batch, stored, keys, skew_safe=False).select(*news.columns), epoch)

    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():  # a query keeps the settings it starts with
        spark.conf.set(k, v)
    try:
        return run_available(first.writeStream.outputMode("update").foreachBatch(write), checkpoint, every)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
