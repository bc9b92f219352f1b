"""Write semantics on plain files: upserts, touch, retention, snapshots, run
history (U-2 .. U-6, J-11, J-12, S-8, S-9, W-1, D-16, D-18, D-12).

Plain Parquet has no MERGE, so a merge is *read the touched target ->
union with the batch -> regroup by key -> write a new version*.  Key
regrouping uses ``max_by`` / ``min`` aggregates (partial aggregation, no
whole-group sort).  Writes go to a fresh path under the shared folder;
the path being read is never overwritten in the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import core as C
from .skew import group_for_join


# ---- U-2 last writer wins ------------------------------------------------------------------
def upsert_last_wins(existing: DataFrame, updates: DataFrame, key: str, version_col: str,
                     created_col: str = "created_at") -> DataFrame:
    """Rows of the highest version win per key; ``created_at`` stays the
    earliest one seen.  Equal versions: the update side wins, of several equal
    updates the row with the larger hash (the same one however the rows are
    dealt).  A NULL key is no key: such rows never meet and all stay."""
    cols = [c for c in existing.columns if c not in (key,)]
    u = existing.withColumn("_side", F.lit(0)).unionByName(updates.withColumn("_side", F.lit(1)))
    g = u.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct(*cols), F.struct(F.col(version_col), F.col("_side"), F.xxhash64(*cols))).alias("_r"),
        F.min(created_col).alias("_created"),
    )
    merged = g.select(key, "_r.*", "_created").withColumn(created_col, F.col("_created")).drop("_created")
    return merged.unionByName(u.filter(F.col(key).isNull()).drop("_side"))


# ---- U-4 touch updated_at -------------------------------------------------------------------
def touch_updated_at(old: DataFrame, new: DataFrame, key: str, compare: list[str], as_of: Column,
                     updated_col: str = "updated_at") -> DataFrame:
    """New values; ``updated_at`` moves to ``as_of`` only when a compared
    column really changed (null-safe comparison of the row values)."""
    o = old.select(key, F.struct(*compare).alias("_old"), F.col(updated_col).alias("_old_upd"))
    j = new.join(o, key, "left")
    same = F.struct(*compare).eqNullSafe(F.col("_old"))
    return j.withColumn(updated_col, F.when(same, F.col("_old_upd")).otherwise(as_of)).drop("_old", "_old_upd")


# ---- U-5 update by key ----------------------------------------------------------------------
def update_by_key(store: DataFrame, updates: DataFrame, key: str, set_cols: list[str]) -> DataFrame:
    """UPDATE store SET cols = updates.cols WHERE key matches.  A match flag
    (not coalesce) decides, so an update to NULL really sets NULL."""
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in set_cols], F.lit(True).alias("_hit"))
    j = store.join(u, key, "left")
    out = j.withColumns({c: F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)) for c in set_cols})
    return out.drop("_hit", *[f"_u_{c}" for c in set_cols])


# ---- U-6 / J-11 / J-12 / A-15 retention -----------------------------------------------------------
def retention_keep(df: DataFrame, ts_col: str, days: int, as_of: Column) -> Column:
    """Rows younger than ``days`` (rows without a time are kept)."""
    return F.col(ts_col).isNull() | (F.col(ts_col) >= F.timestamp_add("DAY", F.lit(-days), as_of))


def retention_purge(news: DataFrame, days: int, as_of: Column, ts_col: str = "published_at") -> tuple[DataFrame, DataFrame]:
    """(kept, removed) news rows."""
    keep = retention_keep(news, ts_col, days, as_of)
    return news.filter(keep), news.filter(~keep)


def retention_days(config: DataFrame, key: str, default: int = S.DEFAULT_RETENTION_DAYS) -> Column:
    """Days that the configuration table gives for ``key`` (a scalar subquery,
    nothing is collected); ``default`` if the key is absent or no integer."""
    days = config.filter(F.col("config_key") == key).agg(F.max(F.col("config_value").try_cast("int")))
    return F.coalesce(days.scalar(), F.lit(default))


def purge_by_config(tables: dict[str, tuple[DataFrame, str, str]], config: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """D-16: of each ``name -> (rows, time column, config key)`` the rows that
    are younger than the configured days (rows without a time stay)."""
    return {name: df.filter(F.col(col).isNull() | (F.col(col) >= F.timestamp_add("DAY", -retention_days(config, key), as_of)))
            for name, (df, col, key) in tables.items()}


def cascade_purge(children: DataFrame, kept_parents: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Children survive only with a surviving parent (ON DELETE CASCADE)."""
    return children.join(kept_parents.select(F.col(pk).alias(fk)), fk, "left_semi")


def set_null_purge(news: DataFrame, kept_sources: DataFrame, fk: str = "source_id") -> DataFrame:
    """Deleting a source keeps its news with a NULL reference (ON DELETE SET NULL)."""
    k = kept_sources.select(F.col("id").alias(fk), F.lit(True).alias("_alive"))
    j = news.join(k, fk, "left")
    return j.withColumn(fk, F.when(F.col("_alive"), F.col(fk))).drop("_alive").select(*news.columns)


# ---- U-6 / J-11 / A-15 / D-16 on stored tables: whole months go, one is rewritten ------------------
MONTH = "yyyymm"


def _months(spark: SparkSession, path: str) -> dict[int, str]:
    """month -> folder of a table stored by month, from the file system's listing alone."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = {str(s.getPath().getName()): str(s.getPath()) for s in fs.listStatus(root) if s.isDirectory()}
    return {int(n.split("=")[1]): p for n, p in names.items() if n.startswith(f"{MONTH}=") and n.split("=")[1].isdigit()}


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _rewrite_month(spark: SparkSession, path: str, month: int, rows: DataFrame, keep: Column) -> int:
    """The month keeps the rows of ``keep``; returns how many it lost, counted by
    the write itself.  They are staged first, because a folder that is read is
    never overwritten; a run that fails in between can be repeated.  A month that
    loses nothing is not touched."""
    import uuid

    from pyspark.sql import Observation

    seen = Observation(f"purge-{uuid.uuid4().hex[:8]}")
    staged = f"{path.rstrip('/')}/_staged-{month}-{uuid.uuid4().hex[:8]}"
    flagged = rows.withColumn("_keep", F.coalesce(keep, F.lit(False))).observe(seen, F.count_if(~F.col("_keep")).alias("lost"))
    kept = flagged.filter("_keep").drop("_keep", "_alive")
    kept.write.parquet(staged)
    lost = seen.get["lost"]
    if lost:
        spark.read.schema(kept.schema).parquet(staged).withColumn(MONTH, F.lit(month)).write.option(
            "partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(MONTH).parquet(path)
        if not spark.read.schema(kept.schema).parquet(staged).limit(1).count():  # nothing is left to overwrite it with
            _drop(spark, _months(spark, path)[month])
    _drop(spark, staged)
    return lost


def write_by_month(df: DataFrame, path: str, ts_col: str) -> None:
    """Rows stored by the month of ``ts_col``, a time or a date (rows without one in a folder of their own)."""
    df.withColumn(MONTH, C.yyyymm(C.day(ts_col))).write.partitionBy(MONTH).parquet(path)


def purge_stored(spark: SparkSession, path: str, ts_col: str, cutoff: Column, children: dict[str, tuple[str, str]] | None = None,
                 name: str = "raw_news", pk: str = "id") -> DataFrame:
    """Purges, in place, a table stored by the month of ``ts_col`` of all rows
    before ``cutoff``, and from its ``children`` (name -> (path, foreign key),
    stored by their parent's month) all rows of removed parents.

    Months before the cutoff's go as whole folders: nothing of them is read but
    the row counts in the file footers.  Only the cutoff's month is rewritten, the
    children's by a semi join with the ids that stay in it.  Later months and rows
    without a time keep their files.  Returns (table_name, records_processed,
    months_dropped), the rows removed as the writes themselves counted them."""
    when, boundary = spark.range(1).select(cutoff.alias("c"), C.yyyymm(C.day(cutoff)).alias("m")).first()
    if when is None:
        raise ValueError("no cutoff")
    children = children or {}

    def read(at: str) -> DataFrame:
        return spark.read.parquet(at)

    parents = _months(spark, path)
    lost = {name: 0}
    dropped = {n: [] for n in (name, *children)}
    if boundary in parents:  # children first: a run that fails can be repeated
        month = read(parents[boundary])
        alive = month.filter(F.col(ts_col) >= cutoff).select(F.col(pk).alias("_pk")).withColumn("_alive", F.lit(True))
        for child, (at, fk) in children.items():
            folder = _months(spark, at).get(boundary)
            if folder:
                rows = read(folder)
                flagged = rows.join(alive, rows[fk] == alive["_pk"], "left").drop("_pk")
                lost[child] = _rewrite_month(spark, at, boundary, flagged, F.col("_alive"))
        lost[name] = _rewrite_month(spark, path, boundary, month, F.col(ts_col) >= cutoff)
    for table, at in ((name, path), *((c, p) for c, (p, _) in children.items())):
        old = {m: f for m, f in _months(spark, at).items() if m < boundary}
        if old:
            lost[table] = lost.get(table, 0) + read(at).where(F.col(MONTH) < boundary).count()
        for m, folder in sorted(old.items()):
            _drop(spark, folder)
            dropped[table].append(m)
    out = [(t, lost.get(t, 0), dropped[t]) for t in (name, *children)]
    return spark.createDataFrame(out, "table_name string, records_processed long, months_dropped array<int>")


# ---- S-8 partitioned wide fact --------------------------------------------------------------
def write_partitioned_fact(fact: DataFrame, path: str, date_col: str = "date", id_col: str = "news_id",
                           mode: str = "append") -> None:
    """Month partitions, each file sorted by (date, id) so row-group min/max
    statistics prune reads on date and id.

    Range partitioning on (month, date, id) gives every task one contiguous
    key range: a hot month is split over many tasks (never one task per
    month) and the files of a month do not overlap in (date, id)."""
    (fact.withColumn("yyyymm", C.yyyymm(date_col))
     .repartitionByRange("yyyymm", date_col, id_col)
     .sortWithinPartitions("yyyymm", date_col, id_col)  # the writer sorts by month first: it keeps this order
     .write.mode(mode).partitionBy("yyyymm").parquet(path))


def read_fact_month(spark: SparkSession, path: str, yyyymm: int) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("yyyymm") == yyyymm)


# ---- S-9 stats snapshot with a time to live ------------------------------------------------------
def stats_snapshot(stats: DataFrame, as_of: Column, key: str = S.STATS_CACHE_KEY,
                   ttl_hours: int = S.STATS_CACHE_TTL_HOURS) -> DataFrame:
    """(cache_key, value, updated_at, expires_at); the value is the JSON that
    cache readers expect: total, avg_sentiment (six decimals), positive,
    neutral, negative, updated_at."""
    value = F.struct(
        F.col("news_count").alias("total"), F.col("avg_sentiment").cast("decimal(12,6)").alias("avg_sentiment"),
        F.col("positive_count").alias("positive"), F.col("neutral_count").alias("neutral"),
        F.col("negative_count").alias("negative"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"))
    return stats.select(F.lit(key).alias("cache_key"), F.to_json(value).alias("value"), as_of.alias("updated_at"),
                        F.timestamp_add("HOUR", F.lit(ttl_hours), as_of).alias("expires_at"))


def read_snapshot(snapshots: DataFrame, key: str, as_of: Column) -> DataFrame:
    return snapshots.filter((F.col("cache_key") == key) & (F.col("expires_at") > as_of))


# ---- W-1 run history fold ----------------------------------------------------------------------------
def job_log_fold(log: DataFrame, slot_us: int = 1_000_000, slots: int = 86_400) -> DataFrame:
    """Start records (status 'running' or NULL, one per run) and finish records
    (status 'success' / 'failed', per job) -> one row per run.  Records of any
    other status ('pending', 'cancelled') are runs that never started: a row of
    their own with that status, neither closed nor closing.

    A finish record closes every run of its job that started at or before
    it and is still open: the closing record of a run is the first finish
    record of the same job at or after its start (an as-of lookup).

    Done in running passes over three levels of time instead of a per-job
    window: the records of a job's slot (``slot_us`` microseconds: a second),
    the slots of a job's span (``slots`` slots: a day; one row per slot) and
    the spans of a job (one row per span).  At each level a running min in
    reverse time order finds the first finish: in the run's own slot, in a
    later slot of the span, in a later span.  So no task holds more than the
    records of one job's second, 86 400 seconds, or the days of a job,
    whatever the job's share of the log, and neither a burst nor one very old
    record changes that.  Any widths give the same result."""
    us = F.unix_micros(F.col("event_time").cast("timestamp"))  # monotone in event_time either way
    fin = F.when(F.col("is_finish"), F.struct("event_time", "status", "records_processed", "error_message"))
    x = (log.withColumn("is_finish", F.coalesce(F.col("status").isin("success", "failed"), F.lit(False)))
         .withColumn("_slot", F.floor(us / F.lit(slot_us))).withColumn("_fin", fin)
         .repartition("job_name", "_slot"))  # shared by the pass over records and the rows per slot
    # reverse time order; at equal times finishes come first, so they count for a start at that time
    w_in = (Window.partitionBy("job_name", "_slot").orderBy(F.col("event_time").desc(), F.col("is_finish").desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = x.withColumn("_close_in", F.min("_fin").over(w_in)).filter(~F.col("is_finish")).drop("_fin")

    def later(rows: DataFrame, within: list[str], at: str) -> Column:
        w = Window.partitionBy(*within).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, -1)
        return F.min("_first").over(w)

    # also for slots and spans holding only starts (min ignores their NULL _fin)
    per_slot = x.groupBy("job_name", "_slot").agg(F.min("_fin").alias("_first")).withColumn(
        "_span", F.floor(F.col("_slot") / F.lit(slots))).repartition("job_name", "_span")
    per_span = per_slot.groupBy("job_name", "_span").agg(F.min("_first").alias("_first"))
    later_span = per_span.select("job_name", "_span", later(per_span, ["job_name"], "_span").alias("_later_span"))
    later_slot = per_slot.withColumn("_later_slot", later(per_slot, ["job_name", "_span"], "_slot")).join(
        later_span, ["job_name", "_span"]).select(
        "job_name", "_slot", F.coalesce("_later_slot", "_later_span").alias("_later"))
    j = runs.join(later_slot, ["job_name", "_slot"], "left")
    started = F.coalesce(F.col("status") == "running", F.lit(True))
    close = F.when(started, F.coalesce(F.col("_close_in"), F.col("_later")))
    j = j.withColumn("_close", close)
    return j.select(
        "run_id", "job_name", F.col("event_time").alias("started_at"),
        F.coalesce(F.col("_close.status"), F.col("status"), F.lit("running")).alias("status"),
        F.col("_close.event_time").alias("completed_at"),
        C.duration_ms(F.col("event_time"), F.col("_close.event_time")).alias("duration_ms"),
        F.coalesce(F.col("_close.records_processed"), F.lit(0)).alias("records_processed"),
        F.col("_close.error_message").alias("error_message"),
    )


# ---- D-18 processing lag: exact quantiles from counts ------------------------------------------
def exact_quantiles(values: DataFrame, col: str, qs: dict[str, float], mean_name: str | None = None,
                    scale: float = 1.0) -> DataFrame:
    """Exact linear-interpolated quantiles (as percentile_cont) of an integer
    column, divided by ``scale`` on output.  One output row, one lazy plan.

    Distributed selection, so no task ever holds all rows or all distinct
    values: rows are counted per distinct value (partial aggregation); equal
    bins of width sqrt(span), span = max - min + 1, give at most sqrt(span)
    bins of at most sqrt(span) distinct values; bin totals give each bin's
    rank offset; only the few bins that hold a wanted rank are ranked inside,
    each in its own task."""
    counts = values.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    lo, hi = F.min(col).cast("decimal(20,0)"), F.max(col).cast("decimal(20,0)")
    limits = counts.agg(F.struct(lo.alias("lo"), F.ceil(F.sqrt(hi - lo + 1)).alias("width")).alias("l")).scalar()
    bin_no = F.floor((F.col(col) - limits["lo"]) / limits["width"]).cast("long")
    binned = counts.withColumn("_b", bin_no)
    per_bin = binned.groupBy("_b").agg(F.sum("_c").alias("_bc"), F.sum(F.col(col) * F.col("_c")).alias("_bs"))
    everything = Window.partitionBy()  # over one row per bin
    offsets = per_bin.select(
        "_b", "_bc", (F.sum("_bc").over(Window.orderBy("_b")) - F.col("_bc")).alias("_off"),
        F.sum("_bc").over(everything).alias("_n"), F.sum("_bs").over(everything).alias("_s"))
    n = F.col("_n")
    targets = {}
    for name, q in qs.items():
        pos = (n - 1).cast("double") * F.lit(q)
        targets[name] = (F.floor(pos), F.ceil(pos), pos - F.floor(pos))
    hit = F.lit(False)
    for lo, hi, _ in targets.values():
        for r in (lo, hi):
            hit = hit | ((F.col("_off") <= r) & (r < F.col("_off") + F.col("_bc")))
    needed = offsets.filter(hit).select("_b", "_off", "_n", "_s")  # at most 2 rows per quantile
    ranked = binned.join(F.broadcast(needed), "_b").select(
        col, "_c", "_n", "_s", (F.col("_off") + F.sum("_c").over(Window.partitionBy("_b").orderBy(col))).alias("_cum"))
    ranked = ranked.withColumn("_lo", F.col("_cum") - F.col("_c"))
    aggs = [F.max("_n").alias("_n"), F.max("_s").alias("_s")]
    for name, (lo, hi, _) in targets.items():
        for tag, r in (("lo", lo), ("hi", hi)):
            aggs.append(F.max(F.when((F.col("_lo") <= r) & (r < F.col("_cum")), F.col(col))).alias(f"_{tag}_{name}"))
    a = ranked.agg(*aggs)
    outs = [F.coalesce(n, F.lit(0)).alias("n")]
    if mean_name:
        outs.append((F.col("_s") / (n * F.lit(scale))).alias(mean_name))
    for name, q in qs.items():
        pos = (n - 1).cast("double") * F.lit(q)
        f = pos - F.floor(pos)
        lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        outs.append(((lo + f * (hi - lo)) / F.lit(scale)).alias(name))
    return a.select(*outs)


def processing_lag(news: DataFrame, results: DataFrame) -> DataFrame:
    """published -> analysed lag in minutes: count, mean, exact median and p95."""
    j = news.select(F.col("id").alias("news_id"), "published_at").join(results.select("news_id", "analyzed_at"), "news_id")
    lag = j.select(F.timestamp_diff("SECOND", F.col("published_at"), F.col("analyzed_at")).alias("lag_s"))
    return exact_quantiles(lag, "lag_s", {"median_lag_min": 0.5, "p95_lag_min": 0.95}, mean_name="mean_lag_min", scale=60.0)


# ---- D-12 emotions --------------------------------------------------------------------------------------
def emotion_breakdown(df: DataFrame, json_col: str = "emotions", id_col: str = "news_id") -> tuple[DataFrame, DataFrame]:
    """(mean per emotion, strongest emotion per news) from a JSON map of scores."""
    m = df.select(id_col, F.from_json(F.col(json_col), "map<string,double>").alias("m"))
    rows = m.select(id_col, F.explode("m").alias("emotion", "score"))
    per_emotion = rows.groupBy("emotion").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"))
    strongest = rows.groupBy(id_col).agg(F.max_by("emotion", F.struct("score", F.col("emotion"))).alias("top_emotion"),
                                         F.max("score").alias("top_score"))
    return per_emotion, strongest
