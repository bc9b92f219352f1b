import numpy as np
from pyspark.sql import functions as F

from tidings.operators import writes as W
from tidings.sources.fixtures import ts


def test_upsert_last_wins_keeps_first_created(spark):
    old = spark.createDataFrame([(1, 0.1, 1, "2024-01-01"), (2, 0.2, 1, "2024-01-01")], "news_id long, s double, version int, created_at string")
    new = spark.createDataFrame([(1, 0.9, 2, "2024-01-05"), (3, 0.3, 2, "2024-01-05"), (3, 0.4, 3, "2024-01-06")],
                                "news_id long, s double, version int, created_at string")
    got = {r.news_id: (r.s, r.version, r.created_at) for r in W.upsert_last_wins(old, new, "news_id", "version").collect()}
    assert got == {1: (0.9, 2, "2024-01-01"), 2: (0.2, 1, "2024-01-01"), 3: (0.4, 3, "2024-01-05")}


def test_touch_updated_at_only_on_change(spark):
    old = spark.createDataFrame([(1, "a", None, "t0"), (2, "b", 1, "t0")], "k long, x string, y int, updated_at string")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 2), (3, "c", 3)], "k long, x string, y int")
    got = {r.k: r.updated_at for r in W.touch_updated_at(old, new, "k", ["x", "y"], F.lit("now")).collect()}
    assert got == {1: "t0", 2: "now", 3: "now"}


def test_update_by_key_can_set_null(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    upd = spark.createDataFrame([(1, None)], "id long, v string")
    assert {r.id: r.v for r in W.update_by_key(store, upd, "id", ["v"]).collect()} == {1: None, 2: "b"}


def test_purges(spark):
    news = spark.createDataFrame([(1, 1, "2024-01-30 00:00:00"), (2, 2, "2023-01-01 00:00:00"), (3, 2, None)],
                                 "id long, source_id int, p string").select("id", "source_id", F.col("p").cast("timestamp_ntz").alias("published_at"))
    kept, removed = W.retention_purge(news, 90, ts("2024-01-31 00:00:00"))
    assert sorted(r.id for r in kept.collect()) == [1, 3] and [r.id for r in removed.collect()] == [2]
    kids = spark.createDataFrame([(1, "x"), (2, "y")], "news_id long, v string")
    assert [r.news_id for r in W.cascade_purge(kids, kept, "news_id").collect()] == [1]
    sources = spark.createDataFrame([(1,)], "id int")
    got = {r.id: r.source_id for r in W.set_null_purge(news, sources).collect()}
    assert got == {1: 1, 2: None, 3: None}


def test_job_log_fold(spark):
    rows = [(1, "j", "2024-01-01 00:00:00", "running", None, None),
            (2, "j", "2024-01-01 00:01:00", "running", None, None),
            (9, "j", "2024-01-01 00:02:00", "success", 10, None),
            (3, "j", "2024-01-01 00:03:00", "running", None, None),
            (4, "k", "2024-01-01 00:00:00", "running", None, None),
            (8, "k", "2024-01-01 00:05:00", "failed", None, "boom")]
    df = spark.createDataFrame(rows, "run_id long, job_name string, t string, status string, records_processed int, error_message string")
    df = df.select("run_id", "job_name", F.col("t").cast("timestamp_ntz").alias("event_time"), "status", "records_processed", "error_message")
    got = {r.run_id: (r.status, r.duration_ms, r.records_processed, r.error_message) for r in W.job_log_fold(df).collect()}
    assert got == {1: ("success", 120000, 10, None), 2: ("success", 60000, 10, None), 3: ("running", None, 0, None),
                   4: ("failed", 300000, 0, "boom")}


def test_job_log_fold_exact_for_any_slot_width(spark):
    import datetime as dt
    import random

    rnd = random.Random(5)
    rows, rid = [], 0
    for job, n in (("hot", 600), ("a", 40), ("b", 25)):
        for _ in range(n):
            rid += 1
            t = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randrange(0, 20000))
            st = rnd.choice(["running", "running", "success", "failed"])
            rows.append((rid, job, t, st, rid if st == "success" else None, "e" if st == "failed" else None))
    df = spark.createDataFrame(rows, "run_id long, job_name string, event_time timestamp_ntz, status string, "
                                     "records_processed int, error_message string")
    want = {}
    for rid, job, t, st, rp, em in rows:
        if st != "running":
            continue
        fins = sorted((f[2], f[0]) for f in rows if f[1] == job and f[3] != "running" and f[2] >= t)
        if not fins:
            want[rid] = ("running", None, 0)
            continue
        # earliest finish at or after the start; among equal times the lowest struct wins
        ft = fins[0][0]
        cands = [f for f in rows if f[1] == job and f[3] != "running" and f[2] == ft]
        f = min(cands, key=lambda r: (r[3], -1 if r[4] is None else r[4], r[5] or ""))
        want[rid] = (f[3], int((ft - t).total_seconds() * 1000), f[4] or 0)
    for slot_us, slots in ((1, 10**9), (10**6, 86_400), (10**8, 7), (10**15, 1)):
        got = {r.run_id: (r.status, r.duration_ms, r.records_processed)
               for r in W.job_log_fold(df, slot_us, slots).collect()}
        assert got == want, slot_us


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = rng.integers(0, 500, size=2001).tolist() + [499] * 700  # a hot value
    df = spark.createDataFrame([(int(v),) for v in vals], "v long")
    r = W.exact_quantiles(df, "v", {"p50": 0.5, "p95": 0.95, "p10": 0.1}, mean_name="mean").first()
    a = np.array(vals, dtype=float)
    assert r.n == len(vals)
    assert abs(r.mean - a.mean()) < 1e-9
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p10", 0.1)):
        assert abs(getattr(r, name) - np.quantile(a, q)) < 1e-9


def test_exact_quantiles_of_wide_and_narrow_spans(spark):
    rng = np.random.default_rng(11)
    wide = rng.integers(-10**9, 10**9, size=3000).tolist() + [5] * 1500 + rng.integers(0, 40, size=500).tolist()
    qs = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for vals in (wide, [7], [3, 4], [-5] * 10 + [10**15]):
        r = W.exact_quantiles(spark.createDataFrame([(int(v),) for v in vals], "v long"), "v", qs).first()
        a = np.array(vals, dtype=float)
        assert r.n == len(vals)
        for name, q in qs.items():
            assert abs(getattr(r, name) - np.quantile(a, q)) <= 1e-6 * max(1.0, abs(np.quantile(a, q)))


def test_exact_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v long")
    r = W.exact_quantiles(df, "v", {"p50": 0.5}, mean_name="mean").first()
    assert r.n == 0 and r.p50 is None and r.mean is None


def test_snapshot_expires(spark, tables):
    from tidings.operators import stats as A

    at = ts("2024-01-30 12:00:00")
    snap = W.stats_snapshot(A.stats_24h(tables, as_of="2024-01-30 12:00:00"), at, "k")
    assert W.read_snapshot(snap, "k", ts("2024-01-30 12:59:59")).count() == 1
    assert W.read_snapshot(snap, "k", ts("2024-01-30 13:00:00")).count() == 0


def test_fact_files_are_sorted_and_a_month_read_is_pruned(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    fact = spark.range(4000).selectExpr("id * 7919 % 4000 AS news_id", "date_add(DATE'2024-01-01', cast(id * 31 % 90 as int)) AS date", "id AS v")
    W.write_partitioned_fact(fact, str(tmp_path / "fact"))
    for f in glob.glob(str(tmp_path / "fact" / "*" / "*.parquet")):
        rows = list(zip(*pq.ParquetFile(f).read(["date", "news_id"]).to_pydict().values()))
        assert rows == sorted(rows)
    month = W.read_fact_month(spark, str(tmp_path / "fact"), 202402)
    assert "PartitionFilters: [isnotnull(yyyymm" in month._jdf.queryExecution().executedPlan().toString()
    assert month.count() == fact.where("month(date) = 2").count()


def test_only_success_and_failed_close_runs(spark):
    log = spark.createDataFrame([
        (1, "j", "2024-01-01 00:00:00", "running"), (2, "j", "2024-01-01 00:01:00", "pending"), (3, "j", "2024-01-01 00:02:00", None),
        (4, "j", "2024-01-01 00:03:00", "cancelled"), (5, "j", "2024-01-01 00:04:00", "success"), (6, "j", "2024-01-01 00:05:00", "running")],
        "run_id long, job_name string, event_time string, status string").selectExpr(
        "run_id", "job_name", "cast(event_time AS timestamp_ntz) AS event_time", "status", "7 AS records_processed", "cast(null AS string) AS error_message")
    got = {r.run_id: (r.status, str(r.completed_at)) for r in W.job_log_fold(log).collect()}
    end = "2024-01-01 00:04:00"
    assert got == {1: ("success", end), 2: ("pending", "None"), 3: ("success", end), 4: ("cancelled", "None"), 6: ("running", "None")}


def test_one_old_record_or_a_burst_fills_no_window(spark):
    """100 000 records within ten minutes and one 30 years older: no window is
    over a job's records, and the result is that of a single slot."""
    log = spark.range(100_000).selectExpr(
        "id AS run_id", "'j' AS job_name", "timestampadd(MILLISECOND, cast(id * 6 AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS event_time",
        "CASE WHEN id % 100 = 99 THEN 'success' ELSE 'running' END AS status", "1 AS records_processed", "cast(null AS string) AS error_message")
    old = spark.range(1).selectExpr("-1L AS run_id", "'j' AS job_name", "TIMESTAMP_NTZ'1994-01-01 00:00:00' AS event_time", "'running' AS status",
                                    "0 AS records_processed", "cast(null AS string) AS error_message")
    log = log.unionByName(old)
    got = W.job_log_fold(log)
    assert got.filter("completed_at IS NULL").count() == 0 and got.count() == 99_001
    assert got.filter("run_id = -1").first().completed_at == got.filter("run_id = 0").first().completed_at
    assert got.exceptAll(W.job_log_fold(log, 10**16, 1)).count() == 0
    per_second = log.groupBy(F.date_trunc("second", "event_time")).count().agg(F.max("count")).first()[0]
    assert per_second < 200  # what the record window of a task group holds


def test_purge_by_config_reads_days_per_table(spark):
    config = spark.createDataFrame([("a_days", "20"), ("b_days", "x")], "config_key string, config_value string")
    rows = spark.createDataFrame([(1, "2024-01-30"), (2, "2024-01-01"), (3, "2023-01-01"), (4, None)], "id int, d string").select(
        "id", F.col("d").cast("timestamp_ntz").alias("t"))
    kept = W.purge_by_config({"a": (rows, "t", "a_days"), "b": (rows, "t", "b_days"), "c": (rows, "t", "none")}, config, ts("2024-01-31 00:00:00"))
    assert {k: sorted(r.id for r in v.collect()) for k, v in kept.items()} == {"a": [1, 4], "b": [1, 2, 4], "c": [1, 2, 4]}


def test_equal_updates_and_null_keys(spark):
    """Of equal versions one and the same row stays however the rows are dealt; NULL keys never meet."""
    from tidings.operators import writes as W

    old = spark.createDataFrame([(1, "old", 1, "t0"), (None, "n0", 1, "t0")], "k long, v string, version int, created_at string")
    new = spark.createDataFrame([(1, f"u{i}", 1, f"t{i}") for i in range(20)] + [(None, "n1", 1, "t1"), (None, "n1", 1, "t1")], old.schema)
    found = {tuple(sorted(map(str, W.upsert_last_wins(old, new.orderBy(order).repartition(n), "k", "version").collect())))
             for n in (1, 3, 8) for order in ("v", "created_at")}
    assert len(found) == 1
    rows = found.pop()
    assert len(rows) == 4 and sum("k=None" in r for r in rows) == 3 and any("k=1" in r and "v='u" in r and "created_at='t0'" in r for r in rows)


def _files(path):
    import os

    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_purge_drops_whole_months_and_leaves_other_files_alone(spark):
    import tempfile
    from datetime import datetime, timedelta

    from tidings.operators import writes as W
    from tidings.sources.fixtures import ts

    start = datetime(2023, 10, 1)
    rows = [(i, start + timedelta(hours=9 * i)) for i in range(400)] + [(1000, None), (1001, None)]
    news = spark.createDataFrame(rows, "id long, published_at timestamp_ntz")
    kids = spark.createDataFrame([(i % 400, f"r{i}", rows[i % 400][1]) for i in range(900)] + [(1000, "x", None)],
                                 "news_id long, what string, published_at timestamp_ntz")
    root = tempfile.mkdtemp()
    parent, child = f"{root}/news", f"{root}/kids"
    W.write_by_month(news, parent, "published_at")
    W.write_by_month(kids, child, "published_at")
    before = _files(parent), _files(child)
    cut = datetime(2024, 1, 11, 6)
    gone = {i for i, at in rows if at and at < cut}
    log = {r.table_name: r for r in W.purge_stored(spark, parent, "published_at", ts("2024-01-11 06:00:00"), {"kids": (child, "news_id")}).collect()}
    assert sorted(r.id for r in spark.read.parquet(parent).collect()) == sorted(i for i, _ in rows if i not in gone)
    assert sorted(r.what for r in spark.read.parquet(child).collect()) == sorted([f"r{i}" for i in range(900) if i % 400 not in gone] + ["x"])
    assert log["raw_news"].records_processed == len(gone) and log["kids"].records_processed == sum(i % 400 in gone for i in range(900))
    assert log["raw_news"].months_dropped == log["kids"].months_dropped == [202310, 202311, 202312]
    for old, path in zip(before, (parent, child)):
        untouched = {f: t for f, t in old.items() if f.split("/")[0] not in ("yyyymm=202310", "yyyymm=202311", "yyyymm=202312", "yyyymm=202401")}
        assert untouched and untouched.items() <= _files(path).items()
        assert not any(f.startswith("yyyymm=2023") for f in _files(path))
    # again: nothing to remove, no file is touched; then the whole boundary month goes
    after = _files(parent), _files(child)
    again = W.purge_stored(spark, parent, "published_at", ts("2024-01-11 06:00:00"), {"kids": (child, "news_id")}).collect()
    assert all(r.records_processed == 0 and r.months_dropped == [] for r in again) and (_files(parent), _files(child)) == after
    W.purge_stored(spark, parent, "published_at", ts("2024-02-01 00:00:00"), {"kids": (child, "news_id")})
    W.purge_stored(spark, parent, "published_at", ts("2024-02-28 23:00:00"), {"kids": (child, "news_id")})
    left = sorted(r.id for r in spark.read.parquet(parent).collect())
    assert left == sorted(i for i, at in rows if at is None or at >= datetime(2024, 2, 28, 23))
    assert set(r.news_id for r in spark.read.parquet(child).collect()) <= set(left)


def test_purge_by_configured_days_of_a_stored_table(spark):
    import tempfile
    from datetime import datetime

    from tidings.operators import writes as W
    from tidings.sources.fixtures import ts

    config = spark.createDataFrame([("data_retention_days", "20")], "config_key string, config_value string")
    path = f"{tempfile.mkdtemp()}/t"
    news = spark.createDataFrame([(i, datetime(2024, 1, i)) for i in range(1, 31)], "id long, published_at timestamp_ntz")
    W.write_by_month(news, path, "published_at")
    cutoff = F.timestamp_add("DAY", -W.retention_days(config, "data_retention_days"), ts("2024-01-31 00:00:00"))
    log = W.purge_stored(spark, path, "published_at", cutoff).collect()
    assert [r.records_processed for r in log] == [10]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(11, 31))
