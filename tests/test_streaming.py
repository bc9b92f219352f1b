import tempfile

from pyspark.sql import functions as F

from tidings.functions import core as C
from tidings.operators import rollups as R
from tidings.sources.fixtures import scored_events_of
from tidings.streaming import jobs as J


def _land(tables, n_files=6):
    path = tempfile.mkdtemp(prefix="land-")
    tables.events.repartition(n_files).write.mode("overwrite").parquet(path + "/in")
    return path + "/in"


def test_stream_daily_stats_equals_batch_across_micro_batches(spark, tables):
    land = _land(tables)
    out, ck = tempfile.mkdtemp(), tempfile.mkdtemp()
    q = J.stream_daily_stats(scored_events_of(J.file_source(spark, land, "parquet", tables.events.schema, max_files=1)), out, ck)
    assert len(q.recentProgress) >= 2  # several micro-batches
    got = {r.stat_date: r for r in J.newest_by_key(J.appended(spark, out), ["stat_date"]).select("stat_date", *R.STATE_COLS).collect()}
    e = tables.scored_events
    want = {r.stat_date: r for r in R.finish_state(R.partial_state(e, [C.day("analyzed_at").alias("stat_date")])).select(
        "stat_date", *R.STATE_COLS).collect()}
    assert {k: tuple(v)[1:] for k, v in got.items()} == {k: tuple(v)[1:] for k, v in want.items()}


def test_replay_with_same_checkpoint_adds_nothing(spark, tables):
    land = _land(tables, 3)
    out, ck = tempfile.mkdtemp() + "/fact", tempfile.mkdtemp()
    src = lambda: scored_events_of(J.file_source(spark, land, "parquet", tables.events.schema, max_files=1))
    J.stream_append_fact(src(), out, ck)
    n1 = spark.read.parquet(out).count()
    J.stream_append_fact(src(), out, ck)  # restart: the checkpoint says everything is done
    assert spark.read.parquet(out).count() == n1 == tables.events.count()


RESULT = "news_id long, s double, version int, created_at string"


def _latest(spark, out):
    rows = J.latest_results(J.appended(spark, out), "news_id", "version")
    return {r.news_id: (r.s, r.version, r.created_at) for r in rows.collect()}


def test_upsert_stream_is_idempotent_under_redelivery(spark):
    land = tempfile.mkdtemp() + "/in"
    out, ck = tempfile.mkdtemp() + "/t", tempfile.mkdtemp()
    deliveries = [
        [(1, 0.1, 1, "t1"), (2, 0.2, 1, "t1"), (3, None, 1, None)],
        [(1, 0.9, 2, "t2"), (1, 0.9, 2, "t2"), (2, 0.2, 1, "t1")],
        [(1, 0.1, 1, "t3"), (2, 0.7, 1, "t3")],  # an old version again, and an equal one: the later delivery wins
    ]
    for i, rows in enumerate(deliveries):
        spark.createDataFrame(rows, RESULT).coalesce(1).write.parquet(f"{land}/p={i}")
        s = J.file_source(spark, land, "parquet", spark.createDataFrame([], RESULT).schema, max_files=1).drop("p")
        J.stream_upsert_result(s, out, ck)
    assert _latest(spark, out) == {1: (0.9, 2, "t1"), 2: (0.7, 1, "t1"), 3: (None, 1, None)}


def test_epoch_writes_only_its_own_rows(spark):
    import os

    out = tempfile.mkdtemp() + "/r"
    w = J.epoch_writer(out)
    w(spark.createDataFrame([(i, 0.1, 1, "t1") for i in range(40)], RESULT), 0)
    w(spark.createDataFrame([(7, 0.9, 2, "t2")], RESULT).coalesce(1), 1)
    assert spark.read.parquet(out + "/epoch=1").count() == 1
    assert len([f for f in os.listdir(out + "/epoch=1") if f.endswith(".parquet")]) == 1
    got = _latest(spark, out)
    assert len(got) == 40 and got[7] == (0.9, 2, "t1") and got[8] == (0.1, 1, "t1")
    w(spark.createDataFrame([(7, 0.9, 2, "t2")], RESULT).coalesce(1), 1)  # replayed epoch
    assert _latest(spark, out) == got
    # a base table made by a batch job stands for the epochs up to 1
    base = tempfile.mkdtemp() + "/base"
    J.latest_results(J.appended(spark, out), "news_id", "version").write.parquet(base)
    w(spark.createDataFrame([(8, 0.5, 3, "t3")], RESULT), 2)
    rows = J.appended(spark, out, spark.read.parquet(base), after=1)
    assert rows.count() == 41
    again = {r.news_id: (r.s, r.version, r.created_at) for r in J.latest_results(rows, "news_id", "version").collect()}
    assert again == _latest(spark, out) and again[8] == (0.5, 3, "t1")


DEDUP = "id long, source_id string, external_id string, published_at timestamp"
DEDUP_KEYS = ["source_id", "external_id"]


def _dedup(spark, land, polls, out, ck, start=0, **options):
    from datetime import datetime

    queries = []
    for i, rows in enumerate(polls, start):
        spark.createDataFrame([(*r[:3], datetime(*r[3]) if len(r) > 3 else None) for r in rows], DEDUP).repartition(2).write.parquet(f"{land}/p={i}")
        s = J.file_source(spark, land, "parquet", spark.createDataFrame([], DEDUP).schema).drop("p")
        queries.append(J.stream_dedup(s, DEDUP_KEYS, out, ck, **options))
    return queries


def test_stream_dedup_keeps_the_first_row_of_every_key(spark):
    land, out, ck = tempfile.mkdtemp() + "/in", tempfile.mkdtemp() + "/t", tempfile.mkdtemp()
    polls = [
        [(9, "1", "a", (2024, 3, 1)), (2, "1", "a", (2024, 1, 1)), (3, None, "a"), (4, None, "a"), (5, "2", None), (6, "2", None)],
        # far older rows of new keys stay, copies go, whatever their own time
        [(7, "3", "late", (2001, 1, 1)), (8, "1", "a", (2030, 1, 1)), (1, "1", "a", (2001, 1, 1)), (10, None, "a")],
        # keys that would be one if their parts were joined by a separator
        [(11, "a\u0001b", "c"), (12, "a", "b\u0001c"), (13, "a", "b\u0001c"), (14, "3", "late")],
    ]
    _dedup(spark, land, polls, out, ck)
    ids = lambda: sorted(r["id"] for r in J.appended(spark, out).collect())
    assert ids() == [2, 3, 4, 5, 6, 7, 10, 11, 12]
    _dedup(spark, land, [], out, ck)
    assert ids() == [2, 3, 4, 5, 6, 7, 10, 11, 12]


def test_stream_dedup_state_is_bounded_and_old_copies_still_go(spark):
    import time

    land, out, ck = tempfile.mkdtemp() + "/in", tempfile.mkdtemp() + "/t", tempfile.mkdtemp()
    state = []
    for poll in range(4):
        rows = [(poll * 100 + k, "s", f"k{poll}-{k}") for k in range(50)] + [(9000 + poll * 100 + k, "s", f"k{p}-{k}") for p in range(poll) for k in range(50)]
        q = _dedup(spark, land, [rows], out, ck, start=poll, span="1 second")[0]
        assert not any("window" in str(p.get("error", "")) for p in q.recentProgress)
        state.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:] if p["stateOperators"]))
        time.sleep(2.5)
    got = [r["id"] for r in J.appended(spark, out).collect()]
    assert sorted(got) == sorted(poll * 100 + k for poll in range(4) for k in range(50))
    # an epoch's rows and the span before it at most: not the 50 + 100 + 150 + 200 keys that came in
    assert state[-1] <= 200 + 150


def test_ingest_dedupes_across_epochs(spark):
    land = tempfile.mkdtemp() + "/in"
    schema = "id long, source_id int, external_id string"
    polls = [
        [(1, 1, "a"), (2, 1, "a"), (3, 2, "b"), (4, None, "a")],
        [(5, 1, "a"), (6, 2, "c"), (7, None, "a"), (0, 2, "b")],
        [(9, 2, "c"), (10, 3, "d")],
    ]
    out, ck = tempfile.mkdtemp() + "/t", tempfile.mkdtemp()
    for i, rows in enumerate(polls):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{land}/p={i}")
        s = J.file_source(spark, land, "parquet", spark.createDataFrame([], schema).schema).drop("p")
        J.run_available(s.writeStream.foreachBatch(J.ingest_batch_writer(out)), ck)
    stored = lambda: sorted(r.id for r in J.stored_news(J.appended(spark, out)).collect())
    assert stored() == [1, 3, 4, 6, 7, 10]
    J.ingest_batch_writer(out)(spark.createDataFrame(polls[2], schema), 2)  # replayed epoch
    assert stored() == [1, 3, 4, 6, 7, 10]
    base = tempfile.mkdtemp() + "/base"
    J.stored_news(J.appended(spark, out).filter("epoch <= 1")).write.parquet(base)
    rows = J.appended(spark, out, spark.read.parquet(base), after=1)
    assert sorted(r.id for r in J.stored_news(rows).collect()) == [1, 3, 4, 6, 7, 10]


def test_stream_ingest_reads_entries_like_the_collector(spark):
    import json

    land = tempfile.mkdtemp() + "/in"
    entry = {"id": 1, "source_id": 1, "guid": "g", "title": "t", "link": "l", "description": "d", "content": "c", "author": "a"}
    lines = [entry, {**entry, "id": 2}, {**entry, "id": 3, "guid": "", "content": None, "author": None}, {**entry, "id": 4, "guid": None},
             {**entry, "id": "x"}, {**entry, "id": 6, "published_at": "garbage"}]
    spark.createDataFrame([(f"k\t{json.dumps(x)}",) for x in lines], "value string").write.text(land)
    from tidings.plans.catalog_streaming import news_stream

    out, ck = tempfile.mkdtemp() + "/t", tempfile.mkdtemp()
    J.stream_ingest(news_stream(spark, land), out, ck)
    got = {r.id: (r.external_id, r.content, r.summary, r.author) for r in J.stored_news(J.appended(spark, out)).collect()}
    assert got == {1: ("g", "c", "d", "a"), 3: ("l", "d", "d", "")}


def test_hourly_window_keeps_late_rows(spark):
    out = tempfile.mkdtemp() + "/t"
    schema = "analyzed_at timestamp_ntz, source_name string, sentiment_score decimal(5,4), sentiment_label string"
    from datetime import datetime
    from decimal import Decimal

    w = J.epoch_writer(out)
    row = lambda t, s: (datetime.fromisoformat(t), "a", Decimal(s), "neutral")
    for n, rows in enumerate([[row("2024-01-01 05:10:00", "0.1")], [row("2024-03-01 05:10:00", "0.2")],
                              [row("2024-01-01 05:50:00", "0.2")]]):  # 60 days late
        w(J.hourly_state(spark.createDataFrame(rows, schema)), n)
    got = {str(r.hour): (r.news_count, r.score_sum) for r in J.hourly_stats(J.appended(spark, out)).collect()}
    assert got == {"2024-01-01 05:00:00": (2, 0.3), "2024-03-01 05:00:00": (1, 0.2)}


def test_polling_trigger(spark):
    import time

    land = tempfile.mkdtemp() + "/in"
    out, ck = tempfile.mkdtemp() + "/t", tempfile.mkdtemp()
    spark.createDataFrame([(1, 0.1, 1, "t1")], RESULT).coalesce(1).write.parquet(land)
    s = J.file_source(spark, land, "parquet", spark.createDataFrame([], RESULT).schema)
    q = J.stream_upsert_result(s, out, ck, every="300 seconds")
    try:
        assert q.isActive
        end = time.time() + 60
        while not q.recentProgress and time.time() < end:
            time.sleep(0.2)
    finally:
        q.stop()
    assert _latest(spark, out) == {1: (0.1, 1, "t1")}


def test_scored_stream_keeps_no_state(spark, tables):
    from tidings import schemas as S
    from tidings.plans.catalog_streaming import land_news_messages, news_stream

    land = tempfile.mkdtemp() + "/msgs"
    land_news_messages(tables, land, files=3)
    out, bad, ck = tempfile.mkdtemp(), tempfile.mkdtemp(), tempfile.mkdtemp()
    q = J.stream_score(news_stream(spark, land, max_files=1), S.NEWS_MESSAGE, tables.lexicon, out, ck, bad)
    assert all(not p["stateOperators"] for p in q.recentProgress)
    got = {r.news_id: r.sentiment_score for r in spark.read.parquet(out).collect()}
    from tidings.operators import scoring as G
    want = {r.id: r.sentiment_score for r in G.lexicon_score(tables.raw_news, tables.lexicon).filter(F.col("id") % 50 != 0).collect()}
    assert got == want
    assert spark.read.parquet(bad).count() == tables.raw_news.filter(F.col("id") % 50 == 0).count()


def test_messages_with_one_id_are_scored_apart(spark, tables):
    from tidings import schemas as S

    lines = [("a", '{"id": 1, "title": "the", "content": ""}'), ("b", '{"id": 1, "title": "her her", "content": null}'), ("c", "{")]
    out, bad = tempfile.mkdtemp(), tempfile.mkdtemp()
    J.score_writer(out, S.NEWS_MESSAGE, tables.lexicon, bad)(spark.createDataFrame(lines, "key string, value string"), 0)
    got = {r.original_data.title: float(r.sentiment_score) for r in spark.read.parquet(out).collect()}
    assert got == {"the": 1.0, "her her": -1.0}
    assert [r.key for r in spark.read.parquet(bad).collect()] == ["c"]


def test_streams_without_input_read_as_empty(spark, tables):
    from tidings import schemas as S
    from tidings.plans.catalog_streaming import news_stream

    land = tempfile.mkdtemp()
    t = lambda: tempfile.mkdtemp() + "/t"
    ingest, daily, upsert, hourly, dedup, scored, bad, stats = (t() for _ in range(8))
    events = scored_events_of(J.file_source(spark, land, "parquet", tables.events.schema))
    results = J.file_source(spark, land, "parquet", "news_id long, sentiment_score decimal(5,4), sentiment_label string, version int, analyzed_at timestamp, created_at string")
    J.stream_ingest(news_stream(spark, land), ingest, t())
    J.stream_daily_stats(events, daily, t())
    J.stream_upsert_result(results, upsert, t())
    J.stream_hourly_window(events, hourly, t())
    J.stream_dedup(J.file_source(spark, land, "parquet", DEDUP), DEDUP_KEYS, dedup, t())
    J.stream_score(news_stream(spark, land), S.NEWS_MESSAGE, tables.lexicon, scored, t(), bad)
    J.stream_result_stats(results, "news_id", "version", stats, t())
    for empty in (J.stored_news(J.appended(spark, ingest)), J.newest_by_key(J.appended(spark, daily), ["stat_date"]),
                  J.latest_results(J.appended(spark, upsert), "news_id", "version"), J.hourly_stats(J.appended(spark, hourly)),
                  J.appended(spark, dedup), J.appended(spark, scored), J.appended(spark, bad), J.result_stats(spark, stats)):
        assert empty.count() == 0 and len(empty.columns) > 2


def test_redelivered_and_rescored_results_count_once(spark):
    from datetime import datetime
    from decimal import Decimal

    schema = "news_id long, sentiment_score decimal(5,4), sentiment_label string, version int, analyzed_at timestamp, created_at string"
    row = lambda i, s, label, v, d: (i, None if s is None else Decimal(s), label, v, datetime(2024, 1, d), "t")
    deliveries = [
        [row(1, "0.5", "positive", 1, 1), row(2, "-0.5", "negative", 1, 1), row(3, None, "neutral", 1, 2), row(None, "0.1", "neutral", 1, 5)],
        [row(1, "0.5", "positive", 1, 1), row(2, "0.4", "positive", 2, 3)],  # replay, and a re-score on another day
        [row(2, "-0.5", "negative", 1, 1), row(1, "0.2", "neutral", 1, 1), row(1, "0.3", "neutral", 1, 1), row(4, "0.1", "neutral", 1, 1), row(4, "0.1", "neutral", 1, 1)],
        [row(3, "0.9", "positive", 2, 2), row(None, "0.1", "neutral", 1, 5)],
    ]
    land, out, ck = tempfile.mkdtemp() + "/in", tempfile.mkdtemp() + "/t", tempfile.mkdtemp()
    for i, rows in enumerate(deliveries):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{land}/p={i}")
        J.stream_result_stats(J.file_source(spark, land, "parquet", schema).drop("p"), "news_id", "version", out, ck)
        stored = J.appended(spark, f"{out}/results")
        kept = J.latest_results(stored.filter("news_id IS NOT NULL"), "news_id", "version").select("analyzed_at", "sentiment_score", "sentiment_label") \
            .unionByName(stored.filter("news_id IS NULL").select("analyzed_at", "sentiment_score", "sentiment_label"))
        want = R.finish_state(R.partial_state(kept, [C.day("analyzed_at").alias("stat_date")]))
        cols = ["stat_date", *R.STATE_COLS]
        assert sorted(map(tuple, J.result_stats(spark, out).select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    days = {r.stat_date.day: r.news_count for r in J.result_stats(spark, out).collect()}
    assert days == {1: 2, 2: 1, 3: 1, 5: 2}


def test_polls_are_bounded_by_records_and_a_failed_one_is_replayed(spark, tables):
    import pytest
    from tidings import schemas as S

    land, out, ck = tempfile.mkdtemp() + "/in", tempfile.mkdtemp() + "/t", tempfile.mkdtemp()
    sent = [(str(i), f'{{"id":{i},"title":"the","content":"tab \\\\t {i}"}}') for i in range(35)]
    for part in (sent[:23], sent[23:]):
        J.land_messages(spark.createDataFrame(part, "key string, value string").coalesce(1), land)
    write, failed = J.score_writer(out, S.NEWS_MESSAGE, tables.lexicon), []

    def once_broken(batch, epoch):
        write(batch, epoch)
        if epoch == 2 and not failed:
            failed.append(epoch)
            raise RuntimeError("the poll is lost after its write")

    stream = lambda: J.message_source(spark, land).writeStream.foreachBatch(once_broken)
    with pytest.raises(Exception, match="the poll is lost"):
        J.run_available(stream(), ck)
    J.run_available(stream(), ck)
    rows = J.appended(spark, out).select("epoch", "news_id", "original_data.content").collect()
    per_epoch = {}
    for r in rows:
        per_epoch.setdefault(r.epoch, []).append(r.news_id)
    assert sorted(r.news_id for r in rows) == list(range(35)) and all(len(x) <= J.POLL_RECORDS for x in per_epoch.values())
    assert len(per_epoch) >= 4 and set(per_epoch[0] + per_epoch[1] + per_epoch[2]) == set(range(23))  # the first delivery first
    assert rows[0].content.startswith("tab ")
