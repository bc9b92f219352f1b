from tidings.operators import ingest as I

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _copies(spark):
    # one text copied 3000 times (a third of the rows), the rest unique
    rows = [(i, 1, "hot" if i % 3 == 0 else f"t{i}", "some text of enough length to pass the filter" * 2, 90)
            for i in range(9000)]
    return spark.createDataFrame(rows, "id long, source_id int, external_id string, content string, n_chars int")


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_copies_are_split_by_aqe(spark):
    news = _copies(spark)
    plain = sorted(map(tuple, I.quality_filter(news).collect()))
    assert sum(1 for r in plain if r[2] == "duplicate") == 2999
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        for q in (I.quality_filter(news),
                  I.mark_new(news, news.filter("id % 2 = 0"), ["source_id", "external_id"]),
                  I.anti_join_existing(news, news.filter("id > 8000"), ["source_id", "external_id"])):
            assert "skew=true" in _final_plan(q)
        assert sorted(map(tuple, I.quality_filter(news).collect())) == plain
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_join_backs_keep_null_key_semantics(spark):
    entries = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, 1, "a"), (4, 1, "a"), (5, 2, "b")],
                                    "id long, source_id int, external_id string")
    stored = spark.createDataFrame([(9, None, "a"), (8, 2, "b")], "id long, source_id int, external_id string")
    kept = sorted(r.id for r in I.anti_join_existing(entries, stored, ["source_id", "external_id"]).collect())
    assert kept == [1, 2, 3, 4]  # NULL keys never match a stored key
    new = {r.id: r.is_new for r in I.mark_new(entries, stored, ["source_id", "external_id"]).collect()}
    assert new == {1: True, 2: True, 3: True, 4: False, 5: False}
