from pyspark.sql import functions as F

from tidings.operators import ingest as I
from tidings.operators.topn import top_n_per_group


def test_null_keys_never_collide_and_first_writer_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, None, "a"), (4, None, "a"), (5, 2, "a"), (0, 2, "a")],
                               "id long, source_id int, external_id string")
    got = sorted(r.id for r in I.dedupe_first_wins(df, ["source_id", "external_id"], "id").collect())
    assert got == [0, 1, 3, 4]


def test_insert_or_ignore_skips_stored_keys(spark):
    stored = spark.createDataFrame([(1, 1, "a"), (2, None, "b")], "id long, source_id int, external_id string")
    incoming = spark.createDataFrame([(3, 1, "a"), (4, None, "b"), (5, 1, "c"), (6, 1, "c")], "id long, source_id int, external_id string")
    got = sorted(r.id for r in I.insert_or_ignore(stored, incoming, ["source_id", "external_id"], "id").collect())
    assert got == [1, 2, 4, 5]


def test_mark_new(spark):
    stored = spark.createDataFrame([(1, 1, "a")], "id long, source_id int, external_id string")
    entries = spark.createDataFrame([(3, 1, "a"), (4, None, "b"), (5, 1, "c"), (6, 1, "c")], "id long, source_id int, external_id string")
    got = {r.id: r.is_new for r in I.mark_new(entries, stored).collect()}
    assert got == {3: False, 4: True, 5: True, 6: False}


def test_validation_reasons(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, 50, "positive"), (None, 1.5, 0.5, 101, "meh"), (2, None, None, None, None)],
                               "news_id long, sentiment_score double, confidence double, market_impact_score int, sentiment_label string")
    got = [r.reasons for r in I.validate_rows(df, I.sentiment_checks()).collect()]
    assert got[0] == []
    assert got[1] == ["news_id_null", "score_range", "impact_range", "label_enum"]
    assert got[2] == ["score_range", "confidence_range", "label_enum"]  # an impact may be NULL
    valid, rejects = I.split_valid(df, I.sentiment_checks())
    assert valid.columns == df.columns and valid.count() == 1 and [len(r.reasons) for r in rejects.collect()] == [4, 3]


def test_top_n_per_group_exact_under_skew(spark):
    """One feed holds most rows: the salted ranking equals brute force, with
    and without the partial group limit."""
    rows = [("hot", i) for i in range(3000)] + [(f"f{k}", k * 7 + j) for k in range(20) for j in range(30)]
    df = spark.createDataFrame(rows, "feed string, pos long").repartition(6)
    expect = {}
    for f, p in rows:
        expect.setdefault(f, []).append(p)
    for threshold in ("1000", "5"):  # 5 < n: no partial limit
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
        try:
            got = top_n_per_group(df, ["feed"], [F.col("pos").asc()], 20, salt_key=F.col("pos"), buckets=16)
            by_feed = {}
            for r in got.collect():
                by_feed.setdefault(r.feed, []).append((r._rank, r.pos))
        finally:
            spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
        for f, ps in expect.items():
            assert [p for _, p in sorted(by_feed[f])] == sorted(ps)[:20]


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([("hot", i) for i in range(100)], "feed string, pos long").repartition(4)
    plan = top_n_per_group(df, ["feed"], [F.col("pos").asc()], 5, salt_key=F.col("pos"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial (map side) and final


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "https://a.example.com:8080/x?y", '<html lang="de"><title>T\nx</title><a href="/1">a</a><a href="/2">b</a>')],
                               "page_id long, url string, html string")
    r = I.extract_pages(df).first()
    assert (r.host, r.title, r.lang, r.links, r.n_links) == ("a.example.com", "T\nx", "de", ["https://a.example.com:8080/1", "https://a.example.com:8080/2"], 2)


def test_parse_messages_flags_corrupt(spark):
    from tidings import schemas as S

    df = spark.createDataFrame([("1", '{"id": 1, "title": "t"}'), ("2", "not json {")], "key string, value string")
    got = {r.key: (r.is_corrupt, r.id) for r in I.parse_messages(df, S.NEWS_MESSAGE).collect()}
    assert got == {"1": (False, 1), "2": (True, None)}


def test_message_round_trip_keeps_nulls_and_microseconds(spark):
    import datetime as dt

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
                           T.StructField("published_at", T.TimestampNTZType())])
    rows = [(1, "a \"q\"\n", dt.datetime(2024, 1, 2, 3, 4, 5, 123456)), (2, None, None)]
    df = spark.createDataFrame(rows, schema)
    msgs = I.to_messages(df, "id")
    assert '"title":null' in {r.key: r.value for r in msgs.collect()}["2"]
    back = I.parse_messages(msgs, schema).filter(~F.col("is_corrupt")).select("id", "title", "published_at")
    assert sorted(map(tuple, back.collect())) == rows


def test_parse_messages_rejects_wrong_types_non_objects_and_bad_times(spark):
    from tidings import schemas as S

    bad = ["[1, 2]", "5", '"text"', '{"id": "abc"}', '{"title": "no key"}', '{"id": 1, "published_at": "garbage"}', '{"id": 1', "", None]
    good = ['{"id": 1}', '  {"id": 2, "published_at": "2026-03-05T07:07:04Z", "unknown": 3}', '{"id": 3, "published_at": null}']
    df = spark.createDataFrame([(v,) for v in bad + good], "value string")
    got = [(r.is_corrupt, r.id) for r in I.parse_messages(df, S.NEWS_MESSAGE).collect()]
    assert got == [(True, None)] * len(bad) + [(False, 1), (False, 2), (False, 3)]


def test_feeds_in_rss_and_atom(spark, tmp_path):
    (tmp_path / "feed=a").mkdir()
    (tmp_path / "feed=b").mkdir()
    (tmp_path / "feed=a" / "a.xml").write_text("""<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title>
<entry><id>1</id><title type="html">T &amp; t</title><link rel="self" href="http://a/self"/><link rel="alternate" href="http://a/1"/>
<author><name>Ann</name></author><author><name>Bob</name></author><summary>s</summary><content type="html">c</content>
<published>2024-01-05T10:00:00Z</published></entry>
<entry><title>no id</title><link href="http://a/2"/><summary>s2</summary><updated>2024-01-06T01:00:00+01:00</updated></entry></feed>""")
    (tmp_path / "feed=b" / "b.xml").write_text("""<?xml version="1.0"?><rss xmlns:dc="d" xmlns:content="c"><channel><title>Feed</title>
<item><title>R</title><link>http://b/1</link><description>d</description><content:encoded>full</content:encoded><dc:creator>Cy</dc:creator>
<pubDate>Fri, 5 Jan 2024 09:00:00 GMT</pubDate></item></channel></rss>""")
    got = I.read_feed_items(spark, str(tmp_path), F.lit("2024-02-01").cast("timestamp_ntz"))
    assert sorted((r.feed, r.guid, r.title, r.link, r.content, r.author, str(r.published)) for r in got.collect()) == [
        ("a", "1", "T & t", "http://a/1", "c", "Ann", "2024-01-05 10:00:00"),
        ("a", "http://a/2", "no id", "http://a/2", "s2", "", "2024-01-06 00:00:00"),
        ("b", "http://b/1", "R", "http://b/1", "full", "Cy", "2024-01-05 09:00:00")]


def test_strict_messages(spark):
    """Whatever is not one object with the schema's kinds of values is corrupt."""
    from tidings import schemas as S

    bad = ['{"id":1,"title":"a"} trailing', '{"id":2}{"id":3}', '{"id":1},{"id":2}', '{"id":1},null', '{"id":1}] x', '{"id":4,"title":5}',
           '{"id":5,"title":{"x":1}}', "{'id':13}", '{"id":1.0}', '{"id":1e2}', '{"id":"7"}', '{"id":99999999999999999999}', '{"id":null}',
           '{"title":"no key"}', "[1]", "5", '"x"', "", None, '{"id":01}', '{"id":1,}', '{"id":1 /* c */}', '{"id":NaN}', '{"id":1,"title":"a\tb"}',
           '{"id":1,"source_id":"3"}', '{"id":1,"source_id":true}', '{"id":1,"published_at":"garbage"}', '{"id":1,"published_at":5}', '{"id":1']
    good = {' {"id":1} ': (1, None, None), '{"id":2,"title":"t","x":[1]}': (2, "t", None), '{"id":3,"id":4,"title":null}': (4, None, None),
            '\n{"source_id":9,"id":5,"published_at":"2024-01-01T00:00:00Z"}': (5, None, 9), '{"id":-6,"title":"\\u00e9 {}],"}': (-6, "é {}],", None)}
    df = spark.createDataFrame([(v,) for v in [*bad, *good]], "value string")
    got = {r["value"]: r for r in I.parse_messages(df, S.NEWS_MESSAGE).collect()}
    assert {v for v, r in got.items() if r["is_corrupt"]} == set(bad)
    assert all(r["id"] is None and r["title"] is None for v, r in got.items() if v in bad)
    assert {v: (got[v]["id"], got[v]["title"], got[v]["source_id"]) for v in good} == good


def test_strict_nested_messages(spark):
    from tidings import schemas as S

    texts = {
        '{"news_id":1,"sentiment_score":1,"confidence":0.5,"keywords":["a",null],"market_impact_score":7,"original_data":{"id":1,"title":"t"}}': False,
        '{"news_id":1,"sentiment_score":1e-1,"original_data":null,"keywords":[]}': False,
        '{"news_id":1,"sentiment_score":"0.5"}': True, '{"news_id":1,"keywords":["a",1]}': True, '{"news_id":1,"keywords":"a"}': True,
        '{"news_id":1,"market_impact_score":2147483648}': True, '{"news_id":1,"original_data":{"id":"x"}}': True,
        '{"news_id":1,"original_data":[]}': True, '{"news_id":1,"original_data":{"id":1,"published_at":"x"}}': True,
    }
    df = spark.createDataFrame([(v,) for v in texts], "value string")
    got = {r["value"]: r for r in I.parse_messages(df, S.SENTIMENT_MESSAGE).collect()}
    assert {v: r["is_corrupt"] for v, r in got.items()} == texts
    first = got[next(iter(texts))]
    assert (first["sentiment_score"], first["keywords"], first["market_impact_score"], first["original_data"]["title"]) == (1.0, ["a", None], 7, "t")
