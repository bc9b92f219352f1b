from tidings.operators import sectors as G


def _fixture(spark):
    news = spark.createDataFrame(
        [(1, "the cat and the dog"), (2, "nothing here"), (3, None), (4, "dog bird fish"), (5, "fish")],
        "id long, content string")
    kw = spark.createDataFrame(
        [(10, "cat"), (10, "dog"), (11, "dog"), (11, "bird"), (11, "fish"), (12, "fish"), (12, "fish")],
        "sector_id int, word string")
    return news, kw


def _rows(df):
    return sorted((r.news_id, r.sector_id, round(r.relevance, 12), r.is_primary) for r in df.collect())


def test_tagging_relevance_primary_and_catch_all(spark):
    news, kw = _fixture(spark)
    got = _rows(G.sector_tagging(news, kw))
    assert got == [
        (1, 10, 1.0, True), (1, 11, round(1 / 3, 12), False),
        (2, -1, 0.0, True), (3, -1, 0.0, True),
        (4, 10, 0.5, False), (4, 11, 1.0, True), (4, 12, 1.0, False),
        (5, 11, round(1 / 3, 12), False), (5, 12, 1.0, True),
    ]


def test_long_keyword_lists_tag_like_short_ones(spark):
    """12,000 words of another sector that no text has, NULL ids, empty words."""
    news, kw = _fixture(spark)
    more = spark.createDataFrame([(99, f"\u0001{i}") for i in range(12_000)] + [(None, "a"), (99, ""), (99, None)], kw.schema)
    assert _rows(G.sector_tagging(news, kw.unionByName(more))) == _rows(G.sector_tagging(news, kw))
    pairs = lambda k: sorted(map(tuple, G.theta_join_keyword(news, k, "content").collect()))
    assert pairs(kw.unionByName(more)) == pairs(kw)


def test_no_text_is_shuffled(spark):
    news, kw = _fixture(spark)
    more = spark.range(5000).selectExpr("99 AS sector_id", "concat('w', id) AS word")
    for words in (kw, kw.unionByName(more)):
        plan = G.sector_tagging(news, words)._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        below = [lines[i + 1] for i, line in enumerate(lines) if " Exchange " in line]
        # every exchange sends partial aggregates of narrow keys
        assert below and all("HashAggregate(keys=" in x and "content" not in x and "_t#" not in x for x in below)


def test_seed_sector_lists_on_sample_texts(spark):
    kw = G.seed_sector_keywords(spark)
    news = spark.createDataFrame([
        (1, "芯片公司发布新软件，AI 投资升温"),       # tech 3/5, finance 1/5
        (2, "新能源与光伏电力项目获得银行贷款"),       # energy: 能源, 新能源, 光伏, 电力 = 4/4; finance 1/5
        (3, "weather report without any sector word"),
    ], "id long, content string")
    got = {(r.news_id, r.sector_id): (round(r.relevance, 6), r.is_primary) for r in G.sector_tagging(news, kw).collect()}
    assert got == {
        (1, 1): (0.6, True), (1, 2): (0.2, False),
        (2, 5): (1.0, True), (2, 2): (0.2, False),
        (3, -1): (0.0, True),
    }
    # the J-6 theta join sees the same matches
    pairs = {(r.news_id, r.sector_id) for r in G.theta_join_keyword(news, kw, "content").collect()}
    assert pairs == {k for k in got if k[1] != -1}
