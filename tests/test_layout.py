from tidings.sources.layout import save_bucketed


def test_bucketed_tables_join_without_exchange(spark, tables):
    news = save_bucketed(tables.raw_news.select("id", "published_at").withColumnRenamed("id", "news_id"),
                         "t_news_b", "news_id", 8)
    sr = save_bucketed(tables.sentiment_results, "t_sentiment_b", "news_id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the shuffled join plan
    try:
        j = news.join(sr, "news_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == tables.raw_news.join(tables.sentiment_results, tables.raw_news.id == tables.sentiment_results.news_id).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
