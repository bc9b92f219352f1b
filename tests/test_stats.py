from pyspark.sql import functions as F

from tidings.operators import stats as A


def test_empty_period_gives_zeros(tables):
    r = A.sentiment_stats_ratio(tables, "24h", as_of="2030-01-01 00:00:00").first()
    assert r.news_count == 0 and r.avg_sentiment == 0.0 and r.positive_ratio == 0.0 and r.negative_ratio == 0.0


def test_label_counts_sum_to_scored_rows(tables):
    r = A.sentiment_stats(tables, "30d").first()
    scored = tables.sentiment_results.join(
        tables.raw_news.filter(F.col("published_at") >= F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).select(F.col("id").alias("news_id")),
        "news_id", "left_semi").count()
    assert r.positive_count + r.neutral_count + r.negative_count == scored


def test_sector_stats_keeps_sectors_without_news(tables):
    rows = A.sector_stats(tables, "24h").collect()
    assert len(rows) == tables.market_sectors.count()
    empty = [r for r in rows if r.news_count == 0]
    assert empty and all(r.avg_sentiment == 0.0 and r.sentiment_trend == "stable" for r in empty)


def test_trend_rejects_out_of_range_days(tables):
    import pytest

    with pytest.raises(ValueError):
        A.daily_trend(tables, days=91)


def test_sector_stats_equals_aggregated_chain(tables):
    """The aggregate-first plan equals aggregating the J-4 chain itself."""
    from pyspark.sql import functions as F

    from tidings.functions import core as C

    for period in ("24h", "7d", "30d"):
        chain = A.join_sector_chain(tables, period)
        want = chain.groupBy("sector_id", "sector_name").agg(
            F.count("rn_id").alias("news_count"), C.mean_or_zero("sentiment_score").alias("avg_sentiment"))
        got = A.sector_stats(tables, period).select("sector_id", "sector_name", "news_count", "avg_sentiment")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
