from datetime import date

from pyspark.sql import functions as F

from tidings.operators import news as N
from tidings.operators import stats as A


def _items(spark):
    rows = [(1, "2024-01-02 00:00:00"), (2, None), (3, "2024-01-03 00:00:00"), (4, "2024-01-03 00:00:00"), (5, None)]
    df = spark.createDataFrame(rows, "id long, p string")
    return df.select("id", F.col("p").cast("timestamp_ntz").alias("published_at"))


def test_newest_first_puts_nulls_first_and_breaks_ties_by_id(spark):
    assert [r.id for r in N.newest_first(_items(spark)).collect()] == [2, 5, 3, 4, 1]


def test_latest_puts_nulls_last(spark):
    assert [r.id for r in N.latest_news(_items(spark), 3).collect()] == [3, 4, 1]


def test_keyset_pages_cover_offset_pages(spark):
    df = _items(spark)
    p1 = N.news_page(df, 1, 2).collect()
    last = p1[-1]
    p2 = N.news_page_after(df, last.published_at, last.id, 2).collect()
    assert [r.id for r in p2] == [r.id for r in N.news_page(df, 2, 2).collect()]
    p3 = N.news_page_after(df, p2[-1].published_at, p2[-1].id, 2).collect()
    assert [r.id for r in p3] == [r.id for r in N.news_page(df, 3, 2).collect()]


def test_keyword_wildcards_and_null_content(spark):
    df = spark.createDataFrame([(1, "Big Deal", None), (2, "x", "a_b"), (3, "x", "aXb"), (4, None, None)],
                               "id long, title string, content string")
    assert [r.id for r in N.filter_keyword(df, "deal").collect()] == [1]
    assert sorted(r.id for r in N.filter_keyword(df, "a_b").collect()) == [2, 3]


def test_date_range_is_inclusive_by_day(spark):
    df = spark.createDataFrame([(1, "2024-01-10 23:59:59"), (2, "2024-01-11 00:00:00"), (3, "2024-01-09 23:59:59")],
                               "id long, p string").select("id", F.col("p").cast("timestamp_ntz").alias("published_at"))
    assert sorted(r.id for r in N.filter_date_range(df, date(2024, 1, 10), date(2024, 1, 10)).collect()) == [1]


def test_search_and_total_agree(tables):
    q = N.NewsQuery(page=1, page_size=100, keyword="the", start_date=date(2024, 1, 5), sentiment="positive")
    n_rows = N.search_filtered(tables, q).count()
    tot = A.total_count(tables, q).first()
    assert tot.total == n_rows and tot.pages == (n_rows + 99) // 100
    assert tot.total_all == tables.raw_news.count()


def test_page_size_is_checked():
    import pytest

    with pytest.raises(ValueError):
        N.NewsQuery(page_size=101)
    with pytest.raises(ValueError):
        N.NewsQuery(page=0)
