"""News query surface: projections, filters, joins, lookup, paging (F-*, J-1..J-5, O-*).

Every function is DataFrame -> DataFrame.  Filters are plain column
predicates so Catalyst pushes them into the Parquet scan; the wide
``content`` column is only read where a predicate or the output needs it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import core as C


def ts_lit(value: datetime | date | str) -> Column:
    """Zone-less timestamp literal (the facts carry timestamp_ntz)."""
    if isinstance(value, datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    elif isinstance(value, date):
        value = value.strftime("%Y-%m-%d 00:00:00")
    return F.expr(f"TIMESTAMP_NTZ '{value}'")


def _as_dt(value: datetime | str) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))


def _opt(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


# ---- F-2 .. F-11 predicates -------------------------------------------------------------
def filter_label(df: DataFrame, label: str | None, col: str = "sentiment_label") -> DataFrame:
    return df if not label else df.filter(F.col(col) == label)


def filter_date_range(df: DataFrame, start: date | None = None, end: date | None = None, col: str = "published_at") -> DataFrame:
    """Inclusive ``DATE(col)`` bounds rewritten as a half-open timestamp range
    (keeps Parquet min/max pruning and partition pruning usable)."""
    if start is not None:
        df = df.filter(F.col(col) >= ts_lit(start))
    if end is not None:
        df = df.filter(F.col(col) < ts_lit(end + timedelta(days=1)))
    return df


def filter_date_between(df: DataFrame, start: date, end: date, col: str = "published_at") -> DataFrame:
    return filter_date_range(df, start, end, col)


def keyword_predicate(keyword: str, cols=("title", "content")) -> Column:
    """Case-insensitive substring in any of ``cols``; '%' and '_' stay wildcards.
    A NULL in one column does not hide a hit in another (NULL OR TRUE = TRUE)."""
    pattern = C.keyword_pattern(keyword)
    return C.any_of([F.col(c).ilike(pattern) for c in cols])


def filter_keyword(df: DataFrame, keyword: str | None, cols=("title", "content")) -> DataFrame:
    return df if not keyword else df.filter(keyword_predicate(keyword, cols))


def filter_period(df: DataFrame, period: str | None, as_of: datetime | str, col: str = "published_at") -> DataFrame:
    start = _as_dt(as_of) - timedelta(hours=C.period_hours(period))
    return df.filter(F.col(col) >= ts_lit(start))


def filter_last_n_days(df: DataFrame, days: int, as_of: datetime | str, col: str = "published_at") -> DataFrame:
    return df.filter(F.col(col) >= ts_lit(_as_dt(as_of) - timedelta(days=days)))


def filter_unscored(news: DataFrame, sentiment: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows without a sentiment result ("is_processed" derived, not stored)."""
    scored = sentiment.select(F.col("news_id").alias(id_col))
    return news.join(scored, id_col, "left_anti")


def filter_source(df: DataFrame, source: str | None, col: str = "source") -> DataFrame:
    return df if not source else df.filter(F.col(col) == source)


def filter_placeholder(df: DataFrame, sector_col: str = "sector", scored_col: str = "analyzed") -> DataFrame:
    s = F.col(sector_col)
    return df.filter(F.col(scored_col) & s.isNotNull() & (s != "") & (s != S.CATCH_ALL_SECTOR))


def filter_active(df: DataFrame, col: str = "is_active") -> DataFrame:
    return df.filter(F.col(col))


# ---- J-1 / J-2 / F-1 ---------------------------------------------------------------
def join_inner_source(news: DataFrame, sources: DataFrame) -> DataFrame:
    """news JOIN sources: news with a NULL or unknown source drop out.
    The source dimension is small; AQE turns this into a broadcast hash join
    once the dimension's real size is known."""
    src = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return news.join(src, "source_id", "inner")


def join_left_sentiment(news: DataFrame, sentiment: DataFrame, cols=("sentiment_label", "sentiment_score", "confidence")) -> DataFrame:
    """news LEFT JOIN sentiment on id (one result row per news at most)."""
    sr = sentiment.select(F.col("news_id").alias("id"), *cols)
    return news.join(sr, "id", "left")


ITEM_COLUMNS = ("id", "title", "summary", "url", "author", "source_name", "published_at",
                "sentiment_label", "sentiment_score", "confidence")


def news_items(news: DataFrame, sources: DataFrame, sentiment: DataFrame) -> DataFrame:
    """The 10-column list item: news JOIN source LEFT JOIN sentiment."""
    base = news.select("id", "source_id", "title", _opt(news, "summary").alias("summary"), "url",
                       _opt(news, "author").alias("author"), "published_at")
    j = join_left_sentiment(join_inner_source(base, sources), sentiment)
    return j.select(*ITEM_COLUMNS)


def _news_filters(news: DataFrame, start=None, end=None, keyword=None) -> DataFrame:
    news = filter_date_range(news, start, end)
    return filter_keyword(news, keyword)


# ---- J-5 semi join on sector name ----------------------------------------------------------
def semi_join_sector(news: DataFrame, news_sectors: DataFrame, sectors: DataFrame, sector: str | None, id_col: str = "id") -> DataFrame:
    """news WHERE id IN (bridge JOIN sector WHERE name = :sector)."""
    if not sector:
        return news
    ids = news_sectors.join(
        sectors.filter(F.col("name") == sector).select(F.col("id").alias("sector_id")),
        "sector_id",
    ).select(F.col("news_id").alias(id_col))
    return news.join(ids, id_col, "left_semi")


# ---- J-3 views ------------------------------------------------------------------------
def news_sentiment_view(news: DataFrame, sources: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Processed news LEFT JOIN source LEFT JOIN sentiment, 12 columns.
    'Processed' is derived as "a sentiment row exists" (the stored flag was
    never set)."""
    src = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    details = ["sentiment_score", "sentiment_label", "confidence", "market_impact_score", "entities", "keywords", "analyzed_at"]
    sr = sentiment.select(F.col("news_id").alias("id"), *details)
    n = news.select("id", "source_id", "title", "url", "published_at")
    return n.join(sr, "id").join(src, "source_id", "left").select("id", "title", "url", "published_at", "source_name", *details)


def news_sentiment_view_all(news: DataFrame, sources: DataFrame, sentiment: DataFrame) -> DataFrame:
    """The simple variant: all news, 13 columns, newest first."""
    src = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    details = ["sentiment_score", "sentiment_label", "confidence", "keywords", "industry_tags", "analyzed_at"]
    sr = sentiment.select(F.col("news_id").alias("id"), *details)
    n = news.select("id", "source_id", "title", "content", "url", _opt(news, "author").alias("author"), "published_at")
    return newest_first(n.join(sr, "id", "left").join(src, "source_id", "left").select(
        "id", "title", "content", "url", "author", "published_at", "source_name", *details))


# ---- F-12 point lookup ---------------------------------------------------------------
def news_by_id(news: DataFrame, sources: DataFrame, sentiment: DataFrame, news_id: int) -> DataFrame:
    n = news.filter(F.col("id") == news_id)
    return news_items(n, sources, sentiment)


# ---- F-13 composed search + O-1 paging ----------------------------------------------------
@dataclass(frozen=True)
class NewsQuery:
    page: int = 1
    page_size: int = 20
    sentiment: str | None = None
    sector: str | None = None
    start_date: date | None = None
    end_date: date | None = None
    keyword: str | None = None

    def __post_init__(self):
        if self.page < 1:
            raise ValueError("page must be >= 1")
        if not 1 <= self.page_size <= S.PAGE_SIZE_MAX:
            raise ValueError(f"page_size must be in 1..{S.PAGE_SIZE_MAX}")


def search_filtered(t, q: NewsQuery) -> DataFrame:
    """All optional predicates of the search, unpaged (shared by page and total)."""
    news = _news_filters(t.raw_news, q.start_date, q.end_date, q.keyword)
    news = semi_join_sector(news, t.news_sectors, t.market_sectors, q.sector)
    items = news_items(news, t.news_sources, t.sentiment_results)
    return filter_label(items, q.sentiment)


def newest_first(df: DataFrame) -> DataFrame:
    """Postgres order: DESC puts NULLs first; id breaks ties (deterministic pages)."""
    return df.orderBy(F.col("published_at").desc_nulls_first(), F.col("id").asc())


def news_page(df: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """Offset paging: top-(offset+size) per partition, merged on the driver side
    of the final stage (TakeOrderedAndProject); cheap for shallow pages."""
    offset = (page - 1) * page_size
    ordered = newest_first(df)
    return (ordered.offset(offset) if offset else ordered).limit(page_size)


def news_page_after(df: DataFrame, last_published_at: datetime | None, last_id: int, page_size: int = 20) -> DataFrame:
    """Key-set paging for deep pages: rows strictly after (last_ts, last_id) in
    newest-first order (NULL times come first)."""
    ts = F.col("published_at")
    if last_published_at is None:
        after = ts.isNull() & (F.col("id") > last_id) | ts.isNotNull()
    else:
        lt = ts_lit(last_published_at)
        after = (ts < lt) | ((ts == lt) & (F.col("id") > last_id))
    return newest_first(df.filter(after)).limit(page_size)


def search_news(t, q: NewsQuery) -> DataFrame:
    return news_page(search_filtered(t, q), q.page, q.page_size)


# ---- O-2 / O-3 / O-4 ------------------------------------------------------------------
def latest_news(df: DataFrame, n: int = S.DASHBOARD_LATEST) -> DataFrame:
    """Newest n, NULL times last (the minimal store's order)."""
    return df.orderBy(F.col("published_at").desc_nulls_last(), F.col("id").asc()).limit(n)


def scoring_batch(news: DataFrame, sentiment: DataFrame, n: int = 10) -> DataFrame:
    """Newest n rows not scored yet: the next batch for the scorer.  The n ids
    are found on (id, time) only, then their texts are fetched."""
    ids = latest_news(filter_unscored(news.select("id", "published_at"), sentiment), n).select("id")
    return latest_news(news.select("id", "title", "content", "published_at").join(ids, "id", "left_semi"), n)


def array_head(df: DataFrame, arr_col: str = "keywords", n: int = 5) -> DataFrame:
    return df.withColumn(f"{arr_col}_head", C.array_head_text(arr_col, n))
