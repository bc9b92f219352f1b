"""Column -> Column functions (C-1 .. C-13).

All are built-in Spark expressions, so they run inside whole-stage codegen
on the executors; none of them calls back into Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- C-1 labels --------------------------------------------------------------
def label(score, pos: float = S.POSITIVE_THRESHOLD, neg: float = S.NEGATIVE_THRESHOLD) -> Column:
    """Score -> positive / neutral / negative; both borders are neutral; NULL stays NULL."""
    s = _c(score)
    return F.when(s > pos, "positive").when(s < neg, "negative").when(s.isNotNull(), "neutral")


# Display words of the minimal report for the three labels.
LABEL_TEXT = {"positive": "偏正面", "negative": "偏负面", "neutral": "中性"}


def label_text(score) -> Column:
    s = _c(score)
    return (
        F.when(s > S.POSITIVE_THRESHOLD, LABEL_TEXT["positive"])
        .when(s < S.NEGATIVE_THRESHOLD, LABEL_TEXT["negative"])
        .otherwise(LABEL_TEXT["neutral"])
    )


def sign_label(score) -> Column:
    """Dashboard card variant: threshold 0 (NULL treated as neutral)."""
    s = _c(score)
    return F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral")


# ---- C-2 calendar parts ---------------------------------------------------------
def day(ts) -> Column:
    return F.to_date(_c(ts))


def hour(ts) -> Column:
    return F.date_trunc("hour", _c(ts))


def day_start(ts) -> Column:
    return F.date_trunc("day", _c(ts))


def yyyymm(ts) -> Column:
    return F.date_format(_c(ts), "yyyyMM").cast("int")


def first10(text) -> Column:
    return F.substring(_c(text), 1, 10)


# ---- C-3 interval arithmetic ---------------------------------------------------
def plus_hours(ts, n) -> Column:
    return F.timestamp_add("HOUR", n if isinstance(n, Column) else F.lit(n), _c(ts))


def plus_minutes(ts, n) -> Column:
    return F.timestamp_add("MINUTE", n if isinstance(n, Column) else F.lit(n), _c(ts))


def minus_days(ts, n) -> Column:
    return F.timestamp_add("DAY", -(n if isinstance(n, Column) else F.lit(n)), _c(ts))


def period_hours(period: str | None) -> int:
    """'24h' / '7d' / '30d'; anything else falls back to 24 hours."""
    return S.PERIODS_HOURS.get(period or S.DEFAULT_PERIOD, S.PERIODS_HOURS[S.DEFAULT_PERIOD])


# ---- C-4 lenient feed date parsing -----------------------------------------
def parse_feed_date(text, now: Column) -> Column:
    """Three formats tried in order after cutting zone parts; else ``now``.

    The weekday prefix ('Thu, ') is removed first because Spark's parser
    rejects the weekday pattern; text after '+' or 'GMT' is cut off, then
    trimmed and cut to 25 characters, as the original did.  Day, month and
    time parts may have one digit.
    """
    t = _c(text)
    cleaned = F.substring(F.trim(F.split(F.split(t, r"\+", 2)[0], "GMT", 2)[0]), 1, 25)
    weekday = r"(?i)^(mon|tue|wed|thu|fri|sat|sun), "
    clock = r"\d{1,2}:\d{1,2}:\d{1,2}$"
    fmt = S.FEED_DATE_FORMATS
    shapes = ((weekday + r"\d{1,2} [a-z]{3} \d{4} " + clock, F.initcap(F.regexp_replace(cleaned, weekday, ""))),
              (r"^\d{4}-\d{1,2}-\d{1,2} " + clock, cleaned), (r"^\d{4}-\d{1,2}-\d{1,2}T" + clock, cleaned))
    parsed = F.coalesce(*[F.when(cleaned.rlike(shape), F.try_to_timestamp(part, F.lit(f))) for f, (shape, part) in zip(fmt, shapes)])
    return F.coalesce(F.when((t.isNotNull()) & (t != ""), parsed).cast("timestamp_ntz"), now)


# ---- C-5 first non-empty ------------------------------------------------------
def first_nonempty(*cols) -> Column:
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


def entry_author(author, authors) -> Column:
    """The author, else the first of the authors if it has a name, else ''."""
    return F.coalesce(first_nonempty(author, F.get(_c(authors), F.lit(0))), F.lit(""))


# ---- C-6 truncation ----------------------------------------------------------------
def truncate(text, n: int, suffix: str = "...") -> Column:
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(suffix))).otherwise(t)


def hard_cut(text, n: int) -> Column:
    return F.substring(_c(text), 1, n)


# ---- C-7 scoring input ---------------------------------------------------------------
def scoring_text(title, content) -> Column:
    return F.concat_ws(" ", _c(title), _c(content))


# ---- C-8 share of total ------------------------------------------------------------
def share(df, n) -> Column:
    """n / sum(n) over all rows of ``df``.  The total is a scalar subquery:
    computed once by a partial + final aggregate and used as a constant, so
    the rows never meet in one task."""
    c = _c(n)
    return c / df.select(F.sum(c)).scalar()


# ---- C-9 JSON lists ------------------------------------------------------------------
def json_list(text) -> Column:
    return F.coalesce(F.try_parse_json(_c(text)).cast("array<string>"), F.array().cast("array<string>"))


def json_list_lenient(text) -> Column:
    t = _c(text)
    return F.coalesce(F.from_json(t, "array<string>"), F.array().cast("array<string>"))


def to_json_list(arr) -> Column:
    return F.to_json(_c(arr))


# ---- C-10 JSON object embedded in free text ---------------------------------------
def extract_json_object(text) -> Column:
    """First '{' to last '}' (dot matches newline); NULL when there are no braces."""
    found = F.regexp_extract(_c(text), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def parse_score_reply(text) -> Column:
    """Reply text -> struct of the score contract.

    * no braces -> NULL (an error row)
    * invalid JSON -> the fixed default reply
    * absent fields -> 0.0 (score, confidence), 'neutral' (label), empty lists;
      an absent market impact stays absent
    """
    obj = extract_json_object(text)
    parsed = F.from_json(obj, S.SCORE_REPLY, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json(obj).isNotNull()
    d = S.DEFAULT_SCORE_REPLY
    ok = F.struct(
        F.coalesce(parsed["sentiment_score"], F.lit(0.0)).alias("sentiment_score"),
        F.coalesce(parsed["sentiment_label"], F.lit("neutral")).alias("sentiment_label"),
        F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(parsed["entities"], F.array().cast("array<string>")).alias("entities"),
        F.coalesce(parsed["keywords"], F.array().cast("array<string>")).alias("keywords"),
        parsed["market_impact_score"].alias("market_impact_score"),
    )
    default = F.struct(
        F.lit(d["sentiment_score"]).alias("sentiment_score"),
        F.lit(d["sentiment_label"]).alias("sentiment_label"),
        F.lit(d["confidence"]).alias("confidence"),
        F.array().cast("array<string>").alias("entities"),
        F.array().cast("array<string>").alias("keywords"),
        F.lit(d["market_impact_score"]).alias("market_impact_score"),
    )
    return F.when(obj.isNull(), F.lit(None)).when(valid, ok).otherwise(default)


# ---- C-11 typed configuration value ---------------------------------------------------
def typed_config(value, value_type) -> dict[str, Column]:
    v, t = _c(value), _c(value_type)
    return {
        "int_value": F.when(t == "integer", v.try_cast("bigint")),
        "float_value": F.when(t == "float", v.try_cast("double")),
        "bool_value": F.when(t == "boolean", v.try_cast("boolean")),
        "json_value": F.when(t == "json", F.when(F.try_parse_json(v).isNotNull(), v)),
        "string_value": F.when(t == "string", v),
    }


def config_int(value, default: int = S.DEFAULT_RETENTION_DAYS) -> Column:
    return F.coalesce(_c(value).try_cast("bigint"), F.lit(default).cast("bigint"))


# ---- C-12 duration -------------------------------------------------------------------
def duration_ms(started, completed) -> Column:
    """(completed - started) in milliseconds, rounded half away from zero
    (an epoch difference stored into an integer column); NULL if either is missing."""
    a, b = _c(started), _c(completed)
    us = F.timestamp_diff("MICROSECOND", a, b)
    ms = idiv(F.abs(us) * 2 + 1000, F.lit(2000)) * F.signum(us).cast("bigint")
    return F.when(a.isNotNull() & b.isNotNull(), ms)


# ---- C-13 / means -----------------------------------------------------------------
def coalesce_zero(x) -> Column:
    return F.coalesce(_c(x), F.lit(0))


def exact_mean(x) -> Column:
    """Mean as (exact decimal sum) / count, one IEEE division; NULL if no values."""
    c = _c(x)
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))


def mean_or_zero(x) -> Column:
    return F.coalesce(exact_mean(x), F.lit(0.0))


def count_label(label_col, value: str) -> Column:
    return F.count(F.when(_c(label_col) == value, 1))


def sum_label(label_col, value: str) -> Column:
    """SUM(CASE WHEN label = v THEN 1 ELSE 0 END); 0 on an empty set."""
    return F.coalesce(F.sum(F.when(_c(label_col) == value, 1).otherwise(0)), F.lit(0)).cast("bigint")


def percent(part, total, digits: int = 2) -> Column:
    p, t = _c(part), _c(total)
    return F.when(t > 0, F.round(p.cast("double") * 100 / t, digits)).otherwise(F.lit(0.0))


def array_head_text(arr, n: int = 5, sep: str = ", ") -> Column:
    return F.array_join(F.slice(_c(arr), 1, n), sep)


def tokens(text) -> Column:
    """Keywords of a news item: all its blank-separated tokens."""
    return F.split(_c(text), " ")


def keyword_pattern(keyword: str) -> str:
    """ILIKE pattern: '%' and '_' in the keyword stay wildcards."""
    return f"%{keyword}%"


def any_of(cols: Sequence[Column]) -> Column:
    out = None
    for c in cols:
        out = c if out is None else (out | c)
    return out if out is not None else F.lit(False)


# ---- exact integer arithmetic shared with the SQL oracle ----------------------------
def idiv(a: Column, b: Column) -> Column:
    """Floor division of integers for b > 0, exact (no floating step)."""
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def round_div(num: Column, den: Column, digits: int = 2) -> Column:
    """num / den rounded half away from zero to ``digits`` decimals, computed
    exactly on integers; NULL when den is 0.  Returned as double."""
    scale = 10**digits
    k = idiv(F.abs(num) * (2 * scale) + den, den * 2) * F.signum(num).cast("bigint")
    exact = k.cast("decimal(38,0)") * F.lit(f"{1 / scale:.{digits}f}").cast(f"decimal({digits + 1},{digits})")
    return F.when(den != 0, exact.cast("double"))


def score_units(score_sum: Column, scale: int = 4) -> Column:
    """Exact decimal sum of scores -> integer count of 10^-scale units."""
    return (score_sum * (10**scale)).cast("bigint")


def round_mean(x, digits: int = 2, scale: int = 4) -> Column:
    """Exact mean of a decimal(*, scale) column rounded half away from zero."""
    c = _c(x)
    return round_div(score_units(F.sum(c), scale), F.count(c) * (10**scale), digits)
