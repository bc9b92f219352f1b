from decimal import Decimal

from pyspark.sql import functions as F

from tidings.functions import core as C
from tidings.sources.fixtures import ts


def one(spark, expr, ddl="x int"):
    return spark.range(1).select(expr.alias("r")).first().r


def test_label_borders_are_neutral(spark):
    df = spark.createDataFrame([(Decimal("0.3000"),), (Decimal("0.3001"),), (Decimal("-0.3000"),), (Decimal("-0.3001"),),
                                (Decimal("0"),), (None,)], "s decimal(5,4)")
    got = [r.l for r in df.select(C.label("s").alias("l")).collect()]
    assert got == ["neutral", "positive", "neutral", "negative", "neutral", None]


def test_sign_label_threshold_zero(spark):
    df = spark.createDataFrame([(0.01,), (0.0,), (-0.01,)], "s double")
    assert [r.l for r in df.select(C.sign_label("s").alias("l")).collect()] == ["positive", "neutral", "negative"]


def test_round_div_half_away_from_zero(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (2675, 100000), (1, 3), (0, 5), (3, 0)], "a long, b long")
    got = [r.r for r in df.select(C.round_div(F.col("a") * 100, F.col("b"), 2).alias("r")).collect()]
    # 12.5 -> 12.5; -12.5; 2.675 -> 2.68 (exact, not binary); 33.33; 0; NULL on zero
    assert got == [12.5, -12.5, 2.68, 33.33, 0.0, None]


def test_duration_ms_rounds_like_integer_column(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 00:00:01.0005"),
                                ("2024-01-01 00:00:00", "2024-01-01 00:00:01.0004"),
                                ("2024-01-01 00:00:00", None)], "a string, b string")
    df = df.select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    assert [r.d for r in df.select(C.duration_ms("a", "b").alias("d")).collect()] == [1001, 1000, None]


def test_parse_feed_date_formats_and_fallback(spark):
    rows = [("Thu, 05 Mar 2026 09:24:26 +0800",), ("2026-03-05 17:07:14",), ("2026-03-05T17:07:14",),
            ("2026-03-05T17:07:14Z",), ("",), (None,), ("Thu, 05 Mar 2026 09:24:26 GMT",)]
    df = spark.createDataFrame(rows, "t string")
    got = [str(r.p) for r in df.select(C.parse_feed_date("t", ts("2024-01-31 00:00:00")).alias("p")).collect()]
    assert got == ["2026-03-05 09:24:26", "2026-03-05 17:07:14", "2026-03-05 17:07:14", "2024-01-31 00:00:00",
                   "2024-01-31 00:00:00", "2024-01-31 00:00:00", "2026-03-05 09:24:26"]


def test_truncate_adds_suffix_only_when_longer(spark):
    df = spark.createDataFrame([("abcdef",), ("abc",), (None,)], "t string")
    assert [r.x for r in df.select(C.truncate("t", 3).alias("x")).collect()] == ["abc...", "abc", None]


def test_first_nonempty(spark):
    df = spark.createDataFrame([("", "l"), (None, "l"), ("g", "l"), ("", "")], "g string, l string")
    assert [r.x for r in df.select(C.first_nonempty("g", "l").alias("x")).collect()] == ["l", "l", "g", None]


def test_json_list_and_reply_parsing(spark):
    df = spark.createDataFrame([('["a","b"]',), ("",), (None,), ("oops",)], "t string")
    assert [r.x for r in df.select(C.json_list_lenient("t").alias("x")).collect()] == [["a", "b"], [], [], []]
    replies = spark.createDataFrame([
        ('text {"sentiment_score": 0.5, "sentiment_label": "positive"} end',),
        ("bad {not json}",), ("no braces",), ('{\n"keywords": ["x"]\n}',)], "t string")
    got = replies.select(C.parse_score_reply("t").alias("p")).collect()
    assert got[0].p.sentiment_score == 0.5 and got[0].p.confidence == 0.0 and got[0].p.market_impact_score is None
    assert got[1].p.sentiment_label == "neutral" and got[1].p.sentiment_score == 0.0 and got[1].p.confidence == 0.5
    assert got[2].p is None
    assert got[3].p.keywords == ["x"] and got[3].p.sentiment_label == "neutral"


def test_period_fallback():
    assert C.period_hours("7d") == 168 and C.period_hours("bogus") == 24 and C.period_hours(None) == 24


def test_feed_dates_with_one_digit_parts(spark):
    df = spark.createDataFrame([("Thu, 5 Mar 2026 09:24:26 GMT",), ("2026-3-5 17:07:14",), ("2026-3-5T7:7:4+08:00",), ("xyz, 5 Mar 2026 09:24:26",),
                                ("2026-03-05 17:07",), (None,)], "t string")
    now = F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'")
    got = [str(r[0]) for r in df.select(C.parse_feed_date("t", now)).collect()]
    assert got == ["2026-03-05 09:24:26", "2026-03-05 17:07:14", "2026-03-05 07:07:04"] + ["2000-01-01 00:00:00"] * 3
