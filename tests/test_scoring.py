import pandas as pd
from pyspark.sql import functions as F

from tidings.functions import core as C
from tidings.operators import scoring as G
from tidings.sources.fixtures import LEXICON_ROWS


def test_a_long_word_list_scores_like_a_short_one(spark, tables):
    """12,000 further words that no text has, an empty and a NULL one: same plan, same rows."""
    more = spark.createDataFrame([(p, f"\u0001{i}") for i in range(6_000) for p in ("positive", "negative")] + [("positive", ""), ("negative", None)],
                                 "polarity string, word string")
    news = tables.raw_news.limit(30).unionByName(tables.raw_news.limit(1).withColumn("content", F.lit(None).cast("string")).withColumn("title", F.lit(None).cast("string")))
    rows = lambda lexicon: sorted(map(tuple, G.lexicon_score(news, lexicon).collect()), key=str)
    assert rows(tables.lexicon.select("polarity", "word").unionByName(more)) == rows(tables.lexicon)


def test_pandas_plugin_equals_jvm_score(tables):
    jvm = {r.id: (float(r.sentiment_score), r.sentiment_label) for r in G.lexicon_score(tables.raw_news, tables.lexicon).collect()}
    py = {r.id: (r.sentiment_score, r.sentiment_label) for r in
          G.model_score(tables.raw_news, G.pandas_lexicon_scorer(LEXICON_ROWS)).collect()}
    assert jvm == py


def test_failing_scorer_gives_default_rows(tables):
    def broken(texts: pd.Series) -> pd.DataFrame:
        raise RuntimeError("remote model down")

    out = G.model_score(tables.raw_news.limit(7), broken, attempts=2, backoff=0.0).collect()
    assert len(out) == 7
    assert all(not r.scored_ok and r.sentiment_label == "neutral" and r.confidence == 0.5 and r.market_impact_score == 50 for r in out)


def test_entities_from_strings_and_objects(spark):
    df = spark.createDataFrame([('["A", "B"]',), ('[{"name": "C", "type": "org", "sentiment": 0.2}]',), (None,)], "j string")
    got = [r.e for r in df.select(G.normalise_entities(F.col("j")).alias("e")).collect()]
    assert [(x.name, x.type) for x in got[0]] == [("A", "unknown"), ("B", "unknown")]
    assert [(x.name, x.type, x.sentiment) for x in got[1]] == [("C", "org", 0.2)]
    assert got[2] == []


def test_occurrences_in_multibyte_text(spark):
    news = spark.createDataFrame([(1, "t", "ééé über über ü"), (2, "t", "plain")], "id long, title string, content string")
    lex = spark.createDataFrame([("positive", "é"), ("positive", "über"), ("negative", "ü")], "polarity string, word string")
    got = {r.id: (r.pos_hits, r.neg_hits) for r in G.lexicon_score(news, lex, text=F.col("content")).collect()}
    assert got == {1: (5, 3), 2: (0, 0)}


def test_lexicon_score_shuffles_narrow_rows_only(tables):
    lines = G.lexicon_score(tables.raw_news, tables.lexicon)._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if " Exchange " in line]
    assert below and all("HashAggregate(keys=" in x and "text#" not in x for x in below)
    assert not any("Join" in x for x in lines)  # a short list is folded over


def test_one_failing_text_defaults_only_itself(spark):
    news = spark.range(50).selectExpr("id", "concat('text ', id) AS title", "'' AS content").repartition(1)

    def scorer(texts: pd.Series) -> pd.DataFrame:
        if texts.str.contains("text 7 ").any():
            raise RuntimeError("this text")
        return pd.DataFrame({"sentiment_score": [0.5] * len(texts), "sentiment_label": ["positive"] * len(texts),
                             "confidence": [None] * len(texts), "market_impact_score": [None] * len(texts)})

    got = {r.id: r for r in G.model_score(news, scorer, C.scoring_text("title", "content"), attempts=2, backoff=0.0).collect()}
    assert len(got) == 50 and [i for i, r in got.items() if not r.scored_ok] == [7]
    assert got[7].confidence == 0.5 and got[7].market_impact_score == 50
    assert got[8].confidence == 0.0 and got[8].market_impact_score is None and got[8].sentiment_score == 0.5


def test_scorer_gets_the_whole_request_and_replies_with_lists(spark):
    long = "word " * 1000
    news = spark.createDataFrame([(1, "Title", long), (2, None, None)], "id long, title string, content string")

    def scorer(texts: pd.Series) -> pd.DataFrame:
        whole = texts.str.contains(long.strip()).tolist()
        return pd.DataFrame({"sentiment_score": [0.1] * len(texts), "sentiment_label": ["neutral"] * len(texts), "confidence": [1.0] * len(texts),
                             "market_impact_score": [1] * len(texts), "entities": [["A", "B"] if w else None for w in whole],
                             "keywords": [["k"] if w else [] for w in whole]})

    got = {r.id: (r.entities, r.keywords, r.scored_ok) for r in G.model_score(news, scorer).collect()}
    assert got == {1: (["A", "B"], ["k"], True), 2: ([], [], True)}
    text = {r.id: r.t for r in news.select("id", G.request_text("title", "content").alias("t")).collect()}
    assert text[1].count("word") == 1000 and "标题: Title\n" in text[1] and text[2].startswith(G.REQUEST_PARTS[0])
