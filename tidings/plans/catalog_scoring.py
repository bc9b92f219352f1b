"""Registered scoring queries (G-1, G-2, G-4, C-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import scoring as G
from ..sources.fixtures import LEXICON_ROWS, Tables
from .registry import register, sql_round_div

LEX_SQL = f"""WITH t AS (SELECT id, concat_ws(' ', title, content) AS txt FROM raw_news),
h AS (SELECT t.id,
        CAST(COALESCE(SUM(CASE WHEN l.polarity = 'positive' THEN (length(t.txt) - length(replace(t.txt, l.word, ''))) // length(l.word) END), 0) AS BIGINT) AS pos_hits,
        CAST(COALESCE(SUM(CASE WHEN l.polarity = 'negative' THEN (length(t.txt) - length(replace(t.txt, l.word, ''))) // length(l.word) END), 0) AS BIGINT) AS neg_hits
      FROM t CROSS JOIN lexicon l GROUP BY t.id),
s AS (SELECT id, pos_hits, neg_hits,
        CAST(COALESCE({sql_round_div('pos_hits - neg_hits', 'pos_hits + neg_hits', 4)}, 0.0) AS DECIMAL(5,4)) AS sentiment_score,
        CAST(CASE WHEN pos_hits + neg_hits > 0 THEN {sql_round_div('pos_hits + neg_hits', 'pos_hits + neg_hits + 1', 4)} ELSE 0.5 END AS DECIMAL(5,4)) AS confidence
      FROM h)"""


@register(
    "lexicon_score",
    LEX_SQL + """
SELECT id, pos_hits, neg_hits, sentiment_score,
       CASE WHEN sentiment_score > 0.3 THEN 'positive' WHEN sentiment_score < -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       confidence
FROM s""",
    views=("raw_news", "lexicon"),
)
def q_lexicon_score(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.lexicon_score(t.raw_news, t.lexicon)


@register(
    "model_score",
    LEX_SQL + """
SELECT id, CAST(sentiment_score AS DOUBLE) AS sentiment_score,
       CASE WHEN sentiment_score > 0.3 THEN 'positive' WHEN sentiment_score < -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       CAST(confidence AS DOUBLE) AS confidence, CAST([] AS VARCHAR[]) AS entities,
       COALESCE((SELECT list(DISTINCT l.word ORDER BY l.word) FROM t, lexicon l WHERE t.id = s.id AND contains(t.txt, l.word)), []) AS keywords,
       50 AS market_impact_score, true AS scored_ok
FROM s""",
    views=("raw_news", "lexicon"),
)
def q_model_score(spark, sf_dir):
    """The pluggable batch scorer driven by a local plug-in with G-1's formula:
    it must agree with the JVM lexicon score row for row."""
    t = Tables(spark, sf_dir)
    return G.model_score(t.raw_news, G.pandas_lexicon_scorer(LEXICON_ROWS))


_REQUEST = " || ".join(f"'{p}'" if i % 2 == 0 else f"COALESCE({p}, '')" for i, p in enumerate(
    [G.REQUEST_PARTS[0], "title", G.REQUEST_PARTS[1], "content", G.REQUEST_PARTS[2]]))


@register("model_request", f"SELECT id, md5({_REQUEST}) AS request_md5, length({_REQUEST}) AS request_chars FROM raw_news", views=("raw_news",))
def q_model_request(spark, sf_dir):
    """The whole request text of every news (as its digest and length)."""
    x = Tables(spark, sf_dir).raw_news.select("id", G.request_text("title", "content").alias("request"))
    return x.select("id", F.md5("request").alias("request_md5"), F.length("request").cast("long").alias("request_chars"))


def entity_json(t):
    """Entity lists as JSON: objects on even ids, plain strings on odd ids."""
    toks = F.filter(C.tokens("content"), lambda x: x.rlike("^[A-Z]"))
    objs = F.to_json(F.transform(toks, lambda x: F.struct(x.alias("name"), F.lit("ORG").alias("type"), F.lit(0.5).alias("sentiment"))))
    js = F.when(F.col("id") % 2 == 0, objs).otherwise(F.to_json(toks))
    return t.raw_news.select("id", js.alias("entities_json"))


@register(
    "entity_normalise",
    """WITH e AS (SELECT id, list_filter(string_split(content, ' '), lambda x: regexp_matches(x, '^[A-Z]')) AS toks FROM raw_news),
u AS (SELECT id, unnest(toks) AS name, unnest(generate_series(0, len(toks) - 1)) AS pos FROM e)
SELECT id, pos, name, CASE WHEN id % 2 = 0 THEN 'ORG' ELSE 'unknown' END AS type,
       CASE WHEN id % 2 = 0 THEN 0.5 END AS sentiment
FROM u""",
    views=("raw_news",),
)
def q_entity_normalise(spark, sf_dir):
    e = entity_json(Tables(spark, sf_dir))
    n = e.select("id", G.normalise_entities(F.col("entities_json")).alias("entities"))
    return n.select("id", F.posexplode("entities").alias("pos", "e")).select(
        "id", "pos", F.col("e.name").alias("name"), F.col("e.type").alias("type"), F.col("e.sentiment").alias("sentiment"))


def replies(t):
    """Scorer replies derived from the scored fixture rows, four shapes:
    a full JSON object in prose, a partial object, broken JSON, no braces."""
    sr = t.sentiment_results
    k = F.col("news_id") % 4
    full = F.to_json(F.struct(
        F.col("sentiment_score").cast("double").alias("sentiment_score"), "sentiment_label",
        F.col("confidence").cast("double").alias("confidence"),
        F.array(F.lit("market"), F.col("sentiment_label")).alias("keywords"), "market_impact_score"))
    reply = (F.when(k == 0, F.concat(F.lit("Here is the analysis:\n"), full, F.lit("\nThanks.")))
             .when(k == 1, F.concat(F.lit("{\n\"sentiment_label\": \""), F.col("sentiment_label"), F.lit("\"}")))
             .when(k == 2, F.lit("result {score: high} end"))
             .otherwise(F.lit("no structured answer")))
    return sr.select("news_id", reply.alias("reply"))


@register(
    "fn_extract_json",
    """WITH r AS (
  SELECT news_id, sentiment_score, sentiment_label, confidence, market_impact_score, news_id % 4 AS k FROM sentiment_results)
SELECT news_id,
       k = 3 AS is_error,
       CASE k WHEN 0 THEN CAST(sentiment_score AS DOUBLE) WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 END AS sentiment_score,
       CASE k WHEN 0 THEN sentiment_label WHEN 1 THEN sentiment_label WHEN 2 THEN 'neutral' END AS sentiment_label,
       CASE k WHEN 0 THEN CAST(confidence AS DOUBLE) WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 END AS confidence,
       CASE k WHEN 0 THEN market_impact_score WHEN 2 THEN 50 END AS market_impact_score,
       CASE k WHEN 0 THEN 'market, ' || sentiment_label WHEN 1 THEN '' WHEN 2 THEN '' END AS keywords
FROM r""",
    views=("sentiment_results",),
)
def q_fn_extract_json(spark, sf_dir):
    p = G.parse_replies(replies(Tables(spark, sf_dir)), "reply")
    return p.select("news_id", "is_error", "sentiment_score", "sentiment_label", "confidence", "market_impact_score",
                    F.array_join("keywords", ", ").alias("keywords"))
