"""Scoring (G-1, G-2, G-4, C-10).

G-1 is a lexicon score computed with JVM expressions: a q-gram inverted join
(``operators.words``) finds the words of a list of any size; no text is shuffled
and no word is collected.

G-2 is the pluggable scorer: ``mapInPandas`` hands Arrow batches to a
user function (e.g. a remote model client) with retries and the fixed
default reply on failure.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import core as C
from .words import find_words


def _finish(df: DataFrame, p: str = "pos_hits", n: str = "neg_hits") -> DataFrame:
    pc, nc = F.col(p), F.col(n)
    tot = pc + nc
    score = F.coalesce(C.round_div(pc - nc, tot, 4), F.lit(0.0)).cast("decimal(5,4)")
    return df.withColumn("sentiment_score", score).withColumns({
        "sentiment_label": C.label("sentiment_score"),
        "confidence": F.when(tot > 0, C.round_div(tot, tot + 1, 4)).otherwise(F.lit(0.5)).cast("decimal(5,4)"),
    })


def lexicon_score(news: DataFrame, lexicon: DataFrame, text: Column | None = None, id_col: str = "id",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, pos_hits, neg_hits, sentiment_score, sentiment_label, confidence),
    one row per row of ``news``, plus its narrow columns ``keep``.

    Hits are occurrences that do not overlap, of each word by itself; a word
    listed twice counts twice.  score = (p - n) / (p + n) rounded to 4 digits
    (0 when no hit); confidence = (p + n) / (p + n + 1), 0.5 when no hit.  The
    list may be of any size (``operators.words``)."""
    text = text if text is not None else C.scoring_text("title", "content")
    words = lexicon.filter(F.col("polarity").isin("positive", "negative")).groupBy("word").agg(
        *[F.count_if(F.col("polarity") == p).alias(f"_{p}") for p in ("positive", "negative")])
    rows = news.select(F.col(id_col).alias("id"), *keep, text.alias("_text"))
    found = find_words(rows, words, "_text", every_row=True, counts=True)
    per_row = found.groupBy("_row", "id", *keep).agg(
        *[F.sum(F.coalesce(F.col("hits") * F.col(f"_{p}"), F.lit(0))).alias(f"{p[:3]}_hits") for p in ("positive", "negative")])
    return _finish(per_row.drop("_row")).select("id", *keep, "pos_hits", "neg_hits", "sentiment_score", "sentiment_label", "confidence")


# ---- G-2 pluggable scorer ------------------------------------------------------------------
# The request that the scorer gets for a news item.
REQUEST_PARTS = ("请分析以下财经新闻的情感倾向和市场影响：\n\n标题: ", "\n\n内容: ", "\n\n请返回JSON格式的分析结果。")
REPLY_SCHEMA = ("id long, sentiment_score double, sentiment_label string, confidence double, entities array<string>, "
                "keywords array<string>, market_impact_score int, scored_ok boolean")


def request_text(title, content) -> Column:
    """The scorer's request over the whole text; NULL parts are empty."""
    before, between, after = REQUEST_PARTS
    part = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.concat(F.lit(before), part(title), F.lit(between), part(content), F.lit(after))


def model_score(news: DataFrame, scorer: Callable[[pd.Series], pd.DataFrame], text: Column | None = None,
                id_col: str = "id", attempts: int = 3, backoff: float = 2.0) -> DataFrame:
    """Score each batch with ``scorer`` (Series of request texts -> frame with
    sentiment_score, sentiment_label, confidence, market_impact_score, and, if
    the scorer gives them, entities and keywords as lists of texts).

    A batch is retried ``attempts`` times with growing waits; if it still
    fails its rows are scored one by one, and only a row that fails alone gets
    the fixed default reply and ``scored_ok = false``.  A reply of another
    length, or without one of the required fields, is a failure; an absent value
    follows C-10 (0.0, 'neutral', no entities or keywords, market impact stays
    NULL).  Output schema is fixed, so the plan is stable.  The function must be
    deterministic (a retried task re-scores the same rows)."""
    text = text if text is not None else request_text("title", "content")
    x = news.select(F.col(id_col).alias("id"), text.alias("text"))
    d = S.DEFAULT_SCORE_REPLY

    def lists(out: pd.DataFrame, name: str) -> list[list[str]]:
        given = out[name] if name in out else [None] * len(out)
        return [[str(v) for v in x] if isinstance(x, (list, tuple)) else [] for x in given]

    def attempt(texts: pd.Series, tries: int) -> pd.DataFrame | None:
        for i in range(tries):
            try:
                out = scorer(texts)
                if len(out) != len(texts):
                    raise ValueError(f"{len(out)} replies for {len(texts)} texts")
                return pd.DataFrame({
                    "sentiment_score": pd.to_numeric(out["sentiment_score"]).astype("float64").fillna(0.0).values,
                    "sentiment_label": out["sentiment_label"].astype(object).where(out["sentiment_label"].notna(), "neutral").values,
                    "confidence": pd.to_numeric(out["confidence"]).astype("float64").fillna(0.0).values,
                    "entities": lists(out, "entities"), "keywords": lists(out, "keywords"),
                    "market_impact_score": pd.to_numeric(out["market_impact_score"]).astype("Int32").values,
                    "scored_ok": True,
                })
            except Exception:  # noqa: BLE001 - any scorer failure falls back
                if i + 1 < tries:
                    time.sleep(min(10.0, backoff * (i + 1)))
        return None

    def default() -> pd.DataFrame:
        names = ("sentiment_score", "sentiment_label", "confidence", "entities", "keywords", "market_impact_score")
        return pd.DataFrame({**{n: [d[n]] for n in names}, "scored_ok": [False]}).astype({"market_impact_score": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            out = attempt(pdf["text"], attempts)
            if out is None:
                rows = [attempt(pdf["text"].iloc[i:i + 1], 1) for i in range(len(pdf))]
                out = pd.concat([default() if r is None else r for r in rows], ignore_index=True)
            out.insert(0, "id", pdf["id"].astype("int64").values)
            yield out

    return x.mapInPandas(run, REPLY_SCHEMA)


def pandas_lexicon_scorer(lexicon_rows: list[tuple[str, str]]) -> Callable[[pd.Series], pd.DataFrame]:
    """A local scorer with G-1's formula, for tests and as an example plug-in;
    the keywords are the words it found."""
    listed = [(p, w) for p, w in lexicon_rows if p in ("positive", "negative") and w]

    def half_away(num: np.ndarray, den: np.ndarray) -> np.ndarray:
        """num / den to four digits, halves away from zero, 0 where den is 0."""
        scale, safe = 10_000, np.maximum(den, 1)
        return np.where(den > 0, np.sign(num) * ((np.abs(num) * 2 * scale + safe) // (2 * safe)), 0) / scale

    def score(texts: pd.Series) -> pd.DataFrame:
        t = texts.fillna("")
        counts = np.array([t.str.count(re.escape(w)).to_numpy(np.int64) for _, w in listed]).reshape(len(listed), len(t))
        is_pos = np.array([p == "positive" for p, _ in listed], bool)
        p, n = counts[is_pos].sum(axis=0), counts[~is_pos].sum(axis=0)
        s = half_away(p - n, p + n)
        words = np.array([w for _, w in listed], dtype=object)
        return pd.DataFrame({
            "sentiment_score": s,
            "sentiment_label": np.select([s > S.POSITIVE_THRESHOLD, s < S.NEGATIVE_THRESHOLD], ["positive", "negative"], "neutral"),
            "confidence": np.where(p + n > 0, half_away(p + n, p + n + 1), 0.5),
            "keywords": [sorted(set(words[hit])) for hit in (counts > 0).T],
            "market_impact_score": 50})

    return score


# ---- G-4 entities ------------------------------------------------------------------------------
def normalise_entities(text: Column) -> Column:
    """JSON entities given as strings or as objects -> array<struct<name,type,sentiment>>."""
    as_objects = F.from_json(text, "array<struct<name:string,type:string,sentiment:double>>")
    as_strings = F.from_json(text, "array<string>")
    is_objects = text.rlike(r"^\s*\[\s*\{")
    from_strings = F.transform(as_strings, lambda x: F.struct(x.alias("name"), F.lit("unknown").alias("type"),
                                                               F.lit(None).cast("double").alias("sentiment")))
    empty = F.array().cast("array<struct<name:string,type:string,sentiment:double>>")
    return F.coalesce(F.when(is_objects, as_objects).otherwise(from_strings), empty)


# ---- C-10 reply parsing ---------------------------------------------------------------------------
def parse_replies(df: DataFrame, text_col: str = "reply") -> DataFrame:
    """Replies -> parsed fields; rows without any JSON object are error rows."""
    p = C.parse_score_reply(F.col(text_col))
    return df.select("*", p.alias("_p")).select(
        *df.columns,
        F.col("_p").isNull().alias("is_error"),
        F.col("_p.sentiment_score").alias("sentiment_score"),
        F.col("_p.sentiment_label").alias("sentiment_label"),
        F.col("_p.confidence").alias("confidence"),
        F.col("_p.keywords").alias("keywords"),
        F.col("_p.market_impact_score").alias("market_impact_score"),
    )
