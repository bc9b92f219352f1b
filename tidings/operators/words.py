"""Words inside texts, for word tables of any size (G-1, G-3, J-6, D-15).

A q-gram inverted join.  Every word is keyed by its first ``Q`` characters (a
shorter word by all of them); every place of a text gives the grams that start
there, of the lengths some word is keyed by; an equi-join on the gram proposes
(place, word) and the whole word is verified in the join's condition.  So the
cost follows the texts and the true candidates, not words x texts, and no word
ever reaches the driver or becomes part of the plan.

A table of at most ``FEW`` words is cheaper to look for word by word (about 1 ns
a byte and word, against some 200 ns a character for the grams): then its rows are
one array, a scalar subquery, and every text folds over it.  Both plans give the
same rows.

Texts are first cut into chunks of ``CHUNK`` characters (more only where a word
is longer), each carrying the start of the next one, because the n-th character
of a UTF-8 string is found by counting from its start.  The word table is
broadcast if its measured bytes are at most ``BROADCAST_BYTES``; then the texts
are never shuffled, only (row, word, count).  A larger table takes a shuffled
join, whose rows carry the characters of the longest word, and AQE splits a
hot gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 4
CHUNK = 32
BROADCAST_BYTES = 32 << 20
FEW = 64


def _overlaps_itself(word: Column) -> Column:
    """Whether two occurrences of ``word`` can overlap: some end of it is also its start."""
    return F.exists(F.sequence(F.lit(1), F.length(word)), lambda k: (k < F.length(word)) & F.startswith(word, F.substring(word, k + 1, F.length(word))))


def _fold(places: Column, length: Column) -> Column:
    """Occurrences at the sorted ``places`` that do not overlap, leftmost first."""
    start = F.struct(F.lit(0).cast("bigint").alias("free"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        places, start,
        lambda a, p: F.when(p >= a["free"], F.struct((p + length).alias("free"), (a["n"] + 1).alias("n"))).otherwise(a), lambda a: a["n"])


def find_words(texts: DataFrame, words: DataFrame, text_col: str, every_row: bool = False, counts: bool = False,
               broadcast_bytes: int = BROADCAST_BYTES, few: int = FEW) -> DataFrame:
    """One row per row of ``texts`` and word of ``words`` inside its ``text_col``:
    the other columns of ``texts`` (narrow ones), those of ``words`` and, with
    ``counts``, the occurrences that do not overlap (``hits``).

    ``words`` has one row per ``word``; NULL and empty words are ignored, a NULL
    text has no word.  With ``every_row`` a text also has one row without a word
    (NULL, 0 hits).  Rows of ``texts`` are told apart by a number of their own
    (``_row``), so repeated ids do not merge."""
    keep = [c for c in texts.columns if c != text_col]
    words = words.filter(F.length("word") > 0)
    extra = [c for c in words.columns if c != "word"]
    if words.limit(few + 1).count() <= few:
        return _find_few(texts, words, text_col, every_row, counts, keep, extra)
    words = words.withColumn("_loops", _overlaps_itself(F.col("word")))
    # what the plan depends on: one narrow row, whatever the number of words
    size = sum((F.octet_length(F.col(c).cast("string")) for c in words.columns if not isinstance(words.schema[c].dataType, _nested())), F.lit(64))
    stats = words.agg(F.sum(size).alias("bytes"), F.max(F.length("word")).alias("longest"), F.max("_loops").alias("loops"),
                      F.sort_array(F.collect_set(F.least(F.length("word"), F.lit(Q)))).alias("sizes")).first()
    longest, sizes = stats["longest"] or 1, stats["sizes"] or [1]
    chunk = max(CHUNK, longest)

    x = texts.select(F.monotonically_increasing_id().alias("_row"), *keep,
                     F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(f"(?s).{{1,{chunk}}}"), 0).alias("_c"))
    cut = F.transform("_c", lambda c, i: F.struct(
        F.length(c).alias("n"), F.concat(c, F.substring(F.coalesce(F.get("_c", i + 1), F.lit("")), 1, longest - 1)).alias("w")))
    explode = F.posexplode_outer if every_row else F.posexplode
    x = x.select("_row", *keep, explode(cut).alias("_k", "_v")).select("_row", *keep, "_k", "_v.n", "_v.w")
    # place 0 of the first chunk stands for the row itself
    first = F.when(F.coalesce("_k", F.lit(0)) == 0, 0).otherwise(1) if every_row else F.lit(1)
    x = x.select("_row", *keep, "_k", F.coalesce("w", F.lit("")).alias("w"), F.explode(F.sequence(first, F.coalesce("n", F.lit(0)))).alias("_p"))
    p = F.col("_p")
    rest = F.when(p > 0, F.substring(F.col("w"), p, F.lit(longest))).otherwise("")
    x = x.select("_row", *keep, (F.col("_k") * chunk + p).cast("bigint").alias("_at"), (p == 0).alias("_self"), rest.alias("_rest"))
    grams = [F.when(F.length("_rest") >= s, F.substring(F.col("_rest"), 1, s)) for s in sizes]
    x = x.withColumn("_gram", grams[0] if len(grams) == 1 else F.explode(F.array(*grams)))
    if not every_row:
        x = x.filter(F.col("_gram").isNotNull())
    keyed = words.withColumn("_key", F.substring(F.col("word"), F.lit(1), F.least(F.length("word"), F.lit(Q))))
    small = (stats["bytes"] or 0) <= broadcast_bytes
    found = x.join(F.broadcast(keyed) if small else keyed, (F.col("_gram") == F.col("_key")) & F.startswith("_rest", "word"),
                   "left" if every_row else "inner")
    if every_row:
        found = found.filter(F.col("word").isNotNull() | F.col("_self"))
    group = ["_row", *keep, "word", *extra]
    if not counts:
        return found.select(*group).distinct()
    once = F.sum(F.when(F.col("word").isNotNull() & ~F.coalesce("_loops", F.lit(False)), 1).otherwise(0)).cast("bigint")
    if not stats["loops"]:
        return found.groupBy(*group).agg(once.alias("hits"))
    places = F.sort_array(F.collect_list(F.when(F.col("_loops"), F.col("_at"))))
    return found.groupBy(*group).agg(once.alias("_once"), places.alias("_places")).select(
        *group, (F.col("_once") + _fold(F.col("_places"), F.length("word"))).alias("hits"))


def _find_few(texts: DataFrame, words: DataFrame, text_col: str, every_row: bool, counts: bool, keep: list[str], extra: list[str]) -> DataFrame:
    listed = words.agg(F.collect_list(F.struct("word", *extra)).alias("w")).scalar()
    x = texts.select(F.monotonically_increasing_id().alias("_row"), *keep, F.coalesce(text_col, F.lit("")).alias("_t"), listed.alias("_words"))
    inside = F.filter("_words", lambda w: F.col("_t").contains(w["word"]))
    if counts:  # every occurrence that is taken out shortens the text by the word's bytes
        removed = lambda w: F.octet_length("_t") - F.octet_length(F.replace(F.col("_t"), w["word"], F.lit("")))
        inside = F.transform(inside, lambda w: F.struct(w.alias("w"), (removed(w) / F.octet_length(w["word"])).cast("bigint").alias("hits")))
    else:
        inside = F.transform(inside, lambda w: F.struct(w.alias("w")))
    found = x.select("_row", *keep, (F.explode_outer if every_row else F.explode)(inside).alias("e"))
    hits = [F.coalesce("e.hits", F.lit(0)).cast("bigint").alias("hits")] if counts else []
    return found.select("_row", *keep, "e.w.word", *[F.col(f"e.w.{c}").alias(c) for c in extra], *hits)


def _nested() -> tuple:
    from pyspark.sql import types as T

    return T.ArrayType, T.MapType, T.StructType
