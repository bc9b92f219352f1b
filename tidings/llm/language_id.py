"""Language ID by compression.

Method.  Each language has a zstandard raw-content dictionary made of sample
text.  A text is compressed in blocks once per language; the language whose
dictionary gives the smallest total wins.  The margin to the second smallest,
as a share of it, is the score; documents with a narrow margin are rejected.

Scale.  Training takes about ``rows_per_lang`` labelled rows of each language (a
documented bound, picked by hash over all rows) and ``dict_bytes / rows_per_lang``
characters of each different text among them, so that all of them enter; the
dictionaries have ``dict_bytes`` at most, and the broadcast is the number of
labels times that.  Prediction is map-only, with the same compressor settings for
every text; a text is compressed block by block, in time proportional to its
length and memory a few times its own.

Edge cases.  A null text, an empty text and a text without any letter is `und`
with score 0 (rejected).  Equal sizes: the language with more labelled rows (then
the one that sorts first) wins with score 0 (rejected if ``min_margin`` is above 0).  No labelled row at all: every
document is `und`.  With one learned language it is always predicted, score 1.
Only ``text`` is an input of a prediction; repeated rows get equal results;
null doc_ids stay null and are never learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

ROWS_PER_LANG = 400
DICT_BYTES = 64 << 10
BLOCK = 4096  # bytes compressed at a time
MIN_MARGIN = 0.005

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased letter runs joined by single spaces: what is compressed."""
    return _NOT_LETTERS.sub(" ", text).lower().strip()


def dictionaries(labelled: DataFrame, rows_per_lang: int = ROWS_PER_LANG, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw-content dictionary of each language from ``labelled`` (doc_id, text,
    lang), the language with most rows first.

    Every row of a language is a candidate; about ``rows_per_lang`` of each are
    taken by a hash of the row, at a rate computed from the language's count.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)).select(
        "lang", "text", F.xxhash64(F.lit("sample"), "doc_id", "text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, rows_per_lang / n))])
    share = (F.col("h").cast("double") / F.lit(2.0 ** 64)) + F.lit(0.5)
    # a piece of every sampled text, from a place given by the text's hash; copies of a text give one
    piece = max(dict_bytes // rows_per_lang, 1)
    at = F.lit(1) + F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - F.lit(piece) + 1, F.lit(1)))
    sample = (rows.where(share < rate[F.col("lang")])
              .select("lang", "h", F.substring(F.col("text"), at.cast("int"), F.lit(piece)).alias("part"))
              .groupBy("lang", "part").agg(F.min("h").alias("h")).select("lang", "h", "part"))
    out: dict[str, bytearray] = {k: bytearray() for k in sorted(counts, key=lambda k: (-counts[k], k))}
    for r in sorted(sample.collect()):
        if len(out[r["lang"]]) < dict_bytes:
            out[r["lang"]] += letters(r["part"]).encode() + b" "
    return {k: bytes(v[:dict_bytes]) for k, v in out.items() if v.strip()}


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dicts: dict[str, bytes]):
        import zstandard as z

        self.langs = list(dicts)

        params = z.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=17, search_log=6, min_match=3, target_length=32, strategy=z.STRATEGY_BTLAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compressors = []
        for k in self.langs:
            d = z.ZstdCompressionDict(dicts[k], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compressors.append(z.ZstdCompressor(dict_data=d, compression_params=params))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language or `und`, margin in 0..1)."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        data = letters(text).encode()
        sizes = [0] * len(self.langs)
        for at in range(0, len(data), BLOCK):
            block = data[at:at + BLOCK]
            for i, c in enumerate(self.compressors):
                sizes[i] += len(c.compress(block))
        if len(sizes) == 1:
            return self.langs[0], 1.0
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.langs[best], (second - sizes[best]) / second


def _predictor(docs: DataFrame, dicts: dict[str, bytes]):
    model = docs.sparkSession.sparkContext.broadcast(dicts)

    def predictions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, float]]]]:
        classifier = Classifier(model.value)
        for batch in batches:
            yield batch, [classifier.predict(t) for t in batch.column("text").to_pylist()]

    return predictions


def identify(docs: DataFrame, dicts: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, accepted of each document."""
    predictions = _predictor(docs, dicts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in predictions(batches):
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64()),
                pa.array([x[0] != "und" and x[1] >= min_margin for x in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, dicts: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is identified, all columns as they are."""
    predictions = _predictor(docs, dicts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in predictions(batches):
            yield batch.filter(pa.array([x[0] != "und" and x[1] >= min_margin for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    """crc32(doc_id as text) mod 5 is 0; a row without a doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
