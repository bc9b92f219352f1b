"""Quality rules: hashed n-gram log-likelihood ratio plus repetition and length rules.

Method.  Two multinomials over hashed n-grams are fitted: the *raw corpus* from
every n-gram of every document, the *trusted target* from the documents labelled
good.  The n-grams are of characters by kind (lower-case, upper-case, digit,
blank; punctuation as it is), so a language that is rare among the trusted
documents is not taken for bad text.  The target is smoothed towards the raw
corpus (``PRIOR`` of its own mass), so what the target merely has not seen costs a
bounded amount.  A document's score is the mean over its n-grams of
``log p_target - log p_raw`` (length-normalised, so long texts do not win by
length), and a document is kept when the score reaches a fixed threshold: no
random resampling, the same document always gets the same verdict.

Beside it a second ratio of the same form is taken over n-grams of the bytes
themselves (``LETTERS`` long; letters in lower case, digits and blanks by kind),
which tells words from letters put together at random.  What speaks against a
text is backed off to the raw share (ratio 0) in cells that hold at least an even
share of the raw corpus, as those of a language that is rare among the trusted
documents do, and in cells of other bytes than ASCII that no trusted document
has.  A document below ``MIN_LETTERS`` goes.

Scale.  Both passes are map-only over the text; each task adds its counts into
one dense vector of ``2**bits`` cells and sends only non-zero cells, which Spark
sums per cell (at most ``2**bits`` rows and as many as the byte n-grams have
cells, so one cell is never hot beyond the number of tasks).  The model broadcast
has as many doubles at any corpus size.  The trusted target is fitted on at most ``max_trusted`` labelled rows (a
documented bound, picked by hash); the raw counts cover all documents.

Edge cases.  A null or empty text has no words and no n-grams: score 0, base
rules fail.  Texts shorter than one n-gram have score 0.  Without any trusted
row, or on an empty table, every ratio is 0 and only the base rules decide.
Repeated rows are judged alike; a null doc_id is kept as null and is never
trusted.  Other columns of the input are ignored by ``judge`` and passed through
untouched by ``keep_good``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

NGRAM = 6
BITS = 14
PRIOR = 0.1
MIN_SCORE = -0.1  # mean log-ratio per n-gram below which a document is rejected
MAX_TRUSTED = 20_000
LETTERS = 4
LETTER_BITS = 18  # cells of ASCII n-grams, as many again for the others
MIN_LETTERS = -1.0  # mean log-ratio per byte n-gram below which a document is rejected
BLOCK = 1 << 20  # bytes of one text hashed at a time

MIN_WORDS = 20
MAX_REPEAT_PCT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

_SYMBOL = re.compile(b"[" + re.escape(SYMBOLS) + b"]")


def _kind(b: int) -> int:
    c = chr(b)
    if b >= 0x80 or c.islower():
        return ord("a")
    return ord("A") if c.isupper() else ord("0") if c.isdigit() else ord(" ") if c in "\t\v\f\r" else b


_KINDS = bytes(map(_kind, range(256)))
_PLAIN = bytes(_KINDS[b] if chr(b) in "\t\v\f\r0123456789" else b for b in range(256))


def cells(text: bytes, n: int = NGRAM, bits: int = BITS) -> Iterator[np.ndarray]:
    """Cell numbers of all n-grams of a text, in blocks of bounded size."""
    text = text.translate(_KINDS)
    for at in range(0, max(0, len(text) - n + 1), BLOCK):
        a = np.frombuffer(text, np.uint8, min(BLOCK + n - 1, len(text) - at), at).astype(np.uint64)
        m = len(a) - n + 1
        h = a[:m].copy()
        for i in range(1, n):
            h *= np.uint64(257)
            h += a[i:i + m]
        h *= np.uint64(0x9E3779B97F4A7C15)
        yield (h >> np.uint64(64 - bits)).astype(np.int64)


def letter_cells(text: bytes) -> Iterator[np.ndarray]:
    """Cell numbers of all byte n-grams of a text; those with other bytes than
    ASCII in the upper half."""
    text = text.lower().translate(_PLAIN)
    for at in range(0, max(0, len(text) - LETTERS + 1), BLOCK):
        a = np.frombuffer(text, np.uint8, min(BLOCK + LETTERS - 1, len(text) - at), at)
        m = len(a) - LETTERS + 1
        h, other = a[:m].astype(np.uint64), a[:m].copy()
        for i in range(1, LETTERS):
            h *= np.uint64(257)
            h += a[i:i + m]
            other |= a[i:i + m]
        h *= np.uint64(0x9E3779B97F4A7C15)
        yield (h >> np.uint64(64 - LETTER_BITS)).astype(np.int64) + ((other >> 7).astype(np.int64) << LETTER_BITS)


def _windows_equal(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    return all(np.array_equal(ids[a + k], ids[b + k]) for k in range(WINDOW))


def repeated_words(words: list[bytes]) -> int:
    """Number of words inside 8-word windows that occur at least twice in the
    text, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) > len(words) - 2:  # every window but overlapping ones holds a unique word
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n].astype(np.uint64) + np.uint64(1)
    _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[back] > 1)
    if not len(starts):
        return 0
    if not _windows_equal(ids, starts, first[back[starts]]):  # two windows share a hash: count exactly
        at: dict[tuple, list[int]] = {}
        for i in starts.tolist():
            at.setdefault(tuple(ids[i:i + WINDOW].tolist()), []).append(i)
        starts = np.array([i for v in at.values() if len(v) > 1 for i in v], np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def measures(text: bytes | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()  # bytes.split() splits at \x20 and \x09-\x0D
    chars = len(text.decode()) - sum(text.count(bytes([c])) for c in SPACES)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), chars, len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated_words(words))


def _counts(n: int, bits: int):
    schema = pa.schema([("cell", pa.int32()), ("raw", pa.int64()), ("trusted", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << bits) + (2 << LETTER_BITS)
        raw, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for text, trusted in zip(utf8(batch, "text"), batch.column("trusted").to_pylist()):
                for found, part in ((cells(text or b"", n, bits), slice(0, 1 << bits)), (letter_cells(text or b""), slice(1 << bits, size))):
                    for c in found:
                        length = part.stop - part.start
                        k = np.bincount(c, minlength=length) if len(c) > length >> 4 else None
                        for vector in (raw[part], good[part]) if trusted else (raw[part],):
                            if k is None:
                                np.add.at(vector, c, 1)
                            else:
                                vector += k
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(good[used])], schema=schema)

    return run


def fit(docs: DataFrame, labels: DataFrame, max_trusted: int = MAX_TRUSTED, n: int = NGRAM, bits: int = BITS) -> np.ndarray:
    """Log-ratio of each cell of the kind n-grams (see ``fit_both``)."""
    return fit_both(docs, labels, max_trusted, n, bits)[0]


def fit_both(docs: DataFrame, labels: DataFrame, max_trusted: int = MAX_TRUSTED, n: int = NGRAM, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Log-ratio of each cell of the kind n-grams, and of the byte n-grams.
    ``docs``: doc_id, text; ``labels``: doc_id, quality (1: trusted)."""
    trusted = (labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
               .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
               .withColumn("trusted", F.lit(True)))
    # at most max_trusted ids, so the broadcast is bounded at any corpus size
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left").select("text", "trusted")
    sums = (marked.mapInArrow(_counts(n, bits), "cell int, raw long, trusted long")
            .groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas())
    size = (1 << bits) + (2 << LETTER_BITS)
    raw, good = np.zeros(size), np.zeros(size)
    raw[sums["cell"].to_numpy(np.int64)] = sums["raw"].to_numpy()
    good[sums["cell"].to_numpy(np.int64)] = sums["trusted"].to_numpy()
    kinds, share = _ratio(raw[:1 << bits], good[:1 << bits])
    letters, share = _ratio(raw[1 << bits:], good[1 << bits:])
    known = good[1 << bits:] > 0
    known[:1 << LETTER_BITS] = True
    letters[(letters < 0) & ((share >= 1 / (1 << LETTER_BITS)) | ~known)] = 0
    return kinds, letters


def _ratio(raw: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-ratio and raw share of each cell."""
    ratio, share = np.zeros(len(raw)), raw / max(raw.sum(), 1)
    if good.sum():
        seen = raw > 0  # a cell that no text has is never asked for
        ratio[seen] = np.log((good[seen] / good.sum() + PRIOR * share[seen]) / ((1 + PRIOR) * share[seen]))
    return ratio, share


def llr(text: bytes | None, ratio: np.ndarray, n: int = NGRAM) -> float:
    bits = len(ratio).bit_length() - 1
    total, count = 0.0, 0
    for c in cells(text or b"", n, bits):
        total, count = total + float(ratio[c].sum()), count + len(c)
    return total / count if count else 0.0


def letters_llr(text: bytes | None, ratio: np.ndarray) -> float:
    total, count = 0.0, 0
    for c in letter_cells(text or b""):
        total, count = total + float(ratio[c].sum()), count + len(c)
    return total / count if count else 0.0


def verdicts(texts: list[bytes | None], ratios: tuple[np.ndarray, np.ndarray], min_score: float, n: int) -> list[tuple]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, letter_score, base_failed, kept) per text."""
    out = []
    for text in texts:
        m = measures(text)
        score, letters = llr(text, ratios[0], n), letters_llr(text, ratios[1])
        failed = m[0] < MIN_WORDS or 100 * m[4] > MAX_REPEAT_PCT * m[0]
        out.append((*m, score, letters, failed, not failed and score >= min_score and letters >= MIN_LETTERS))
    return out


JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, letter_score double, base_failed boolean, kept boolean"


def judge(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE, max_trusted: int = MAX_TRUSTED,
          n: int = NGRAM, bits: int = BITS) -> DataFrame:
    """One row per document: measures, score, letter_score, base_failed, kept."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit_both(docs, labels, max_trusted, n, bits))
    names = [x.split()[0] for x in JUDGED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = model.value
        for batch in batches:
            rows = list(zip(*verdicts(utf8(batch, "text"), ratios, min_score, n))) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(v, k) for v, k in zip(rows, kinds))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, JUDGED)


def keep_good(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE, max_trusted: int = MAX_TRUSTED,
              n: int = NGRAM, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit_both(docs, labels, max_trusted, n, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = model.value
        for batch in batches:
            kept = [v[-1] for v in verdicts(utf8(batch, "text"), ratios, min_score, n)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
