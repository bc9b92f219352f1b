"""Secret scan by patterns and a battery of randomness tests.

Patterns.  Assignments to password-like names, access keys and hexadecimal runs
are found by fixed patterns, leftmost and not overlapping within a kind.

Battery.  A candidate is a maximal run of at least ``MIN_LENGTH`` characters
``[A-Za-z0-9+/_-]``.  Its encoding is the smallest alphabet that holds its
characters (decimal, hexadecimal, base32, base36, base62, base64, URL base64, all
66), and three tests ask whether it is uniform over that alphabet: chi-squared of
the symbol counts (as a normal deviate, Wilson and Hilferty), runs above and
below the alphabet's middle, and serial correlation of neighbours.  The squares
of the three deviates add up to one statistic, chi-squared with three degrees of
freedom for a random string and large for an ordinary one.

Length-aware false-discovery control.  A short ordinary string can look random,
so each class of lengths has its own null distribution: every document's words
of fewer than ``MIN_LENGTH`` characters are joined as identifiers are (plain, by
`_`, by `-`, or capitalised) and cut into strings of the shortest length of a
class; a checksum of the text says which class and which joining.  The p-value of
a candidate is the share of these with a statistic as small as its own, and
Benjamini and Hochberg's rule over all candidates of the corpus gives each
class its cutoff at the false-discovery rate ``rate``.  A candidate is reported
if its class passes and the battery itself does not reject it (``RANDOM``).

Scale.  Two map-only scans of the texts.  The first sends one small histogram a
task (2 x classes x ``CELLS`` counts at most) through one aggregate; the driver
gets that many sums, whatever the input.  The second needs a cutoff per class.
Memory is a few times the longest text.

Edge cases.  Null and empty texts have no spans.  Very long texts and candidates
are tested whole, strings of the null distribution in blocks.  Repeated rows
count and are reported each time.  Spans with one start are ordered by kind.  A
corpus without ordinary words has no null distribution: only the patterns
report.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns, their least lengths and the order of their kinds
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20

MIN_LENGTH = 20
LENGTHS = np.array([20, 24, 32, 40, 48, 64, 96])  # shortest length of each class
CELLS, CELL = 256, 0.25  # cells of the statistic; the last holds the rest
RATE = 0.01
RANDOM = 16.25  # of the statistic: one random string in a thousand is above
BLOCK = 1 << 20  # characters of the null distribution tested at a time

_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % MIN_LENGTH)
_ALNUM = bytes(b if b < 0x80 and chr(b).isalnum() else 0x20 for b in range(256))
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# alphabets from small to large; the first that holds all characters is the encoding
ALPHABETS = [_DIGITS, _DIGITS + _LOWER[:6], _DIGITS + _UPPER[:6], _UPPER + _DIGITS[2:8], _DIGITS + _LOWER, _DIGITS + _UPPER,
             _DIGITS + _UPPER + _LOWER, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_",
             _UPPER + _LOWER + _DIGITS + "+/-_"]
_SIZES = np.array([len(a) for a in ALPHABETS])
_HOLDS = np.zeros(256, np.uint16)  # bit e is set if alphabet e lacks the character
_VALUES = np.zeros((len(ALPHABETS), 256), np.int64)
for _e, _alphabet in enumerate(ALPHABETS):
    _HOLDS |= np.array([0 if chr(b) in _alphabet else 1 << _e for b in range(256)], np.uint16)
    for _v, _c in enumerate(_alphabet):
        _VALUES[_e, ord(_c)] = _v
_FIRST = np.array([next((e for e in range(len(ALPHABETS)) if not lacking >> e & 1), len(ALPHABETS) - 1) for lacking in range(1 << len(ALPHABETS))])


def battery(strings: np.ndarray) -> np.ndarray:
    """The statistic of each row of ``strings`` (bytes, all of one length)."""
    rows, n = strings.shape
    encoding = _FIRST[np.bitwise_or.reduce(_HOLDS[strings], axis=1)]
    size = _SIZES[encoding].astype(float)
    values = _VALUES[encoding[:, None], strings]
    counts = np.bincount((values + np.arange(rows)[:, None] * 66).ravel(), minlength=rows * 66).reshape(rows, 66).astype(float)
    chi = size / n * (counts * counts).sum(axis=1) - n
    spread = 2 / (9 * (size - 1))
    uniform = (np.cbrt(chi / (size - 1)) - 1 + spread) / np.sqrt(spread)
    high = 2 * values >= _SIZES[encoding][:, None]
    changes = (high[:, 1:] != high[:, :-1]).sum(axis=1)
    runs = (changes - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    centred = values - (size - 1)[:, None] / 2
    serial = (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / ((size * size - 1) / 12) / math.sqrt(n - 1)
    return uniform ** 2 + runs ** 2 + serial ** 2


def _cell(statistic: np.ndarray) -> np.ndarray:
    return np.minimum(statistic / CELL, CELLS - 1).astype(int)


def _class(length: int) -> int:
    return int(np.searchsorted(LENGTHS, length, "right")) - 1


def candidates(text: str) -> list[tuple[int, int, float]]:
    """(start, end, statistic) of each candidate."""
    return [(m.start(), m.end(), float(battery(np.frombuffer(m.group().encode(), np.uint8)[None])[0])) for m in _RUN.finditer(text)]


def ordinary(text: str) -> tuple[int, bytes]:
    """Class of lengths and the characters of the text's strings for the null distribution."""
    data = text.encode()
    kind, style = divmod(zlib.crc32(data) % (4 * len(LENGTHS)), 4)
    words = [w for w in data.translate(_ALNUM).split() if len(w) < MIN_LENGTH]
    if style == 3:
        words = [w.capitalize() for w in words]
    return kind, (b"", b"_", b"-", b"")[style].join(words)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, len(LENGTHS), CELLS), np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            for start, end, statistic in candidates(text):
                counts[0, _class(end - start), _cell(np.array(statistic))] += 1
            kind, joined = ordinary(text)
            length = int(LENGTHS[kind])
            step = BLOCK // length * length
            for at in range(0, len(joined) - length + 1, step):
                part = joined[at:at + step]
                strings = np.frombuffer(part, np.uint8, len(part) // length * length).reshape(-1, length)
                counts[1, kind] += np.bincount(_cell(battery(strings)), minlength=CELLS)
    null, kind, cell = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (null, kind, cell, counts[null, kind, cell])], names=["is_null", "class", "cell", "n"])


def cutoffs(counts: np.ndarray, rate: float = RATE) -> list[float]:
    """Largest statistic to report of each class of lengths (0: none), from the
    counts of (candidates, null strings) by class and cell."""
    found, null = counts.astype(float)
    p = (1 + null.cumsum(axis=1)) / (1 + null.sum(axis=1, keepdims=True))
    p[null.sum(axis=1) == 0] = 1
    order = np.argsort(p, axis=None, kind="stable")
    ranked, total = p.ravel()[order], max(found.sum(), 1)
    at_most = np.cumsum(found.ravel()[order])
    at_most = at_most[np.searchsorted(ranked, ranked, "right") - 1]  # equal p-values count together
    passing = ranked[(ranked <= rate * at_most / total) & (at_most > 0)]
    limit = passing.max() if len(passing) else -1.0
    return [min(RANDOM, CELL * int((row <= limit).sum())) for row in p]


def fit(docs: DataFrame, rate: float = RATE) -> list[float]:
    """Cutoffs of the classes of lengths over all texts of ``docs``."""
    sums = docs.select("text").mapInArrow(_histogram, "is_null long, class long, cell long, n long") \
        .groupBy("is_null", "class", "cell").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, len(LENGTHS), CELLS), np.int64)
    for r in sums.collect():
        counts[r["is_null"], r["class"], r["cell"]] = r["n"]
    return cutoffs(counts, rate)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return sorted(spans + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


def random_spans(text: str, limits: list[float], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates that look random and lie in no base span."""
    return [(start, 3, end) for start, end, statistic in candidates(text)
            if statistic < limits[_class(end - start)] and not any(s <= start and end <= e for s, _, e in base)]


def scan(docs: DataFrame, limits: list[float]) -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                spans = sorted(base + random_spans(text, limits, base)) if text else []
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, spans array<struct<kind:string,start:bigint,end:bigint>>")

