"""Benchmark decontamination with one Aho-Corasick automaton.

Method.  Questions and answers of the benchmark are normalised to words (A-Z
lower-cased, a word is a run of letters, digits and non-ASCII characters) and
cut into windows of ``window`` consecutive words; an item of fewer words is one
window.  All windows form one Aho-Corasick automaton whose alphabet is the
benchmark's words (one symbol per word, one more for any other word), so its
size follows the number of windows, not their characters.  Each document is
normalised alike and scanned once; a match covers its words, and word numbers
map back to byte offsets of the original text.

Scale.  Map-only over the documents.  The benchmark is a stated set that does
not grow with the corpus; its texts are broadcast and must fit ``max_bytes``
(checked in Spark before anything is collected; more raises an error).  A worker
builds the automaton once and keeps it; it takes about 170 bytes for a byte of
benchmark text (measured: 706 MB and 40 s for 4.2 MB), so the bound stands for
0.7 GB a worker; raise it with the workers' memory.

Edge cases.  Null and empty texts have no words and no hits.  Null or empty
items have no window.  Rows with one item_id are one item; a null item_id counts
as the item named `null`.  Repeated windows and items with the same window all
count.  No items: nothing is hit.  Other columns are ignored by ``scan`` and
passed through by ``keep_clean``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

WINDOW = 13
MIN_SHARE = 20  # contaminated from one word in 20
MAX_BYTES = 4 << 20

# A-Z to a-z, every other ASCII byte that is no letter or digit to a space
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


class Scanner:
    """Automaton over the windows of all items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        windows: dict[tuple[bytes, ...], set[str]] = {}
        for name, text in items:
            w = words(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                windows.setdefault(tuple(w[i:i + window]), set()).add(name)
        self.symbols: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        for key, names in windows.items():
            path = "".join(self.symbols.setdefault(w, _symbol(len(self.symbols))) for w in key)
            self.automaton.add_word(path, (len(key), tuple(names)))
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """(number of words, merged runs [first word, last word + 1), item names)."""
        w = words(text)
        if self.empty or not w:
            return len(w), [], []
        get = self.symbols.get
        line = "".join([get(x, "\0") for x in w])
        runs: list[tuple[int, int]] = []
        names: set[str] = set()
        for end, (length, found) in self.automaton.iter(line):
            first, names = end + 1 - length, names.union(found) if not names.issuperset(found) else names
            while runs and runs[-1][1] >= first:
                first = min(first, runs.pop()[0])
            runs.append((first, end + 1))
        return len(w), runs, sorted(names)


def _symbol(i: int) -> str:
    """Code point of the i-th word: above zero, past the surrogates."""
    return chr(i + 1 if i + 1 < 0xD800 else i + 1 + 0x800)


_SCANNERS: dict[tuple[str, int], Scanner] = {}


def _scanner(items: list[tuple[str, bytes]], window: int) -> Scanner:
    """One automaton per worker process: that of the last benchmark."""
    digest = hashlib.sha256()
    for name, text in items:
        digest.update(b"%d %d " % (len(name), len(text)) + name.encode() + text)
    key = (digest.hexdigest(), window)
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(items, window)
    return _SCANNERS[key]


def items_of(benchmark: DataFrame, max_bytes: int = MAX_BYTES) -> list[tuple[str, bytes]]:
    """(item_id as text, text) of all items, after a check of their size."""
    named = benchmark.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.encode("text", "UTF-8").alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text; max_bytes is {max_bytes}")
    return [(r["name"], bytes(r["text"])) for r in named.collect()]


def contaminated(n_words: int, n_hit: int, min_share: int = MIN_SHARE) -> bool:
    return n_hit > 0 and min_share * n_hit >= n_words


def _hits(runs: list[tuple[int, int]]) -> int:
    return sum(b - a for a, b in runs)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: int = MIN_SHARE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (item_ids as text), spans
    (byte offsets of the covered passages in the original text), contaminated."""
    items = docs.sparkSession.sparkContext.broadcast(items_of(benchmark))
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(items.value, window)
        for batch in batches:
            rows = []
            for text in utf8(batch, "text"):
                n, runs, names = scanner.scan(text)
                at = np.array([m.span() for m in _WORD.finditer(text)], np.int64) if runs else None
                spans = [{"start": int(at[a][0]), "stop": int(at[b - 1][1])} for a, b in runs]
                rows.append((n, _hits(runs), names, spans, contaminated(n, _hits(runs), min_share)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(span), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             names=["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, stop: long>>, contaminated boolean")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: int = MIN_SHARE) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are."""
    items = docs.sparkSession.sparkContext.broadcast(items_of(benchmark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(items.value, window)
        for batch in batches:
            found = (scanner.scan(t) for t in utf8(batch, "text"))
            yield batch.filter(pa.array([not contaminated(n, _hits(runs), min_share) for n, runs, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
