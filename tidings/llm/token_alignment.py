"""Alignment of two tokenizers' tokens by diagonal run skipping.

Every text is encoded by a byte-level BPE (A, given a space before the text) and
by a SentencePiece model (B, which adds that space).  Both spell the same bytes,
so each token is a byte range, and the offsets where tokens of both end cut the
tokens into groups.

Diagonal run skipping.  The arrays of ends are compared at the current index
shift (B's index minus A's): slices of doubling size are compared whole while
they agree, then halving sizes find the first difference, so a one-to-one stretch
of n tokens takes about 2 log2(n) comparisons.  At a difference the group is
resolved by stepping the side that is behind until both ends agree; that sets
the new shift.

Counts of linked ids.  A task packs its documents into blocks of about
``BLOCK_BYTES`` of text.  A block carries its distinct id pairs with the number
of its documents that hold each, and its documents refer to these by position.
The pairs of all blocks are summed, each A id's highest count is found, and the
counts return to the blocks by a join on the pair: what is shuffled is a row per
block and distinct pair, not per document and pair.  The documents' positions and
counts are two compressed values a block, which Spark moves without reading them.

Scale.  A pair has a row per block that holds it, so the commonest pairs
have equally many rows and none is hot; copies share their block's pairs.  A long
text is cut, at single spaces between characters other than white space, where neither
tokenizer joins anything, into segments of about ``SEGMENT`` characters; memory then follows
the segment and the distinct pairs.  A text without such places is encoded whole.
Texts come to a worker ``BATCH_BYTES`` at a time, and ``ROWS`` blocks are read at once.
Tokens of both end before such a space, so the units between them are aligned by
themselves: unseen ones in parts of up to ``PART`` units, each part as one text.  The
groups of short ones are kept in the worker; those not met again while
``MAX_UNITS`` others, or ``STORE_BYTES`` of them, were give way.

Edge cases.  Null and empty texts, and texts that A or B do not spell byte for
byte, have no tokens.  A group of many tokens (long white space) is counted by its
distinct ids, its links are never listed.  Strings of special tokens are
plain text.  Ties for an A id's highest count all count.  Repeated rows are
documents of their own; null ids stay.  An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import batches_of, written
from .token_counts import byte_symbols

BLOCK_BYTES = 4 << 20
SEGMENT = 1 << 16
UNIT = 40  # characters up to which a unit's ids are kept
MAX_UNITS = 80_000
STORE_BYTES = 48 << 20  # of kept units, counted as ``UNIT_BYTES`` each besides groups and pairs
UNIT_BYTES = 320
BATCH_BYTES = 4 << 20  # of texts sent to a worker at once
ROWS = 8  # blocks of a Parquet row group: Spark reads the lists of a row group at once
PART, PART_CHARS = 256, 4096  # units encoded as one text: the libraries slow down on long ones
LISTED = 4096  # links of a group up to which they are listed one by one

_CUT = re.compile(r"(?<=\S) (?=\S)")
# characters whose pre-tokens are alike in every library: ASCII and Latin letters
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u024f]*")
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# a unit's groups as text, its linked pairs (int64, repeats included), its numbers of A's and B's tokens
Unit = tuple[str, bytes, int, int]


class Aligned(NamedTuple):
    """Tokens of one segment; group g is A's tokens a_cuts[g]:a_cuts[g + 1] and B's alike."""

    a: np.ndarray
    b: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray


def cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices where groups of tokens with the ends ``a`` and ``b`` (both int32,
    rising, the last equal) begin, and the ends of both."""
    n, flat_a, flat_b, ends_a, ends_b = len(a), a.tobytes(), b.tobytes(), a.tolist(), b.tolist()
    starts, stops, shifts = [], [], []  # of the one-to-one stretches; empty ones keep their start
    i = shift = 0
    while True:
        starts.append(i)
        shifts.append(shift)
        if i < n and ends_a[i] == ends_b[i + shift]:
            i, size, by = i + 1, 2, 4 * shift
            while i + size <= n and flat_a[4 * i:4 * (i + size)] == flat_b[4 * i + by:4 * (i + size) + by]:
                i += size
                size *= 2
            while size > 2:
                size //= 2
                if i + size <= n and flat_a[4 * i:4 * (i + size)] == flat_b[4 * i + by:4 * (i + size) + by]:
                    i += size
            if i < n and ends_a[i] == ends_b[i + shift]:
                i += 1
        stops.append(i)
        if i == n:
            break
        j = i + shift
        end_a, end_b = ends_a[i], ends_b[j]
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = ends_a[i]
            else:
                j += 1
                end_b = ends_b[j]
        i += 1
        shift = j + 1 - i
    first = np.array(starts, np.int64)
    sizes = np.array(stops, np.int64) - first + 1
    at = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
    return at, at + np.repeat(np.array(shifts, np.int64), sizes)


def _sizes(at: np.ndarray) -> np.ndarray:
    return at[1:] - at[:-1]


def _listed(x: Aligned, which: np.ndarray) -> np.ndarray:
    """The linked pairs (A id * 2**32 + B id) of the groups ``which``, one by one."""
    high = _sizes(x.b_cuts)[which]
    per = _sizes(x.a_cuts)[which] * high
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    high = np.repeat(high, per)
    return (x.a[np.repeat(x.a_cuts[which], per) + place // high] << 32) + x.b[np.repeat(x.b_cuts[which], per) + place % high]


def links(x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs (A id * 2**32 + B id) and how often each is linked."""
    per = _sizes(x.a_cuts) * _sizes(x.b_cuts)
    found, counts = np.unique(_listed(x, np.flatnonzero(per <= LISTED)), return_counts=True)
    for g in np.flatnonzero(per > LISTED):
        a, n_a = np.unique(x.a[x.a_cuts[g]:x.a_cuts[g + 1]], return_counts=True)
        b, n_b = np.unique(x.b[x.b_cuts[g]:x.b_cuts[g + 1]], return_counts=True)
        found, counts = _summed([found, ((a << 32)[:, None] + b).ravel()], [counts, (n_a[:, None] * n_b).ravel()])
    return found, counts


def _summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    return found, total


def parts(units: Iterable[str]) -> Iterator[list[str]]:
    """``units`` in lists of up to ``PART``; lists of several have up to ``PART_CHARS`` characters."""
    part, size = [], 0
    for u in units:
        size += len(u)
        if part and (len(part) == PART or size > PART_CHARS):
            yield part
            part, size = [], len(u)
        part.append(u)
    if part:
        yield part


class Aligner:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        added = {t["content"] for t in json.loads(a_json)["added_tokens"]}
        self.a_bytes: list[bytes] = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = token.encode() if token in added else bytes(byte[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # ids in the order of the merges: a merge's rank is its token's id, and the same BPE can run by ranks
        model = json.loads(a_json)["model"]
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.by_rank = None
        if merged == list(range(256, 256 + len(merged))):
            import tiktoken

            self.by_rank = tiktoken.Encoding("a", pat_str=_PRE_TOKENS, special_tokens={},
                                             mergeable_ranks={self.a_bytes[i]: i for i in range(256 + len(merged))})
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int32) for x in (self.a_bytes, self.b_bytes))
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.base = max(len(self.a_bytes), len(self.b_bytes))
        self.names = [f"{i}{mark}" for mark in ",|;\n" for i in range(self.base)]
        self.known: dict[str, Unit | None] = {}
        self.before: dict[str, Unit | None] = {}
        self.held = 0  # bytes of ``known``

    def segments(self, text: str) -> Iterator[str]:
        """``text`` in parts; the space between two of them is left out."""
        start = 0
        while self.cuttable and len(text) - start > SEGMENT and (m := _CUT.search(text, start + SEGMENT)):
            yield text[start:m.start()]
            start = m.end()
        yield text[start:] if start else text

    def a_ids(self, text: str) -> list[int]:
        """A's ids; plain text by the quicker of two libraries for its vocabulary."""
        if self.by_rank is not None and _PLAIN.fullmatch(text):
            return self.by_rank.encode_ordinary(text)
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids (int32) of A and of B for units encoded as one text, with a space
        between two; None if A or B does not spell it."""
        text = " ".join(units)
        spelled = (" " + text).encode()
        a_ids, b_ids = self.a_ids(" " + text), self.b.encode(text)
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        if b"".join([a_bytes[i] for i in a_ids]) != spelled or b"".join([b_bytes[i] for i in b_ids]) != spelled:
            return None
        return np.array(a_ids, np.int32), np.array(b_ids, np.int32)

    def grouped(self, a: np.ndarray, b: np.ndarray) -> Aligned:
        at = cuts(np.cumsum(self.a_sizes[a], dtype=np.int32), np.cumsum(self.b_sizes[b], dtype=np.int32))
        return Aligned(a.astype(np.int64), b.astype(np.int64), *at)

    def align(self, text: str | None) -> Iterator[Aligned | None]:
        """Groups of each segment of ``text``; ends with None if it is not spelled."""
        for segment in self.segments(text) if text else ():
            found = [self.encode(part) for part in parts(self.units(segment))]
            if None in found:
                yield None
                return
            yield self.grouped(*map(np.concatenate, zip(*found)))

    def units(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuttable else [text]

    def learn(self, units: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Adds ``units``, encoded as one text, to the known ones (None if not spelled).
        Links of a unit with many are not listed but returned, as ``links`` gives them."""
        found = self.encode(units)
        if found is None:
            if len(units) == 1:
                self.known[units[0]] = None
                return {}
            half = len(units) // 2
            return self.learn(units[:half]) | self.learn(units[half:])
        x = self.grouped(*found)
        ends = np.cumsum(self.a_sizes[x.a])[x.a_cuts[1:] - 1]
        last = np.searchsorted(ends, np.cumsum([len(u.encode()) + 1 for u in units]))  # each unit's last group
        edges = np.concatenate([[0], last + 1])
        linked = np.concatenate([[0], np.cumsum(_sizes(x.a_cuts) * _sizes(x.b_cuts))])[edges]
        many = _sizes(linked) > LISTED
        if many.any() and len(units) > 1:
            few = [u for u, m in zip(units, many) if not m]
            out = self.learn(few) if few else {}
            for u in (u for u, m in zip(units, many) if m):
                out |= self.learn([u])
            return out
        n_a, n_b = _sizes(x.a_cuts[edges]).tolist(), _sizes(x.b_cuts[edges]).tolist()
        if many.any():
            self.known[units[0]] = self.text_of(x), b"", n_a[0], n_b[0]
            return {units[0]: links(x)}
        flat, at = _listed(x, np.arange(len(ends))).tobytes(), (8 * linked).tolist()
        pairs = [flat[s:e] for s, e in zip(at, at[1:])]
        self.known.update(zip(units, zip(self.text_of(x, last).split("\n"), pairs, n_a, n_b)))
        return {}

    def count(self, text: str) -> tuple[str, int, int, np.ndarray, np.ndarray] | None:
        """A segment's groups as text, numbers of A's and B's tokens, distinct linked
        pairs and their counts; None if it is not spelled."""
        if len(self.known) > MAX_UNITS or self.held > STORE_BYTES:
            self.known, self.before, self.held = {}, self.known, 0
        units, many = self.units(text), {}
        new = []  # in the text's order: only its first may begin, its last end with white space
        for u in [u for u in dict.fromkeys(units) if u not in self.known]:
            if u in self.before:
                self.known[u] = self.before[u]
                self.held += self.bytes_of(u)
            else:
                new.append(u)
        for part in parts(new):
            many |= self.learn(part)
        found = [self.known[u] for u in units]
        for u in new:
            if len(u) > UNIT or u in many:
                del self.known[u]
            else:
                self.held += self.bytes_of(u)
        if None in found:
            return None
        texts, pairs, n_a, n_b = zip(*found)
        distinct, counts = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_counts=True)
        if many:
            more = [many[u] for u in units if u in many]
            distinct, counts = _summed([distinct, *(p for p, _ in more)], [counts, *(n for _, n in more)])
        return ";".join(texts), sum(n_a), sum(n_b), distinct, counts

    def bytes_of(self, unit: str) -> int:
        """About what a known unit holds in memory."""
        found = self.known[unit]
        return UNIT_BYTES + (len(found[0]) + len(found[1]) if found else 0)

    def text_of(self, x: Aligned, last: np.ndarray | None = None) -> str:
        """Groups as `a1,a2|b1;a3|b2,b3`; a line ends after each group of ``last``."""
        out = np.zeros(len(x.a) + len(x.b), np.int64)
        a, b = x.a.copy(), x.b.copy()
        a[x.a_cuts[1:] - 1] += self.base  # the mark that follows each id: a comma, or at a group's last
        b[x.b_cuts[1:] - 1] += 2 * self.base
        if last is not None:
            b[x.b_cuts[last + 1] - 1] += self.base
        out[np.arange(len(a)) + np.repeat(x.b_cuts[:-1], _sizes(x.a_cuts))] = a
        out[np.arange(len(b)) + np.repeat(x.a_cuts[1:], _sizes(x.b_cuts))] = b
        names = self.names
        return "".join([names[i] for i in out.tolist()])[:-1]


class Document:
    """Counts, digest and linked pairs of one document."""

    def __init__(self, aligner: Aligner, text: str | None):
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.pairs = self.counts = np.zeros(0, np.int64)
        self.digest = ""
        digest, pairs, counts, held = hashlib.sha256(), [], [], 0
        for number, segment in enumerate(aligner.segments(text) if text else ()):
            x = aligner.count(segment)
            if x is None:
                self.__init__(aligner, None)
                return
            groups, n_a, n_b, found, n = x
            digest.update(((";" if number else "") + groups).encode())
            self.n_a += n_a
            self.n_b += n_b
            self.n_groups += groups.count("|")
            self.n_links += int(n.sum())
            pairs.append(found)
            counts.append(n)
            held += len(found)
            if len(pairs) > 1 and held > 2 * len(pairs[0]) + SEGMENT:
                merged = _summed(pairs, counts)
                pairs, counts, held = [merged[0]], [merged[1]], len(merged[0])
        if self.n_a:
            self.digest = digest.hexdigest()
            self.pairs, self.counts = (pairs[0], counts[0]) if len(pairs) == 1 else _summed(pairs, counts)


_ALIGNERS: dict[bytes, Aligner] = {}


def _aligner(files: tuple[str, bytes]) -> Aligner:
    """One per worker process."""
    key = hashlib.sha256(files[0].encode() + files[1]).digest()
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*files)
    return _ALIGNERS[key]


def _files(a_path: str, b_path: str) -> tuple[str, bytes]:
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id and the groups (arrays of A ids and of B ids) of every document."""
    files = _files(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = list(aligner.align(text))
                out = [] if None in found else [{"a": x.a[s:e], "b": x.b[t:f]} for x in found
                                                for s, e, t, f in zip(x.a_cuts, x.a_cuts[1:], x.b_cuts, x.b_cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([out], kind)], names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


_BLOCK = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "groups_sha256 array<string>, n_pairs array<int>, place binary, times binary, pairs array<long>, holders array<int>")
_RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _blocks(docs: DataFrame, files: tuple[str, bytes], block_bytes: int) -> DataFrame:
    """Documents packed into blocks with their distinct pairs."""

    def packed(number: int, ids: list, done: list[Document]) -> pa.RecordBatch:
        pairs, place, holders = np.unique(np.concatenate([d.pairs for d in done]), return_inverse=True, return_counts=True)
        times = np.concatenate([d.counts for d in done])
        steps = np.diff(place, prepend=0).astype(np.int32)  # small: a document's pairs rise
        columns = [number, ids, *([getattr(d, name) for d in done] for name in ("n_a", "n_b", "n_groups", "n_links", "digest")),
                   [len(d.pairs) for d in done], _packed(steps), _packed(times), pairs, holders]
        kinds = [pa.int64(), *map(pa.list_, [*[pa.int64()] * 5, pa.string(), pa.int32()]), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, first = _aligner(files), TaskContext.get().partitionId() << 32
        number, size, ids, done = 0, 0, [], []
        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = value.as_py()
                ids.append(doc_id)
                done.append(Document(aligner, text))
                size += len(text or "") + 100
                if size >= block_bytes:
                    yield packed(first + number, ids, done)
                    number, size, ids, done = number + 1, 0, [], []
        aligner.before = {}  # later stages need the memory
        if done:
            yield packed(first + number, ids, done)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _BLOCK)


def _settle(left: pa.Table, right: pa.Table) -> pa.Table:
    """One block's documents with the corpus counts of its pairs."""
    row = {name: left.column(name).combine_chunks().flatten() for name in left.column_names if name not in ("block", "place", "times")}
    count, best = (np.zeros(len(right), np.int64) for _ in range(2))
    at = right.column("at").to_numpy()
    count[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy()
    ends = np.concatenate([[0], np.cumsum(row["n_pairs"].to_numpy(), dtype=np.int64)])
    place = np.cumsum(_unpacked(left.column("place")[0].as_py(), ends[-1], np.int32))
    times = _unpacked(left.column("times")[0].as_py(), ends[-1], np.int64)

    def summed(x: np.ndarray) -> pa.Array:
        return pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends]).astype(np.int64))

    row |= {"n_best": summed(times * best[place]), "count_sum": summed(times * count[place])}
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return pa.table([row[n] for n in names], names=names)


def link_statistics(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    with batches_of(docs.sparkSession, BATCH_BYTES):
        blocks = written(_blocks(docs, _files(a_path, b_path), block_bytes), "alignment-blocks", **{"parquet.block.row.count.limit": ROWS})
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("at", "x")) \
        .select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.holders").alias("holders"))
    totals = held.groupBy("pair").agg(F.sum("holders").alias("n"))
    top = F.max("n").over(W.partitionBy(F.shiftright("pair", 32)))  # at most B's vocabulary in a group
    totals = totals.select("pair", "n", (F.col("n") == top).cast("long").alias("best"))
    counted = held.drop("holders").join(totals, "pair").select(F.col("block").alias("of"), "at", "n", "best")
    documents = blocks.drop("pairs", "holders")
    return documents.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(_settle, _RESULT)
