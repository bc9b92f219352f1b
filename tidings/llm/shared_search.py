"""Ranked lexical search of many items at once, common subexpressions evaluated once.

Scores.  A document's score for an item is the sum over the item's distinct terms
of an integer inverse-frequency weight times an integer saturation of the term's
count by the document's length (see ``weight`` and ``impacts``).

Common subexpressions.  Terms with the same set of items form one atom; an atom
of a single item is the item's private part.  Each item is written as the
sequence of its shared atoms, commonest first, and neighbours that stand in two
or more items are replaced by a new node, commonest pair first, round by round
until no pair is left.  The nodes form a DAG: a node's accumulator (one integer
per document of a block) is made once from its two parts and used by every node
and item above it.

Jobs.  The items are dealt in blocks of about ``BLOCK_BYTES`` of terms.  For each
block one scan counts the block's terms in every document (written to the shared
folder with the document's length), one aggregate gives the corpus statistics,
and one scan of that table evaluates the DAG over blocks of documents.  A task
keeps the best ``k`` documents of each item, so what is shuffled is tasks x items
x k rows, never pairs of documents and items; the last ranking is salted.

Scale.  A block of items is bounded and broadcast with the task; an item itself
is never split, so the distinct terms of one item must fit a task.  More items
mean more scans, not more memory.  Memory of a task: ``CELLS`` accumulators and
the texts of one Arrow batch.

Edge cases.  Null and empty texts have no terms, no score and do not count as
documents.  Items that are null, empty or match nothing have no rows.  Very long
texts are counted whole.  Each row of the items is an item of its own, also where
ids repeat or are null.  Equal scores are ordered by doc_id, nulls last.  Repeated
documents are ranked one by one.  Empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.topn import top_n_per_group
from .common import utf8, written
from .decontamination import words

TOP = 10
BLOCK_BYTES = 1 << 20
CELLS = 1 << 22  # accumulators a task holds at a time


class Sharing(NamedTuple):
    """Plan of a block of items.  Accumulators 0..items-1 are the private parts,
    then come the shared atoms, then one per pair of ``pairs``."""

    vocabulary: dict[bytes, int]  # term -> number
    target: np.ndarray  # accumulator of each term
    pairs: list[tuple[int, int]]  # parts of the further accumulators
    parts: list[list[int]]  # accumulators that an item sums
    size: int


def mine(items: list[list[bytes]]) -> Sharing:
    """Shared term sets of ``items`` (distinct terms each) as a DAG."""
    holders: dict[bytes, list[int]] = {}
    for number, terms in enumerate(items):
        for term in terms:
            holders.setdefault(term, []).append(number)
    vocabulary = {term: i for i, term in enumerate(sorted(holders))}
    atoms: dict[tuple[int, ...], int] = {}
    for key in sorted({tuple(h) for h in holders.values() if len(h) > 1}, key=lambda h: (-len(h), h)):
        atoms[key] = len(items) + len(atoms)
    target = np.array([atoms[tuple(holders[t])] if len(holders[t]) > 1 else holders[t][0] for t in vocabulary], np.int64)
    parts: list[list[int]] = [[] for _ in items]
    for key, atom in atoms.items():  # commonest first
        for number in key:
            parts[number].append(atom)
    base, pairs = len(items) + len(atoms), []
    while True:
        seen = Counter(pair for p in parts for pair in zip(p, p[1:]))
        shared = {pair: n for pair, n in seen.items() if n > 1}
        if not shared:
            break
        # a pair gives way to a commoner one that starts at its second part
        made: dict[tuple[int, int], int] = {}
        for number, p in enumerate(parts):
            out, i = [], 0
            while i < len(p):
                pair = tuple(p[i:i + 2])
                following = tuple(p[i + 1:i + 3])
                if shared.get(pair, 0) > 0 and (shared[pair], pair) >= (shared.get(following, 0), following):
                    if pair not in made:
                        made[pair] = base + len(pairs)
                        pairs.append(pair)
                    out.append(made[pair])
                    i += 2
                else:
                    out.append(p[i])
                    i += 1
            parts[number] = out
    return Sharing(vocabulary, target, pairs, [[i, *p] for i, p in enumerate(parts)], base + len(pairs))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Saturated counts of terms in documents of ``length`` terms."""
    m = 100 - 90 + (90 * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, length and the counted terms of the vocabulary, for documents with any term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text")):
                found = words(text)
                if found:
                    known = [(vocabulary[w], n) for w, n in Counter(found).items() if w in vocabulary]
                    ids.append(doc_id)
                    lengths.append(len(found))
                    terms.append([t for t, _ in known])
                    counts.append([n for _, n in known])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "length", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text") \
        .mapInArrow(run, "doc_id long, length long, terms array<int>, counts array<int>")


class Best:
    """The best ``k`` documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = np.zeros((4, 0), np.int64)  # item, score, doc_id, doc_id is null

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """``scores`` by item and document."""
        if scores.shape[1] > self.k:
            own = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
            item, doc = np.nonzero(scores >= np.maximum(self.least, own)[:, None])
        else:
            item, doc = np.nonzero(scores >= self.least[:, None])
        rows = np.concatenate([self.rows, np.stack([item, scores[item, doc], ids[doc], nulls[doc]])], axis=1)
        rows = rows[:, np.lexsort((rows[2], rows[3], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], rows[0], "left")
        place = np.arange(rows.shape[1]) - first
        self.rows = rows[:, place < self.k]
        full = place == self.k - 1
        self.least[rows[0, full]] = rows[1, full]


def evaluate(plan: Sharing, table: DataFrame, rows: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Each task's best documents of each item: row (the item's of ``rows``), doc_id, score."""
    step = max(64, CELLS // plan.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(plan.parts), k)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                terms, counts = part.column("terms"), part.column("counts")
                sizes = np.diff(terms.offsets.to_numpy())
                doc = np.repeat(np.arange(part.num_rows), sizes)
                term = terms.flatten().to_numpy().astype(np.int64)
                length = part.column("length").to_numpy()
                value = weights[term] * impacts(counts.flatten().to_numpy().astype(np.int64), length[doc], n_docs, n_terms)
                sums = np.zeros((plan.size, part.num_rows), np.int64)
                np.add.at(sums, (plan.target[term], doc), value)
                for node, (a, b) in enumerate(plan.pairs, plan.size - len(plan.pairs)):
                    np.add(sums[a], sums[b], out=sums[node])
                scores = np.stack([reduce(np.add, [sums[p] for p in parts]) for parts in plan.parts])
                ids = part.column("doc_id")
                best.add(scores, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64))
        item, score, ids, nulls = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(rows[item]), pa.array(ids, mask=nulls.astype(bool)), pa.array(score)], names=["row", "doc_id", "score"])

    return table.mapInArrow(run, "row long, doc_id long, score long")


def _item_terms(items: DataFrame) -> DataFrame:
    """Each row of ``items`` with a number of its own and its distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(words(t))) for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))],
                                             names=["row", "item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select(F.monotonically_increasing_id().alias("row"), "item_id", "text") \
        .mapInArrow(run, f"row long, item_id {kind}, terms array<binary>").where(F.size("terms") > 0)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 8)
    table = written(_item_terms(items), "search-items")
    total = table.agg(F.sum(size).alias("n")).first()["n"] or 0
    blocks = -(-total // block_bytes)
    found = [spark.createDataFrame([], "row long, doc_id long, score long")]
    for number in range(blocks):
        mine_of = table.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).select("row", "terms").orderBy("row").collect()
        if mine_of:
            found.append(_search_block(docs, [r["row"] for r in mine_of], [list(map(bytes, r["terms"])) for r in mine_of], k))
    rows = reduce(DataFrame.unionAll, found)
    ranked = top_n_per_group(rows, ["row"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k, F.col("doc_id"), rank_col="rank")
    return ranked.join(table.select("row", "item_id"), "row").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_block(docs: DataFrame, rows: list[int], items: list[list[bytes]], k: int) -> DataFrame:
    spark = docs.sparkSession
    plan = mine(items)
    table = written(postings(docs, plan.vocabulary), "search-postings")
    stats = table.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("terms")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "row long, doc_id long, score long")
    weights = np.zeros(len(plan.vocabulary), np.int64)
    # one row per term of the block
    for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[r["term"]] = weight(stats["n"], r["count"])
    return evaluate(plan, table, np.array(rows), weights, stats["n"], stats["terms"], k)
