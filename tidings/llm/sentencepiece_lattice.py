"""SentencePiece encoding and decoding over a relational lattice.

Method.  A text is escaped as the model does (one leading space, spaces as
U+2581) and cut into units that no piece crosses: a run of U+2581 with what
follows, line feeds apart.  Corpus counts of the units give the vocabulary of
frequent units.  For these the lattice is relational: every substring of at most
the longest piece's length is exploded, equi-joined to the piece table, the
edges are grouped by unit, and a Spark higher-order ``aggregate`` folds them.

The fold.  The public models are BPE models: the library joins the best-scored
adjacent pair first, and summed scores (plain Viterbi) give other pieces.  So the
fold keeps the set of cuts still open (one bit per position) and in each step
takes, of the edges that span exactly two current pieces, the one with the best
score, leftmost first, until none is left: the library's result, exactly.
Characters without a piece become byte pieces.

Applying it.  The frequent units' ids (at most ``max_units`` units, a documented
bound) are broadcast; documents are encoded map-side.  A unit outside that
vocabulary is encoded in its task by the same fold written as a loop over the
same piece table (``fold_unit``).  Joining every occurrence of such units back
to its document instead would shuffle all token ids (about twice the input).

Edge cases.  Null and empty texts give no ids (null stays null in ``decode``).
A text made of spaces, an unbroken text of any length, unknown characters and
control characters all encode.  A literal U+2581 reads as a space, as in the
library, and decodes to a space.  Repeated rows give repeated results; an empty
table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SPACE = "▁"
MAX_UNITS = 200_000
LONGEST = 60  # characters of a unit that the fold's bit set holds
FLUSH = 400_000  # distinct units that a task counts before it sends them on
CACHE = 200_000  # rare units that a task remembers

_UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


@dataclass(frozen=True)
class Pieces:
    """Piece table of a model: text -> (id, rank; lower merges first)."""

    ids: dict[str, int]
    ranks: dict[str, float]
    first_byte: int
    texts: tuple[bytes, ...]

    @property
    def longest(self) -> int:
        return max(map(len, self.ranks))


def load(path: str) -> Pieces:
    """Piece table of a BPE model file with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    bytes_ = [i for i in range(len(sp)) if sp.is_byte(i)]
    text = {i: sp.id_to_piece(i) for i in normal}
    if len(bytes_) != 256 or any(p.strip(SPACE) and SPACE in p[1:] or len(p) > 1 and "\n" in p for p in text.values()):
        raise ValueError("a model with byte fallback whose pieces stay within units is needed")
    out = [b""] * len(sp)
    for i, p in text.items():
        out[i] = p.replace(SPACE, " ").encode()
    for b, i in enumerate(bytes_):
        out[i] = bytes([b])
    return Pieces({p: i for i, p in text.items()}, {p: -sp.get_score(i) for i, p in text.items()}, bytes_[0], tuple(out))


def units(text: str | None) -> list[str]:
    return _UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


def _merged(unit: str, ranks: dict[str, float]) -> list[str]:
    """Pieces of a unit of few characters."""
    parts, get = list(unit), ranks.get
    pairs = [get(a + b, math.inf) for a, b in zip(parts, parts[1:])]
    while pairs and (best := min(pairs)) < math.inf:
        i = pairs.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], math.inf)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], math.inf)
    return parts


def _merged_long(unit: str, ranks: dict[str, float]) -> list[str]:
    """The same for a unit of any length, with a queue of the pairs."""
    parts: list[str | None] = list(unit)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    queue: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (r := ranks.get(joined := parts[i] + parts[j])) is not None:
            heapq.heappush(queue, (r, i, joined))

    for i in range(len(parts) - 1):
        offer(i)
    while queue:
        _, i, joined = heapq.heappop(queue)
        if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j], after[i] = joined, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p is not None]


def fold_unit(unit: str, pieces: Pieces) -> list[int]:
    """Ids of one unit: best-scored adjacent pair first, leftmost first."""
    out: list[int] = []
    for p in (_merged if len(unit) <= LONGEST else _merged_long)(unit, pieces.ranks):
        known = pieces.ids.get(p)
        out += [known] if known is not None else [pieces.first_byte + b for b in p.encode()]
    return out


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    return spark.createDataFrame([(p, i, float(pieces.ranks[p])) for p, i in pieces.ids.items()], "piece string, piece_id int, rank double")


def count_units(docs: DataFrame) -> DataFrame:
    """unit, n over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(units(text))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent_units(docs: DataFrame, max_units: int = MAX_UNITS) -> DataFrame:
    """The most frequent units: all whose count reaches the lowest power of
    ``2**(1/8)`` that at most ``max_units`` units reach."""
    step = (F.floor(F.log2("n") * 8)).cast("int")
    counted = written(count_units(docs).where(F.char_length("unit") <= LONGEST).withColumn("step", step), "piece-units")
    sizes = {r["step"]: r["count"] for r in counted.groupBy("step").count().collect()}
    total, least = 0, math.inf
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > max_units:
            break
        least = s
    return counted.where(F.col("step") >= F.lit(float(least))).select("unit")


def encode_units(unit_rows: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, ids of distinct units of at most ``LONGEST`` characters."""
    spark = unit_rows.sparkSession
    n = F.char_length("unit")
    ends = F.least(F.lit(pieces.longest), n - F.col("start"))
    spans = (unit_rows.select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
             .select("unit", "start", F.explode(F.sequence(F.lit(1), ends)).alias("width")))
    text = F.substring(F.col("unit"), F.col("start") + 1, F.col("width"))
    # the piece table has as many rows as the model has pieces, whatever the corpus
    edges = (spans.withColumn("piece", text).join(F.broadcast(piece_table(spark, pieces)), "piece", "left")
             .where(F.col("piece_id").isNotNull() | (F.col("width") == 1)))
    hexed = F.hex(F.encode("piece", "UTF-8"))
    as_bytes = F.transform(F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2)),
                           lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("int") + F.lit(pieces.first_byte))
    edges = edges.select(
        "unit", F.when(F.col("width") == 1, F.lit(math.inf)).otherwise(F.col("rank")).alias("rank"), "start",
        F.expr("shiftleft(1L, start) + shiftleft(1L, start + width)").alias("ends"),
        F.expr("shiftleft(1L, start + width) - shiftleft(1L, start + 1)").alias("inner"),
        F.when(F.col("piece_id").isNull(), as_bytes).otherwise(F.array("piece_id")).alias("ids"))
    grouped = edges.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "ends", "inner", "ids"))).alias("edges"))
    merges = F.filter("edges", lambda e: e["inner"] != 0)

    def step(cuts, _):
        best = F.get(F.filter("merges", lambda e: (cuts.bitwiseAND(e["ends"]) == e["ends"])
                              & (F.bit_count(cuts.bitwiseAND(e["inner"])) == 1)), F.lit(0))
        return cuts.bitwiseAND(F.bitwise_not(F.coalesce(best["inner"], F.lit(0).cast("long"))))

    cuts = F.aggregate(F.sequence(F.lit(1), n), F.expr("shiftleft(1L, char_length(unit) + 1) - 1L"), step)
    chosen = F.filter("edges", lambda e: (F.col("cuts").bitwiseAND(e["ends"]) == e["ends"]) & (F.col("cuts").bitwiseAND(e["inner"]) == 0))
    in_order = F.array_sort(F.transform(chosen, lambda e: F.struct(e["start"].alias("start"), e["ids"].alias("ids"))))
    return (grouped.withColumn("merges", merges).withColumn("cuts", cuts)
            .select("unit", F.flatten(F.transform(in_order, lambda t: t["ids"])).alias("ids")))


class Encoder(dict):
    """unit -> ids as int32 bytes; units it does not hold are folded on demand."""

    def __init__(self, known: dict[str, bytes], pieces: Pieces):
        super().__init__(known)
        self.pieces, self.room = pieces, len(known) + CACHE

    def __missing__(self, unit: str) -> bytes:
        ids = np.array(fold_unit(unit, self.pieces), np.int32).tobytes()
        if len(self) < self.room:
            self[unit] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, units(text)))


def decode_ids(ids, texts: tuple[bytes, ...]) -> str:
    """Text of ids; bytes that are no UTF-8 become U+FFFD."""
    joined = b"".join(map(texts.__getitem__, ids))
    return joined.removeprefix(b" ").decode(errors="replace")


def vocabulary(docs: DataFrame, pieces: Pieces, max_units: int = MAX_UNITS) -> dict[str, bytes]:
    """Ids of the frequent units of ``docs`` (at most ``max_units``)."""
    rows = encode_units(frequent_units(docs, max_units), pieces).toArrow()
    return {u: np.array(i, np.int32).tobytes() for u, i in zip(rows.column("unit").to_pylist(), rows.column("ids").to_pylist())}


ENCODED = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"


def encode(docs: DataFrame, path: str, max_units: int = MAX_UNITS) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (the ids decode to the text) of every document."""
    pieces = load(path)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary(docs, pieces, max_units), pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = sent.value
        encoder = Encoder(known, table)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found, same = [], []
                for text in batch.column("text").to_pylist():
                    found.append(encoder.encode(text))
                    back = decode_ids(memoryview(found[-1]).cast("i"), table.texts)
                    same.append(None if text is None else back == text.replace(SPACE, " "))
                sizes = np.array([len(f) // 4 for f in found], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes), ids, pa.array(same, pa.bool_())],
                                                 names=["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows doc_id, ids (null ids: null text)."""
    sent = rows.sparkSession.sparkContext.broadcast(load(path).texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sent.value
        for batch in batches:
            out = [None if i is None else decode_ids(i, texts) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
