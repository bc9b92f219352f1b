"""SimHash near-duplicate groups by pivot distance tables.

Fingerprint.  Words are joined into shingles, each shingle is hashed by XXH64
(seed 42), and a bit of the fingerprint is set when it is set in over half of
the hashes.  Two fingerprints link when at most ``max_bits`` bits differ.

Pivot distance tables.  Each distinct fingerprint gets the table of its Hamming
distances to ``PIVOTS`` reference fingerprints.  By the triangle inequality two
fingerprints within ``max_bits`` differ by at most ``max_bits`` in every
coordinate, so a pair whose largest coordinate difference is above that is
discarded; the survivors are verified bit by bit.

Pairs to compare.  Distances to random references concentrate around 32, so
they filter well but cannot be grouped by.  Pairs are therefore proposed by a
second set of references, the 64 single-bit ones: coordinate j of that table
minus the distance to zero is +1 or -1 as bit j is clear or set, so agreement
of these coordinates over a block of references is agreement of the block's
bits.  Of ``max_bits + 2`` blocks at least two agree for every linked pair; the
rows are grouped by each choice of two blocks.  A group above ``MAX_GROUP``
fingerprints is split again by the same rule over the bits its key leaves open
(exact: a linked pair agrees on enough blocks at every level); after at most
three levels a group cannot hold more distinct fingerprints than its few open
bits allow.  So no group is capped and none is compared whole when it is large.
Equal fingerprints are one node: copies are never expanded into pairs.

Components.  Links join the smallest doc_ids of their fingerprints; labels are
spread by alternating large-star and small-star rounds, each written to the
shared folder, until nothing changes.

Edge cases.  A null or empty text has no words: fingerprint zero, linked like
any other.  Fewer words than a shingle: the whole sequence is the one shingle.
Rows with a null doc_id get the component of their fingerprint (null if no row
of the component has an id).  Rows that share a doc_id are one document.  Ids are
below 2**62.  Repeated rows give repeated result rows.  Empty
input: empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.skew import group_for_join
from .common import per_batch, utf8, written

SHINGLE = 3
MAX_BITS = 2
SEED = 42
PIVOTS = 16
MAX_GROUP = 256
BLOCK = 1 << 18  # shingles hashed at a time


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = text.lower().split() if text else []  # bytes: A-Z only, split at \x20 and \x09-\x0D
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1]
    stops = ends[size - 1:] - 1
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at:at + BLOCK].tolist(), stops[at:at + BLOCK].tolist())
        h = np.fromiter((digest(line[a:b], SEED) for a, b in pairs), np.uint64, min(BLOCK, n - at))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [_signed(fingerprint(t, size)) for t in utf8(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(per_batch(run), "doc_id long, fp long")


def pivots(count: int = PIVOTS) -> list[int]:
    return [_signed(xxhash.xxh64_intdigest(f"pivot {i}", SEED)) for i in range(count)]


def distance_table(fp: Column, count: int = PIVOTS) -> Column:
    """Hamming distances to the reference fingerprints."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("byte") for p in pivots(count)])


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:])]


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def choices(bits: list[int], max_bits: int = MAX_BITS) -> list[list[int]]:
    """The bits of each choice of two of ``max_bits + 2`` blocks of ``bits``."""
    return [a + b for a, b in combinations(_blocks(bits, max_bits + 2), 2)]


def masks(levels: int, max_bits: int = MAX_BITS) -> list[list[int]]:
    """Bits that the key of each choice fixes, level by level: choice c of a level
    is split into the choices c * k, c * k + 1, ... of the next."""
    out = [choices(list(range(64)), max_bits)]
    for _ in range(levels - 1):
        out.append([fixed + agree for fixed in out[-1] for agree in choices([b for b in range(64) if b not in set(fixed)], max_bits)])
    return out


def links(nodes: DataFrame, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP, levels: int = 3) -> DataFrame:
    """Pairs (a, b) of the nodes' ids whose fingerprints differ by 1 to
    ``max_bits`` bits.  ``nodes``: fp (distinct), id."""
    fixed = masks(levels, max_bits)
    ways = len(fixed[0])
    found: list[DataFrame] = []
    rows = nodes.select("fp", "id", F.lit(0).alias("choice"))
    for depth in range(levels):
        of_choice = F.array(*[F.lit(_mask(bits)) for bits in fixed[depth]])
        rows = (rows.select("fp", "id", (F.col("choice") * ways).alias("base"), F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("way"))
                .select("fp", "id", (F.col("base") + F.col("way")).alias("choice"))
                .withColumn("key", F.col("fp").bitwiseAND(F.get(of_choice, F.col("choice")))))
        some_hot = False
        if depth < levels - 1:
            hot = written(rows.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_group)
                          .select("choice", "key"), f"simhash-hot-{depth}")
            some_hot = bool(hot.take(1))
        per_top = ways ** depth
        found.append(_pairs(rows.join(hot, ["choice", "key"], "left_anti") if some_hot else rows, fixed[0], per_top, max_bits))
        if not some_hot:
            break
        rows = written(rows.join(hot, ["choice", "key"], "left_semi").select("fp", "id", "choice"), f"simhash-split-{depth}")
    return reduce(DataFrame.unionByName, found).distinct()


def _pairs(rows: DataFrame, top: list[list[int]], per_top: int, max_bits: int) -> DataFrame:
    """Linked pairs within the groups; a pair only under the first top-level
    choice that it agrees on."""
    rows = rows.withColumn("table", distance_table(F.col("fp"))).withColumn("top", F.floor(F.col("choice") / per_top).cast("int"))
    a = rows.select("choice", "key", "top", F.col("fp").alias("fa"), F.col("id").alias("a"), F.col("table").alias("ta"))
    b = rows.select(F.col("choice").alias("c"), F.col("key").alias("k"), F.col("fp").alias("fb"), F.col("id").alias("b"), F.col("table").alias("tb"))
    differ = F.col("fa").bitwiseXOR(F.col("fb"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(_mask(bits))) == 0, F.lit(i)) for i, bits in enumerate(top)])
    near = F.forall(F.zip_with("ta", "tb", lambda x, y: F.abs(x - y)), lambda d: d <= max_bits)
    pairs = a.join(b, (F.col("choice") == F.col("c")) & (F.col("key") == F.col("k")) & (F.col("fa") < F.col("fb"))
                   & (first == F.col("top")) & near & (F.bit_count(differ) <= max_bits))
    return pairs.select("a", "b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): smallest node reachable over ``edges`` (a, b), for every node
    that has an edge."""

    def directed(x: DataFrame) -> DataFrame:
        return x.where("u <> v").distinct()

    now = written(directed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "simhash-edges")
    state = None
    for _ in range(max_rounds):
        # large star: larger neighbours of u go to the smallest neighbour of u (or u itself)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = group_for_join(both, ["u"]).agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = directed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = written(large, "simhash-large")
        # small star: smaller neighbours of u, and u, go to the smallest of them
        least = group_for_join(large, ["u"]).agg(F.min("v").alias("m")).drop("_g")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        now = written(directed(small), "simhash-small")
        # the pairs are distinct, so no two hashes cancel; sums of ids could leave the range of a long
        seen = now.agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64(F.lit(seed), "u", "v")) for seed in (1, 2)]).first()
        if seen == state or not seen["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    return _grouped(written(fingerprints(docs, size), "simhash-fp"), max_bits, max_group)


NO_ID = 1 << 62  # nodes without a doc_id are numbered from here on


def _grouped(prints: DataFrame, max_bits: int, max_group: int) -> DataFrame:
    stand_in = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("fp"), 3)
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
                    .select("fp", F.coalesce("id", stand_in).alias("id")), "simhash-nodes")
    roots = components(links(nodes, max_bits, max_group))
    root = F.coalesce("root", "id")
    named = nodes.join(roots, nodes["id"] == roots["node"], "left").select("fp", F.when(root < NO_ID, root).alias("component_id"))
    return prints.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with one document of each group left, all columns as
    they are: the one with the smallest doc_id, one row of it.  Rows without a
    doc_id stay (nothing names a copy of them)."""
    chosen = near_duplicates(docs, size, max_bits).where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    order = W.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.octet_length("text"))
    kept = (docs.join(chosen, docs["doc_id"] == chosen["_keep"], "left_semi")
            .withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth"))
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
