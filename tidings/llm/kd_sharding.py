"""Sharding by a K-d tree over document metadata (DataFrame functions only).

Method.  Each document has numeric metadata: its size in bytes, its share of
multi-byte characters and its number of lines.  A node of the tree is split along
the dimension in which its documents spread most, at the weighted median (weight:
bytes; for an uneven number of leaves at the matching quantile), until every
leaf holds its share of the bytes.  Leaves are numbered in order: the shards.

The median.  A dimension's value and a hash of the text form one sortable long,
so rows of equal metadata still have an order and documents with equal texts
always fall on one side: a group of copies is never split.  Each round counts
bytes in at most ``BINS`` equal-width bins of the node's range and goes on inside
the bin that holds the median, until that bin is one key or below a thousandth of
a leaf; all nodes of a level share the rounds.

Scale.  The text is read once into a narrow table; the rounds read that table and
bring (nodes x ``BINS``) sums to the driver at most.  A row's shard is an
expression over its own metadata (no join).  Slots come from per-bucket counts,
so no shard is numbered in one task.

Edge cases.  A null text has no bytes, size 8, no checksum, and is a group of its
own.  Ties and repeated rows stay together; a group larger than a leaf makes that
leaf larger.  Fewer groups than shards leave shards empty; an empty table gives
an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import written

SHARDS = 24
OVERHEAD = 8  # bytes that each document counts besides its text
BINS = 2048
EXACT = 1000  # a bin below this part of a leaf's bytes is not opened
ROWS_PER_BUCKET = 20_000
TOP = (1 << 31) - 1
DIMENSIONS = ("bytes", "multibyte", "lines")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and one sortable key per dimension."""
    text = F.col("text")
    octets = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0))
    multibyte = F.when(octets > 0, F.floor((octets - F.char_length(text)) * 1_000_000 / octets)).otherwise(0)
    tie = F.shiftrightunsigned(F.coalesce(F.when(text.isNotNull(), F.xxhash64(text)), F.xxhash64("doc_id", F.lit("no text"))), 32)
    key = lambda value: F.shiftleft(F.least(value, F.lit(TOP)).cast("long"), 32).bitwiseOR(tie)
    return docs.select("doc_id", (octets + OVERHEAD).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                       key(octets).alias("bytes"), key(multibyte).alias("multibyte"), key(lines).alias("lines"))


@dataclass
class Node:
    first: int  # shards first .. first + leaves - 1
    leaves: int
    dimension: str | None = None
    cut: int | None = None  # keys below go left
    children: list[Node] = field(default_factory=list)

    def place(self, leaf_number) -> Column:
        """Expression that walks the tree; ``leaf_number`` of the node reached."""
        if not self.children:
            return F.lit(leaf_number(self))
        left, right = self.children
        return F.when(F.col(self.dimension) < F.lit(self.cut), left.place(leaf_number)).otherwise(right.place(leaf_number))

    def split(self, dimension: str, cut: int) -> None:
        half = self.leaves // 2
        self.dimension, self.cut = dimension, cut
        self.children = [Node(self.first, half), Node(self.first + half, self.leaves - half)]


def spread(dimension: str, low: int, high: int) -> float:
    """Width of a range of keys on a common scale (0..1)."""
    a, b = low >> 32, high >> 32
    return (b - a) / 1_000_000 if dimension == "multibyte" else (math.log2(b + 1) - math.log2(a + 1)) / 31


def _pick(values: dict[int, object], default) -> Column:
    """The value of the row's node."""
    out = F.lit(default)
    for number, v in values.items():
        out = F.when(F.col("node") == number, v).otherwise(out)
    return out


def _medians(rows: DataFrame, nodes: dict[int, Node], exact: int) -> None:
    """Splits every node at the weighted quantile of its widest dimension."""
    stats = {r["node"]: r for r in rows.groupBy("node").agg(
        F.sum("size").alias("size"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]).collect()}
    open_: dict[int, dict] = {}
    for number, node in nodes.items():
        s = stats.get(number)
        if s is None:
            node.split(DIMENSIONS[0], 0)  # no rows: nothing goes either way
            continue
        widest = max(DIMENSIONS, key=lambda d: (spread(d, s[f"low_{d}"], s[f"high_{d}"]), s[f"high_{d}"] - s[f"low_{d}"]))
        open_[number] = {"dim": widest, "low": s[f"low_{widest}"], "high": s[f"high_{widest}"], "below": 0,
                         "target": s["size"] * (node.leaves // 2) / node.leaves, "leaf": s["size"] / node.leaves}
    while open_:
        key = _pick({n: F.col(o["dim"]) for n, o in open_.items()}, None)
        width = {n: max(1, -(-(o["high"] - o["low"] + 1) // BINS)) for n, o in open_.items()}
        inside = (rows.where(F.col("node").isin(list(open_))).select("node", "size", key.alias("key"))
                  .where((F.col("key") >= _pick({n: F.lit(o["low"]) for n, o in open_.items()}, 0))
                         & (F.col("key") <= _pick({n: F.lit(o["high"]) for n, o in open_.items()}, -1))))
        offset = F.col("key") - _pick({n: F.lit(o["low"]) for n, o in open_.items()}, 0)
        step = _pick({n: F.lit(w).cast("long") for n, w in width.items()}, 1)
        bins: dict[int, list] = {}
        for r in (inside.withColumn("step", step).withColumn("offset", offset)
                  .groupBy("node", F.expr("offset div step").alias("bin"))
                  .agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect()):
            bins.setdefault(r["node"], []).append(r)
        for number, o in list(open_.items()):
            for r in sorted(bins[number], key=lambda r: r["bin"]):
                if o["below"] + r["size"] >= o["target"]:
                    break
                o["below"] += r["size"]
            if r["low"] < r["high"] and r["size"] * exact > o["leaf"]:
                o["low"], o["high"] = r["low"], r["high"]
                continue
            after = o["below"] + r["size"] - o["target"] < o["target"] - o["below"]
            nodes[number].split(o["dim"], r["high"] + 1 if after else r["low"])
            del open_[number]


def build(rows: DataFrame, shards: int = SHARDS, exact: int = EXACT) -> Node:
    """The tree over rows of ``metadata``."""
    root = Node(0, shards)
    while True:
        leaves, stack = [], [root]
        while stack:
            n = stack.pop()
            stack += n.children
            if not n.children and n.leaves > 1:
                leaves.append(n)
        if not leaves:
            return root
        number = {id(n): i for i, n in enumerate(leaves)}
        node = root.place(lambda n: number.get(id(n), -1))
        _medians(rows.withColumn("node", node).where("node >= 0"), dict(enumerate(leaves)), exact)


def with_slots(rows: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``rows`` with slot: 0, 1, 2, ... within each shard."""
    count = rows.count()
    buckets = max(1, -(-count // rows_per_bucket))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    return (dealt.withColumn("nth", F.row_number().over(order))
            .join(starts, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
            .withColumn("slot", (F.col("start") + F.col("nth") - 1).cast("long")).drop("s", "b", "start", "nth", "bucket"))


def shard(docs: DataFrame, shards: int = SHARDS, exact: int = EXACT) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    rows = written(metadata(docs), "kd-metadata")
    tree = build(rows, shards, exact)
    placed = rows.select("doc_id", "size", "text_crc32", tree.place(lambda n: n.first).cast("int").alias("shard"))
    return with_slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                     F.lit(None).cast("int").alias("grown_shard"))
