"""URL filter over a sorted digest array.

Method.  A rule is a host and a path prefix (`example.com/en/`).  The rules'
strings are hashed by 64-bit XXH64 and the digests kept in one sorted array that
every task memory-maps, next to the rules' full strings.  A url yields the few
keys that could be rules (host suffixes and path prefixes of the lengths that
rules have); their digests are probed by vectorised binary search, and every hit
is confirmed against the stored string, so a digest collision decides nothing.
The longest confirmed rule gives the verdict; without one the verdict is
``default`` (absent from the array: allow).

Scale.  Map-only over the urls.  The array is built once on the driver from a
stated list of at most ``MAX_RULES`` rules (checked) and shipped as files by
Spark; tasks map it, so it is shared by the workers of a machine and read by
page.  A url makes at most (distinct label counts x distinct path lengths of the
rules) keys, whatever its length.

Edge cases.  A null url, an empty one and one without `://` have an empty host
and path, which no rule fits.  Ports and user names stay part of the host.  Equal
rules given twice: the last one counts.  Rules of one length: the longer host
wins.  No rules: every url gets the default.  Repeated rows are judged alike;
other columns of the input are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

MAX_RULES = 10_000_000
ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


class Shape(NamedTuple):
    """Which keys a url has to be probed with."""

    labels: tuple[int, ...]
    lengths: tuple[int, ...]


def digests(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k.encode()) for k in keys), np.uint64, len(keys))


def write_array(rules: list[Rule], folder: str) -> Shape:
    """Files of the sorted array in ``folder``: digests, string ends, strings,
    lengths of the hosts, verdicts."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are taken")
    by_key = {r.host + r.path: r for r in rules}
    keys = list(by_key)
    d = digests(keys)
    order = np.lexsort((np.arange(len(keys)), d))
    ordered = [keys[i] for i in order]
    raw = [k.encode() for k in ordered]
    np.save(os.path.join(folder, "digests.npy"), d[order])
    np.save(os.path.join(folder, "ends.npy"), np.cumsum([0, *map(len, raw)], dtype=np.int64))
    np.save(os.path.join(folder, "strings.npy"), np.frombuffer(b"".join(raw) or b"\0", np.uint8))
    np.save(os.path.join(folder, "hosts.npy"), np.array([len(by_key[k].host) for k in ordered], np.int32))
    np.save(os.path.join(folder, "blocks.npy"), np.array([by_key[k].verdict == BLOCK for k in ordered], np.bool_))
    return Shape(tuple(sorted({r.host.count(".") + 1 for r in rules})), tuple(sorted({len(r.path) for r in rules})))


class DigestArray:
    """A memory-mapped array; ``paths`` gives the place of each file."""

    def __init__(self, paths: dict[str, str]):
        load = lambda name: np.load(paths[name], mmap_mode="r")
        self.digests, self.ends, self.strings = load("digests"), load("ends"), load("strings")
        self.hosts, self.blocks = load("hosts"), load("blocks")

    def find(self, keys: list[str]) -> list[int]:
        """Place of each key in the array, -1 where it is no rule."""
        out = np.full(len(keys), -1, np.int64)
        if not keys or not len(self.digests):
            return out.tolist()
        probe = digests(keys)
        at = np.searchsorted(self.digests, probe)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == probe).tolist():
            j, key = int(at[i]), keys[i].encode()
            while j < len(self.digests) and self.digests[j] == probe[i]:
                if self.strings[self.ends[j]:self.ends[j + 1]].tobytes() == key:
                    out[i] = j
                    break
                j += 1  # another string with the same digest
        return out.tolist()


def candidates(host: str, path: str, shape: Shape) -> list[str]:
    out = []
    for n in shape.labels:
        parts = host.rsplit(".", n)
        if len(parts) >= n and host:
            suffix = ".".join(parts[-n:])
            out += [suffix + path[:m] for m in shape.lengths if len(path) >= m]
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


FILES = ("digests", "ends", "strings", "hosts", "blocks")


def ship(spark: SparkSession, rules: list[Rule]) -> tuple[dict[str, str], Shape]:
    """Names under which every executor finds the array's files.  The driver's own
    copy is only what Spark's file server reads from."""
    folder = tempfile.mkdtemp(prefix="url-rules-")
    shape, mark, names = write_array(rules, folder), uuid.uuid4().hex, {}
    for f in FILES:
        names[f] = f"{mark}-{f}.npy"
        os.rename(os.path.join(folder, f"{f}.npy"), os.path.join(folder, names[f]))
        spark.sparkContext.addFile(os.path.join(folder, names[f]))
    return names, shape


def judge(pages: DataFrame, rules: list[Rule], default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule, verdict of each row (page_id, url)."""
    names, shape = ship(pages.sparkSession, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray({f: SparkFiles.get(n) for f, n in names.items()})
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            keys, owner = [], []
            for i, (host, path) in enumerate(zip(hosts, paths)):
                own = candidates(host, path, shape)
                keys += own
                owner += [i] * len(own)
            best: list[tuple[int, int, int, str] | None] = [None] * len(hosts)
            for i, key, at in zip(owner, keys, array.find(keys)):
                if at >= 0 and (best[i] is None or (len(key), int(array.hosts[at])) > best[i][:2]):
                    best[i] = (len(key), int(array.hosts[at]), at, key)
            verdict = [default if b is None else BLOCK if array.blocks[b[2]] else ALLOW for b in best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("host"), batch.column("path"),
                 pa.array([b and b[3] for b in best], pa.string()), pa.array(verdict, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parsed.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
