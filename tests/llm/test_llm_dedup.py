"""SimHash near-duplicates, K-d sharding, WARC store."""

import base64
import hashlib
import random
import zlib

import pytest
import xxhash
from llm_cases import frame, prose, rows, word
from pyspark.sql import functions as F

from tidings.llm import kd_sharding, queries, simhash, warc_store

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def naive_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(fps, max_bits=2):
    """fps: id -> fingerprint; id -> smallest id reachable."""
    ids, root = sorted(fps), {}
    for i in ids:
        if i in root:
            continue
        root[i], todo = i, [i]
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in root and (fps[a] ^ fps[b]).bit_count() <= max_bits:
                    root[b] = i
                    todo.append(b)
    return root


def test_fingerprints(monkeypatch):
    texts = [r[1] for r in rows()]
    expect = [naive_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == expect
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == expect


def test_near_duplicates_equal_brute_force(spark):
    got = simhash.near_duplicates(frame(spark)).collect()
    assert len(got) == len(rows())
    fps = {r[0]: naive_fingerprint(r[1]) for r in rows() if r[0] is not None}
    root = naive_components(fps)
    by_fp = {fps[i]: root[i] for i in fps}
    for r in got:
        fp = int(r["fingerprint"], 16)
        assert r["component_id"] == by_fp.get(fp) if r["doc_id"] is None else (fp, r["component_id"]) == (fps[r["doc_id"]], root[r["doc_id"]])
    kept = simhash.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(root.values())) and ids.count(None) == 2
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("max_group", [256, 3])
def test_links_and_components_of_crowded_fingerprints(spark, max_group):
    """Clusters whose members share most bits: with groups split at 3 members, all
    three levels of keys are used."""
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        walk = centre
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 3))))
            walk ^= 1 << rng.randrange(64)
            fps.add(walk)
    fps = dict(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(simhash._signed(f), i) for i, f in fps.items()], "fp long, id long")
    pairs = {frozenset(r) for r in simhash.links(nodes, max_group=max_group).collect()}
    assert pairs == {frozenset((a, b)) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2}
    edges = spark.createDataFrame([tuple(p) for p in pairs], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    root = naive_components(fps)
    assert {i: got.get(i, i) for i in fps} == root


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_components_of_ids_near_two_to_the_61(spark):
    ids = [(1 << 61) + i for i in range(12)]
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == dict.fromkeys(ids[1:], ids[0])


def test_linked_near_copies_without_ids(spark):
    rng = random.Random(9)
    base = prose(rng, 300)
    texts = {simhash.fingerprint(base.encode()): base}
    while len(texts) < 5:
        text = f"{base} {word(rng)}"
        fp = simhash.fingerprint(text.encode())
        if any(0 < (fp ^ other).bit_count() <= 2 for other in texts):
            texts[fp] = text
    docs = [(None, t, None, None, None) for t in texts.values()]
    got = simhash.near_duplicates(frame(spark, docs)).collect()
    assert {int(r["fingerprint"], 16) for r in got} == set(texts) and {r["component_id"] for r in got} == {None}
    assert simhash.keep_one(frame(spark, docs)).count() == 5
    got = simhash.near_duplicates(frame(spark, [(7, base, None, None, None), *docs])).collect()
    assert {r["component_id"] for r in got} == {7}


# ---- K-d sharding ------------------------------------------------------------------

def check_shards(spark, docs, source):
    got = kd_sharding.shard(docs).collect()
    assert len(got) == len(source)
    size = {}
    for r in source:
        size.setdefault(r[0], set()).add((len((r[1] or "").encode()) + 8, None if r[1] is None else zlib.crc32(r[1].encode())))
    slots, where = {}, {}
    for r in got:
        assert (r["size"], r["text_crc32"]) in size[r["doc_id"]] and r["law"] == "bytes" and 0 <= r["shard"] < 24 and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
        if r["text_crc32"] is not None:
            where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    return got


def test_sharding_of_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = check_shards(spark, docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    total = [0] * 24
    for r in got:
        total[r["shard"]] += r["size"]
    assert max(total) - min(total) < 0.35 * sum(total) / 24 and min(total) > 0


def test_sharding_edges(spark):
    check_shards(spark, frame(spark), rows())
    assert kd_sharding.shard(frame(spark, [])).count() == 0
    hot = [(i, "copy" if i % 3 else f"own {i}", None, None, None) for i in range(900)]
    got = check_shards(spark, frame(spark, hot), hot)
    assert len({r["shard"] for r in got}) > 12
    nulls = [(i, None, None, None, None) for i in range(240)]
    got = check_shards(spark, frame(spark, nulls), nulls)
    assert max(r["slot"] for r in got) < 20  # rows without text are no copies of each other


def test_slots_over_many_buckets(spark):
    placed = spark.range(1000).selectExpr("id as doc_id", "id as size", "id as text_crc32", "cast(id % 3 as int) as shard")
    got = kd_sharding.with_slots(placed, rows_per_bucket=50).collect()
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(i % 3 == s for i in range(1000))))


def test_sharding_runs_no_python(spark):
    plan = queries.op7_kd_sharding(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- WARC ---------------------------------------------------------------------------

PAGES = [(1, "http://a/", "same"), (2, "http://b/\r\nx: y", "same"), (7, None, "same"), (3, "u", None), (4, "u", ""), (5, "é", "über <b>\r\n\r\n</b>"),
         (6, "u", "x" * 200_000), (6, "u", "x" * 200_000), (None, "u", "same"), (None, "u", "only null"), (None, "v", "only null"), (9, "u", "9")]


def page_frame(spark, some=PAGES):
    return spark.createDataFrame([(*r, "clash", "clash") for r in some], "page_id long, url string, html string, sha256 string, keeper string")


def test_archive_equals_brute_force(spark):
    got = sorted(map(tuple, warc_store.read(spark, warc_store.write(page_frame(spark))).collect()), key=str)
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max([x for x in (best.get(h or ""), i) if x is not None], default=None)
    expect = []
    for i, _, h in PAGES:
        data, top = (h or "").encode(), best[h or ""]
        response = top is None or i == top
        expect.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else top))
    assert got == sorted(expect, key=str)


def test_records_are_exact_and_payloads_stored_once(spark):
    archive = warc_store.write(page_frame(spark))
    assert spark.table(archive.payloads).count() == len({h or "" for _, _, h in PAGES})
    for r in warc_store.rebuilt(spark, archive).collect():
        record = bytes(r["record"])
        header, _, block = record.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in header.decode().split("\r\n")[1:])
        assert block.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(block) - 4
        http, _, payload = block[:-4].partition(b"\r\n\r\n")
        if fields["WARC-Type"] == "response":
            assert "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() == fields["WARC-Payload-Digest"]
            assert http.endswith(f"Content-Length: {len(payload)}".encode())
        else:
            assert payload == b"" and fields["WARC-Refers-To"].startswith("<urn:x-page:")


def test_small_payloads_and_empty_table(spark):
    got = {r["page_id"]: r["record_type"] for r in warc_store.read(spark, warc_store.write(page_frame(spark), min_bytes=5)).collect()}
    assert got[1] == got[2] == "response"
    assert warc_store.read(spark, warc_store.write(page_frame(spark, []))).count() == 0


def test_a_changed_payload_is_noticed(spark):
    archive = warc_store.write(page_frame(spark))
    broken = spark.table(archive.payloads).withColumn("payload", F.encode(F.lit("other"), "UTF-8"))
    broken.write.mode("overwrite").saveAsTable("warc_broken")
    with pytest.raises(Exception, match="does not match its digest"):
        warc_store.read(spark, archive._replace(payloads="warc_broken")).collect()
    spark.sql("DROP TABLE warc_broken")
