"""Content-addressed WARC archive.

Method.  An archive is two tables in the shared folder.  The payload store holds
each distinct payload once under its SHA-256 (bucketed by it); when a payload is
stored, all rows with its digest are compared by length and a second hash, and a
difference raises.  The header table holds the exact bytes of each record up to
the payload (WARC header, blank line, HTTP header, blank line) and the digest of
its payload.  Records are rebuilt by joining the two; what is read back is taken
from the rebuilt bytes, and their lengths and digests are verified.

Of the records with one payload that with the largest page_id is the response;
the others are revisits that refer to it (``min_bytes``: smaller payloads are
always responses).

Scale.  Payload bytes move once, to be grouped by digest; map-side grouping sends
a payload once per task, so a hot payload costs tasks x bytes.  Rebuilding joins
one response per payload to the bucketed store without moving payloads again.
Everything per record is narrow; the joins by digest have both sides in shuffles
of their own, so AQE splits the rows of a hot payload.

Edge cases.  A null html is an empty payload; a null url an empty target.  Line
breaks in a url are percent-encoded in the header.  Rows with a null page_id
never are the response unless all rows of the payload have none (then all are).
Repeated rows with the largest page_id are all responses.  Empty table: empty
archive.  Other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import shuffle_width, written

DATE = "2026-01-01T00:00:00Z"  # capture time where the rows have none
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
NO_ID = "none"


class Archive(NamedTuple):
    payloads: str  # table name: sha256, payload, keeper
    headers: str  # path: sha256, head


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits (5 hex digits) make 4 digits."""
    hexed = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _records(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
            .withColumn("sha256", F.unhex(F.sha2("payload", 256))))


def _same(c: Column, what: str) -> Column:
    return F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.lit(f"one SHA-256, two payloads: {what}")))


def _head(record_type: Column, refers_to: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    id_of = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit(NO_ID)), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    is_revisit = record_type == "revisit"
    length = F.octet_length(http) + F.when(is_revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", record_type), line("WARC-Record-ID", id_of(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", uri), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", id_of(refers_to)))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"), line("Content-Length", length.cast("string")), F.lit(CRLF), http)


def write(pages: DataFrame, min_bytes: int = 0) -> Archive:
    """Archive of one record per row (page_id, url, html)."""
    spark = pages.sparkSession
    records = _records(pages)
    grouped = records.groupBy("sha256").agg(
        F.first("payload").alias("payload"), F.max("page_id").alias("keeper"),
        _same(F.octet_length("payload"), "length").alias("n_bytes"), _same(F.xxhash64("payload"), "hash").alias("second"))
    name = f"warc_payloads_{uuid.uuid4().hex}"
    (grouped.write.bucketBy(shuffle_width(spark), "sha256").option("compression", "zstd")
     .option("path", scratch_path(spark, name)).saveAsTable(name))
    keepers = spark.table(name).select(F.col("sha256").alias("digest"), "keeper").repartition("digest")
    narrow = records.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("n_bytes"),
                            base32_sha1(F.col("payload")).alias("sha1"))
    joined = narrow.join(keepers, narrow["sha256"] == keepers["digest"])
    single = (F.col("n_bytes") < min_bytes) | F.col("keeper").isNull() | F.coalesce(F.col("page_id") == F.col("keeper"), F.lit(False))
    kind = F.when(single, F.lit("response")).otherwise(F.lit("revisit"))
    headers = scratch_path(spark, "warc-headers")
    joined.select("sha256", _head(kind, F.col("keeper")).alias("head")).write.option("compression", "zstd").parquet(headers)
    return Archive(name, headers)


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def _page(name: str) -> Column:
    return F.expr("try_cast(page AS long)") if name == "page" else F.regexp_extract(_field(name), r"^<urn:x-page:(.*)>$", 1)


def rebuilt(spark: SparkSession, archive: Archive, responses_only: bool = False) -> DataFrame:
    """head, sha256, record (all bytes) of the records; a revisit has no payload."""
    heads = spark.read.schema("sha256 binary, head string").parquet(archive.headers)
    kind = _field("WARC-Type")
    if responses_only:
        heads = heads.where(kind == "response")
    store = spark.table(archive.payloads).select(F.col("sha256").alias("digest"), "payload")
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    return (heads.join(store, heads["sha256"] == store["digest"])
            .select("head", "sha256", F.concat(F.encode("head", "UTF-8"), body, F.lit((CRLF * 2).encode())).alias("record")))


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every
    record, from the archive's bytes."""
    responses = rebuilt(spark, archive, responses_only=True)
    start = F.octet_length("head")
    size = F.regexp_extract("head", r"\r\n\r\nHTTP/[^\r\n]*(?:\r\n[^\r\n]+)*?\r\nContent-Length: (\d+)", 1).cast("int")
    payload = F.substring(F.col("record"), start + 1, size)
    digest = base32_sha1(payload)
    whole = (F.octet_length("record") == start + size + 4) & (digest == F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1))
    verified = responses.select(
        F.col("sha256").alias("digest"), size.cast("long").alias("payload_bytes"),
        F.when(whole & (F.unhex(F.sha2(payload, 256)) == F.col("sha256")), digest)
        .otherwise(F.raise_error(F.lit("a rebuilt record does not match its digest"))).alias("payload_digest"))
    # rows of one payload agree; a table of its own lets the join below split a hot payload
    verified = written(verified.groupBy("digest").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest")),
                       "warc-verified")
    heads = spark.read.schema("sha256 binary, head string").parquet(archive.headers).select(
        "sha256", _field("WARC-Type").alias("record_type"), _page("WARC-Record-ID").alias("page"), _page("WARC-Refers-To").alias("refers"))
    return (heads.join(verified, heads["sha256"] == verified["digest"])
            .select(F.expr("try_cast(page AS long)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    F.expr("try_cast(refers AS long)").alias("refers_to")))
