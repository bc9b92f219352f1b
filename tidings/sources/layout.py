"""Storage layout for co-located joins.

The news fact and its sentiment results are joined on ``news_id`` by most
statistics.  Written as tables bucketed (and sorted) by that key with the
same bucket count, Spark joins them bucket by bucket: no exchange on either
side, and no sort when the buckets are sorted.  The tables live in the
shared folder (``spark.checkpoint.dir`` on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write ``df`` as the external table ``table`` bucketed and sorted by
    ``key`` into ``buckets`` files per write task group, and return it."""
    spark = df.sparkSession
    path = path or scratch_path(spark, table)
    (df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))
    return spark.table(table)
