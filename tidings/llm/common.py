"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_session, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, read by Spark (any store Spark can read)."""
    return ensure_session(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def written(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """``df`` written to a new table in the shared folder and read back: lineage
    is cut, the rows are computed once and survive lost executors.  ``options``
    are those of the Parquet writer."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Batches of actions inside go to the Python workers at about ``size`` bytes."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(size))
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column (None for null)."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that maps each batch by ``fn``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return run


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
