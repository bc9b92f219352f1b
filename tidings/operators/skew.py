"""Joins back to per-key aggregates that stay balanced when one key is hot.

A row joined back to a per-key aggregate of its own table (first id per
text, stored keys per entry) is the pattern where a group of copies or a
busy source puts a large share of the rows on one key.  A plain
``groupBy(key)`` leaves its output hash-partitioned by the key, the join on
that key reuses the partitioning, and AQE's skew-join handling -- which
splits an oversized partition of one side into advisory-size pieces, each
joined with the matching (one-row-per-key) partition of the other side --
only acts on shuffles the join itself asked for.

``group_for_join`` groups by the key plus a zero-valued expression of it:
the result is the same one row per key, but its partitioning no longer
satisfies the join, so the join gets its own shuffle of this small side
and AQE can split the hot partition of the big side.  The price is one
extra shuffle of one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData


def group_for_join(df: DataFrame, keys: list[str]) -> GroupedData:
    """``df.groupBy(*keys)`` whose output is not partitioned by ``keys``
    alone; drop the ``_g`` column after ``agg``."""
    return df.groupBy(*keys, (F.xxhash64(*keys) * F.lit(0)).alias("_g"))
