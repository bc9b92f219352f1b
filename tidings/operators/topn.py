"""Top-n rows per group that stays balanced when one group is huge.

A plain ``row_number() over (partition by g order by ...)`` sorts a whole
group inside one task; if one feed, sector or day holds a third of the
rows, that task would hold a third of the data.  So the ranking runs twice:
first per (group, salt) -- the salt is a hash of a row's unique key, so a
hot group is spread over ``buckets`` tasks -- keeping n rows each, then per
group over at most n x buckets survivors.  Catalyst also puts a partial
``WindowGroupLimit`` before the exchange where n is small.  Exact for any n:
the top n of a group are among the top n of any part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def top_n_per_group(df: DataFrame, group_cols: list[str], order: list[Column], n: int,
                    salt_key: Column, buckets: int = 16, rank_col: str = "_rank") -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(*order)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_key), F.lit(buckets)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n).drop("_r1", "_salt")
    return stage1.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)
