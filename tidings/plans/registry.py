"""Registry of named queries: key -> (Spark builder, DuckDB oracle SQL).

A builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables.  The oracle SQL is an independent formulation run by
DuckDB over the same Parquet files (fixture views are inlined as CTEs).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import with_views


@dataclass(frozen=True)
class Entry:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(key, fn, with_views(sql, *views) if sql else None)
        return fn

    return deco


def sql_round_div(num: str, den: str, digits: int = 2) -> str:
    """SQL twin of ``functions.core.round_div`` (exact, half away from zero)."""
    scale = 10**digits
    unit = f"{1 / scale:.{digits}f}"
    return (
        f"CASE WHEN ({den}) <> 0 THEN CAST(CAST(sign({num}) * ((abs({num}) * {2 * scale} + ({den})) // (2 * ({den}))) "
        f"AS DECIMAL(38,0)) * CAST('{unit}' AS DECIMAL({digits + 1},{digits})) AS DOUBLE) END"
    )


def sql_mean(x: str) -> str:
    return f"CAST(sum({x}) AS DOUBLE) / nullif(count({x}), 0)"


def sql_round_mean(x: str, digits: int = 2) -> str:
    return sql_round_div(f"CAST(sum({x}) * 10000 AS BIGINT)", f"count({x}) * 10000", digits)
