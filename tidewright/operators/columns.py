"""One pass over a table giving one row per column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def kinds(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def per_column(df: DataFrame, cols: Sequence[str], make: Callable[[str], Mapping[str, Column]]) -> DataFrame:
    """Aggregates of every column in a single job, as rows ``(column, …)``."""
    if not cols:
        raise ValueError("no columns to look at")
    parts = [F.struct(F.lit(c).alias("column"), *[v.alias(k) for k, v in make(c).items()]).alias(f"_{i}")
             for i, c in enumerate(cols)]
    return df.agg(*parts).select(F.inline(F.array(*[f"_{i}" for i in range(len(cols))])))


def few_valued(df: DataFrame, cols: Sequence[str], limit: int) -> list[str]:
    """Columns that may have at most ``limit`` distinct values.

    A sketch in one scan keeps columns with many values out of the exact count that follows; its
    error is far below the factor of two allowed here.  One row of counts reaches the driver.
    """
    if not cols:
        return []
    row = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] <= 2 * limit + 8]


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact ``(column, value, n)`` of the given columns as text; equal values combine before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
