"""Registration of queries with a declared output shape shared by Spark and SQL.

``cols`` lists ``name:type`` separated by blanks.  Types: s text, d date, t timestamp, i bigint,
b boolean, a array of text (joined by commas), f<digits> double rounded to that many digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _spark_col(name: str, kind: str) -> Column:
    c = F.col(name)
    match kind[0]:
        case "s":
            out = c.cast("string")
        case "d":
            out = c.cast("date")
        case "t":
            out = c.cast("timestamp_ntz")
        case "i":
            out = c.cast("bigint")
        case "b":
            out = c.cast("boolean")
        case "a":
            out = F.concat_ws(",", c)
        case "f":
            out = F.round(c.cast("double"), int(kind[1:])) + F.lit(0.0)
        case _:
            raise ValueError(kind)
    return out.alias(name)


def _sql_col(name: str, kind: str) -> str:
    q = f'"{name}"'
    match kind[0]:
        case "s":
            out = f"CAST({q} AS VARCHAR)"
        case "d":
            out = f"CAST({q} AS DATE)"
        case "t":
            out = f"CAST({q} AS TIMESTAMP)"
        case "i":
            out = f"CAST({q} AS BIGINT)"
        case "b":
            out = f"CAST({q} AS BOOLEAN)"
        case "a":
            out = f"COALESCE(array_to_string({q}, ','), '')"
        case "f":
            out = f"round(CAST({q} AS DOUBLE), {int(kind[1:])}) + 0.0"
        case _:
            raise ValueError(kind)
    return f"{out} AS {q}"


def query(name: str, cols: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    shape = [tuple(c.split(":")) for c in cols.split()]

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_col(n, k) for n, k in shape])

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = f"SELECT {', '.join(_sql_col(n, k) for n, k in shape)} FROM ({sql}) AS shaped"
        return fn

    return wrap
