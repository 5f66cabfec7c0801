"""Sinks.  Every one writes in parallel; nothing is gathered to make a single file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import segment_id
from ..operators.base import Keys
from ..operators.windows import growth


def write_forecast(fc: DataFrame, path: str, keys: Keys, mode: str = "overwrite") -> DataFrame:
    """CSV of date, forecast, bounds and growth from the previous period; returns what was written."""
    rows = growth(fc, keys, "yhat").select(
        *keys, F.col("ds").alias("date"), F.col("yhat").alias("forecast"), F.col("yhat_lower").alias("lower_bound"), F.col("yhat_upper").alias("upper_bound"), "growth_pct")
    rows.write.mode(mode).option("header", True).csv(path)
    return rows


def write_batch_summary(res: DataFrame, path: str, keys: Keys, mode: str = "overwrite") -> DataFrame:
    """Summary CSV with segment columns first under ``path/summary`` and the full rows as JSON under ``path/details``."""
    order = [c for c in ("status", "best_model", "mape", "cv_mape", "run_id", "error") if c in res.columns]
    rows = res.select(*keys, *order, segment_id(keys).alias("segment"))
    rows.write.mode(mode).option("header", True).csv(f"{path}/summary")
    res.write.mode(mode).json(f"{path}/details")
    return rows


def write_scorecard(score: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Comparison rows or scorecard as CSV; list columns become text."""
    lists = [c for c, k in score.dtypes if k.startswith("array")]
    score.withColumns({c: F.concat_ws(";", c) for c in lists}).write.mode(mode).option("header", True).csv(path)


def write_splits(df: DataFrame, path: str, keys: Keys, mode: str = "overwrite") -> DataFrame:
    """Train, eval and holdout rows in folders by split; returns their sizes and date ranges."""
    df.write.mode(mode).partitionBy("split").parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.groupBy(*keys, "split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ds").alias("start"), F.max("ds").alias("end"))


def result_rows(fc: DataFrame, keys: Keys) -> DataFrame:
    """One row per job and model with arrays of dates, values and bounds in step order; a horizon bounds each array."""
    steps = F.array_sort(F.collect_list(F.struct("h", "ds", "yhat", "yhat_lower", "yhat_upper")))
    return fc.groupBy(*keys).agg(steps.alias("s")).select(
        *keys, F.transform("s", lambda x: x["ds"]).alias("forecast_dates"), F.transform("s", lambda x: x["yhat"]).alias("predictions"),
        F.transform("s", lambda x: x["yhat_lower"]).alias("lower_bounds"), F.transform("s", lambda x: x["yhat_upper"]).alias("upper_bounds"))


def append_results(fc: DataFrame, path: str, keys: Keys, mode: str = "append") -> DataFrame:
    """``result_rows`` added to a folder.  Repeating the call repeats the rows: ``publish`` doesn't."""
    rows = result_rows(fc, keys)
    rows.write.mode(mode).parquet(path)
    return rows


def publish(rows: DataFrame, path: str, scope: Sequence[str], attempt: int) -> None:
    """Write the rows of one attempt so that repeating, retrying or being interrupted leaves no row twice and none half.

    ``scope`` names the columns that say what an attempt stands for (a job, or a batch of jobs).  Its rows go to a folder of
    their own, ``rows/attempt=N``, which replaces what the same attempt wrote before; only when they are complete a line a
    scope, ``ledger/attempt=N``, makes them count (``published``).  Attempts are numbered by the caller, rising, one writer at a
    time a number; earlier attempts stay until ``prune``.  An attempt without rows publishes nothing.
    """
    clash = {"attempt"} & set(rows.columns)
    if clash or not scope:
        raise ValueError("rows may not have a column 'attempt', and scope needs a column")
    spark, n = rows.sparkSession, int(attempt)
    _withdraw(spark, f"{path}/ledger/attempt={n}")  # not valid while its rows are replaced
    rows.write.mode("overwrite").parquet(f"{path}/rows/attempt={n}")
    done = spark.read.schema(rows.schema).parquet(f"{path}/rows/attempt={n}")
    done.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite").parquet(f"{path}/ledger/attempt={n}")


def _withdraw(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _attempts(spark: SparkSession, path: str) -> list[int]:
    """Attempts whose ledger is complete: Spark leaves _SUCCESS when all its tasks are committed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger/attempt=*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("attempt=")) for f in found)


def _ledger(spark: SparkSession, path: str, scope: Sequence[str], complete: list[int]) -> DataFrame:
    lines = spark.read.option("basePath", f"{path}/ledger").parquet(*[f"{path}/ledger/attempt={n}" for n in complete])
    return lines.groupBy(*scope).agg(F.max(F.col("attempt").cast("int")).alias("attempt"))


def published(spark: SparkSession, path: str, scope: Sequence[str]) -> DataFrame:
    """The rows that count: of every scope those of its latest complete attempt, which is kept as column ``attempt``.

    Only folders with a complete ledger are read, and a scope is joined null-safely.  Without any attempt there is
    nothing to read, not even columns: that is an error.
    """
    complete = _attempts(spark, path)
    if not complete:
        raise FileNotFoundError(f"nothing published below {path}")
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/attempt={n}" for n in complete]).withColumn("attempt", F.col("attempt").cast("int"))
    last = _ledger(spark, path, scope, complete).select(*[F.col(c).alias(f"_{c}") for c in scope], F.col("attempt").alias("_attempt"))
    same = F.col("attempt") == F.col("_attempt")
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(last, same, "left_semi")


def prune(spark: SparkSession, path: str, scope: Sequence[str]) -> list[int]:
    """Remove the attempts that no scope counts on any more, interrupted ones below the latest included; their numbers."""
    complete = _attempts(spark, path)
    if not complete:
        return []
    used = {r["attempt"] for r in _ledger(spark, path, scope, complete).select("attempt").distinct().collect()}
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/attempt=*")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    there = {int(f.getPath().getName().removeprefix("attempt=")) for f in found}
    gone = sorted(n for n in there | set(complete) if n not in used and n < max(complete))
    for n in gone:
        _withdraw(spark, f"{path}/ledger/attempt={n}")
        _withdraw(spark, f"{path}/rows/attempt={n}")
    return gone
