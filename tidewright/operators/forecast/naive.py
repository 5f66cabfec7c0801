"""Forecasts that need no fitting: plain windows, aggregates and exploded steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.stats import z_critical
from ..base import Keys, by, join_on_keys, ordered
from ..joins import future_spine
from ..signals import numbered


def _prepared(df: DataFrame, keys: Keys) -> DataFrame:
    """Numbered rows with the first value of their series and the spread of its changes."""
    w = by(keys)
    rows = numbered(df, keys)
    n = F.col("n")
    rows = rows.withColumn("_d", F.col("y") - F.lag("y").over(ordered(keys, "t")))
    last = F.max(F.when(F.col("t") == n - 1, F.col("y"))).over(w)
    first = F.max(F.when(F.col("t") == 0, F.col("y"))).over(w)
    rows = rows.select("*", F.when(n > 1, F.stddev_pop("_d").over(w)).otherwise(F.abs(last) * 0.1).alias("_sd"), first.alias("_first"))
    return rows


def _last_season(rows: DataFrame) -> DataFrame:
    """The rows of the last season with its length ``_s`` and their place ``_i`` in it, from 0."""
    n = F.col("n")
    rows = rows.withColumn("_s", F.when(n >= 52, 52).when(n >= 12, 12).otherwise(n).cast("int"))
    return rows.withColumn("_i", (F.col("t") - n + F.col("_s")).cast("int")).where(F.col("_i") >= 0)


def seasonal_naive(df: DataFrame, keys: Keys, h: int, level: float = 0.95, drift: bool = False) -> DataFrame:
    """The values of the last season repeated; season 52, 12 or all rows by length.

    Each row of the last season knows the steps it serves, so it is exploded to them: no join.
    Bounds widen with the square root of the step.  ``drift`` extends the last value by the mean change instead.
    """
    rows, n = _prepared(df, keys), F.col("n")
    if drift:
        rows = rows.where(F.col("t") == n - 1).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))
        step = (F.col("y") - F.col("_first")) / F.greatest(n - 1, F.lit(1))
        value = F.col("y") + step * F.col("h")
    else:
        rows = _last_season(rows).where(F.col("_i") < h)
        rows = rows.withColumn("h", F.explode(F.sequence(F.col("_i") + 1, F.lit(h), F.col("_s"))))
        value = F.col("y")
    margin = z_critical(level) * F.col("_sd") * F.sqrt(F.col("h"))
    return rows.select(*keys, "h", value.alias("yhat"), (value - margin).alias("yhat_lower"), (value + margin).alias("yhat_upper"))


def mean_drift(df: DataFrame, keys: Keys, h: int) -> DataFrame:
    """Mean of the last twelve values plus the mean step, ±1.96 standard deviations."""
    rows = numbered(df, keys)
    n, t, y = F.col("n"), F.col("t"), F.col("y")
    recent = F.when(t >= n - 12, y)
    agg = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), F.avg(recent).alias("m"), F.stddev_pop(recent).alias("sd"),
        F.max(F.when(t == 0, y)).alias("first"), F.max(F.when(t == n - 1, y)).alias("last"))
    sd = F.when(F.col("n") > 1, F.col("sd")).otherwise(F.col("m") * 0.1)
    trend = F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / F.col("n")).otherwise(0.0)
    agg = agg.select(*keys, "m", trend.alias("trend"), sd.alias("sd"), F.explode(F.sequence(F.lit(1), F.lit(h))).alias("h"))
    value = F.col("m") + F.col("trend") * F.col("h")
    return agg.select(*keys, "h", value.alias("yhat"), (value - 1.96 * F.col("sd")).alias("yhat_lower"), (value + 1.96 * F.col("sd")).alias("yhat_upper"))


def with_dates(fc: DataFrame, df: DataFrame, keys: Keys, h: int, freq: str) -> DataFrame:
    """Add the dates of the steps."""
    return fc.join(future_spine(df, keys, h, freq), [*keys, "h"])


def naive_forecaster(hist: DataFrame, future: DataFrame, keys: Keys, level: float = 0.95) -> DataFrame:
    """Seasonal naive in the shape cross-validation takes: each future row takes the value of its place in the last
    season of its series, so the horizon is that of the future rows, however long."""
    season = _last_season(_prepared(hist, keys)).select(*keys, "_i", "_s", "y", "_sd")
    size = season.groupBy(*keys).agg(F.max("_s").alias("_s"))
    rows = join_on_keys(future.select(*keys, "h", "ds"), size, keys).withColumn("_i", ((F.col("h") - 1) % F.col("_s")).cast("int")).drop("_s")
    rows = rows.join(season.drop("_s"), [*keys, "_i"])
    margin = z_critical(level) * F.col("_sd") * F.sqrt(F.col("h"))
    return rows.select(*keys, "h", "ds", F.col("y").alias("yhat"), (F.col("y") - margin).alias("yhat_lower"), (F.col("y") + margin).alias("yhat_upper"),
                       F.lit("naive").alias("cand"))
