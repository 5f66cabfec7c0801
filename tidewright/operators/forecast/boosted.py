"""Boosted trees pooled over all series, with a recursive horizon.

One model is fitted on the feature rows of every series (Spark MLlib, distributed).  Values are divided
by the mean of their series, so that one tree set serves all levels.  For the horizon each series is one row
holding its last values as an array; every step reads its lags from the array, predicts, and appends: no
join and no shuffle per step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...session import cut_lineage
from ..base import Keys, YOY_LAG, by
from ..signals import numbered
from ..windows import add_tree_lags

CALENDAR = ("day_of_week", "day_of_month", "month", "week_of_year", "quarter")


def _calendar(ds: Column) -> dict[str, Column]:
    return {"day_of_week": F.weekday(ds), "day_of_month": F.dayofmonth(ds), "month": F.month(ds), "week_of_year": F.weekofyear(ds), "quarter": F.quarter(ds)}


def lag_names(freq: str) -> list[str]:
    k = YOY_LAG[freq]
    return ["lag_1", "lag_7", "rolling_mean_7", f"lag_{k}", f"lag_{k}_rolling_avg"]


def feature_rows(df: DataFrame, keys: Keys, freq: str, covs: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """History scaled by the series mean, with lags, calendar and time index."""
    rows = numbered(df, keys).join(df.select(*keys, "ds", *covs), [*keys, "ds"]) if covs else numbered(df, keys)
    mean = F.avg(F.abs("y")).over(by(keys))
    rows = rows.withColumn("_scale", F.when(mean > 0, mean).otherwise(1.0)).withColumn("y", F.col("y") / F.col("_scale"))
    # lags a series is too short for take its (scaled) mean
    level = F.avg("y").over(by(keys))
    rows = add_tree_lags(rows, keys, freq)
    rows = rows.withColumns({c: F.coalesce(c, level) for c in lag_names(freq)}).select("*", *[v.alias(k) for k, v in _calendar(F.col("ds")).items()])
    return rows, [*lag_names(freq), *CALENDAR, "t", *covs]


def fit_boosted(rows: DataFrame, features: Sequence[str], n_trees: int = 30, depth: int = 4, rate: float = 0.1, seed: int = 42) -> GBTRegressionModel:
    data = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(rows).where("y is not null").select("features", F.col("y").alias("label"))
    return GBTRegressor(maxIter=n_trees, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=0.8).fit(data)


def boosted(df: DataFrame, future: DataFrame, keys: Keys, freq: str, h: int, covs: Sequence[str] = (), n_trees: int = 30, depth: int = 4) -> DataFrame:
    """Pooled fit and recursive forecast: ``keys, h, ds, yhat`` with bounds from the fitted errors."""
    rows, features = feature_rows(df, keys, freq, covs)
    model = fit_boosted(rows, features, n_trees, depth)
    fitted = model.transform(VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows))
    err = fitted.groupBy(*keys).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)).alias("_sd"))
    k = YOY_LAG[freq]
    keep = k + 8
    last = rows.where(F.col("t") >= F.col("n") - keep)
    state = last.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda v: v["y"]).alias("v"),  # at most ``keep`` values
        F.max("n").alias("t"), F.max("_scale").alias("_scale"))
    ahead = future.where(F.col("h") <= h).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("h", "ds", *[F.col(c).cast("double").alias(c) for c in covs]))).alias("f"))
    state = state.join(ahead, list(keys)) if keys else state.crossJoin(ahead)
    state = state.withColumn("p", F.array().cast("array<double>"))
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")

    def back(i: int) -> Column:
        """Value i steps before the next one, or the oldest known."""
        return F.element_at("v", -F.least(F.lit(i), F.size("v")))

    def mean(a: int, b: int) -> Column:
        """Mean of the values a..b steps back."""
        part = F.when(F.size("v") >= b, F.slice("v", -b, b - a + 1)).otherwise(F.slice("v", 1, F.greatest(F.size("v") - a + 1, F.lit(1))))
        return F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)

    for i in range(1, h + 1):
        day = F.element_at("f", i)
        lags = {"lag_1": back(1), "lag_7": back(7), "rolling_mean_7": mean(1, 7), f"lag_{k}": back(k), f"lag_{k}_rolling_avg": mean(k - 3, k + 3)}
        feats = {**lags, **_calendar(day["ds"]), **{c: day[c] for c in covs}}
        now = model.transform(asm.transform(state.withColumns(feats)))
        grown = F.concat("v", F.array("prediction"))
        state = now.select(
            *keys, F.slice(grown, -F.least(F.size(grown), F.lit(keep)), F.lit(keep)).alias("v"), (F.col("t") + 1).alias("t"), "_scale", "f",
            F.concat("p", F.array("prediction")).alias("p"))
        if i % 6 == 0 and i < h:  # keeps the plan short; one row per series is written
            state = cut_lineage(state)
    out = state.select(*keys, "_scale", F.posexplode("p").alias("i", "q"), "f")
    out = out.select(*keys, "_scale", "q", F.element_at("f", F.col("i") + 1).alias("d"))
    out = out.join(err, list(keys), "left") if keys else out.crossJoin(err)
    value, margin = F.col("q") * F.col("_scale"), 1.96 * F.col("_sd") * F.col("_scale") * F.sqrt(F.col("d.h"))
    return out.select(*keys, F.col("d.h").alias("h"), F.col("d.ds").alias("ds"), value.alias("yhat"), (value - margin).alias("yhat_lower"), (value + margin).alias("yhat_upper"))
