"""Prediction intervals: parametric, conformal, calibrated, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import critical_value, z_critical
from .base import Keys, by, join_on_keys


def residual_interval(fc: DataFrame, res: DataFrame, keys: Keys, level: float = 0.95) -> DataFrame:
    """Student (under 30 residuals) or normal width times √(1 + h/n); all-positive forecasts keep a tenth as lower bound."""
    s = res.groupBy(*keys).agg(F.count("res").alias("_n"), F.stddev_pop("res").alias("_sd"))
    out = join_on_keys(fc, s, keys)
    n = F.col("_n")
    crit = critical_value(F.greatest(n, F.lit(2)), level)
    margin = crit * F.col("_sd") * F.sqrt(1 + F.col("h") / F.greatest(n, F.lit(1)))
    positive = F.min("yhat").over(by(keys)) > 0
    low = F.col("yhat") - margin
    return out.withColumns({
        "yhat_lower": F.when(positive, F.greatest(low, F.col("yhat") * 0.1)).otherwise(low), "yhat_upper": F.col("yhat") + margin}).drop("_n", "_sd")


def array_quantile(a: Column, q: Column) -> Column:
    """Interpolated quantile of a sorted array at a level that may differ by row."""
    pos = q * (F.size(a) - 1)
    lo = F.floor(pos).cast("int")
    low, high = F.try_element_at(a, lo + 1), F.try_element_at(a, F.ceil(pos).cast("int") + 1)
    return low + (pos - lo) * (high - low)


def _residual_arrays(res: DataFrame, keys: Keys, finite: bool) -> DataFrame:
    """Sorted residuals and sorted sizes per series: at most one per date."""
    r = F.col("res")
    rows = res.where(r.isNotNull() & (~F.isnan(r) & (F.abs(r) < float("inf")) if finite else F.lit(True)))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("res")).alias("_r"), F.array_sort(F.collect_list(F.abs("res"))).alias("_a"),
                                   F.count(F.lit(1)).alias("_n"), F.stddev_pop("res").alias("_sd"))


def conformal_table(res: DataFrame, keys: Keys, coverage: float = 0.9) -> DataFrame:
    """Quantiles per series: symmetric size with the finite-sample level, and both signed tails."""
    t = _residual_arrays(res, keys, False)
    q = 1 - F.least(F.lit(1.0), (1 - coverage) * (F.col("_n") + 1) / F.col("_n"))
    a = 1 - coverage
    return t.select(*keys, F.col("_n").alias("n_residuals"), array_quantile(F.col("_a"), q).alias("q_size"),
                    array_quantile(F.col("_r"), F.lit(a / 2)).alias("q_low"), array_quantile(F.col("_r"), F.lit(1 - a / 2)).alias("q_high"))


def _bounds(method: str, growth: float) -> tuple[Column, Column]:
    y = F.col("yhat")
    none = F.col("q_size").isNull()
    if method == "asymmetric":
        lo, hi = y + F.col("q_low"), y + F.col("q_high")
    else:
        k = 1 + growth * (F.col("h") - 1) if method == "growing" else F.lit(1.0)
        lo, hi = y - F.col("q_size") * k, y + F.col("q_size") * k
    return F.when(none, y * 0.9).otherwise(lo), F.when(none, y * 1.1).otherwise(hi)


def conformal(fc: DataFrame, res: DataFrame, keys: Keys, coverage: float = 0.9, method: str = "symmetric", growth: float = 0.02) -> DataFrame:
    """Distribution-free bounds: symmetric, asymmetric or growing with the horizon; lower not negative, upper not below the forecast."""
    if method not in ("symmetric", "asymmetric", "growing"):
        raise ValueError(method)
    out = join_on_keys(fc, conformal_table(res, keys, coverage), keys, "left")
    lo, hi = _bounds(method, growth)
    return out.withColumns({"yhat_lower": F.greatest(lo, F.lit(0.0)), "yhat_upper": F.greatest(hi, F.col("yhat"))}).drop("n_residuals", "q_size", "q_low", "q_high")


def conformal_split(fc: DataFrame, res: DataFrame, keys: Keys, coverage: float = 0.9, method: str = "split") -> DataFrame:
    """Second form: level (1 + 1/n)·coverage on sizes, or signed tails; under five residuals a normal width."""
    t = _residual_arrays(res, keys, True)
    q = F.least(F.lit(1.0), (1 + 1 / F.col("_n")) * coverage)
    a = 1 - coverage
    size = array_quantile(F.col("_a"), q)
    lo, hi = (-size, size) if method == "split" else (array_quantile(F.col("_r"), F.lit(a / 2)), array_quantile(F.col("_r"), F.lit(1 - a / 2)))
    z = z_critical(coverage) * F.col("_sd")
    few = F.col("_n") < 5
    t = t.select(*keys, few.alias("_few"), F.when(few, -z).otherwise(lo).alias("_lo"), F.when(few, z).otherwise(hi).alias("_hi"))
    out = join_on_keys(fc, t, keys, "left")
    y = F.col("yhat")
    low, high = y + F.col("_lo"), y + F.col("_hi")
    return out.withColumns({"yhat_lower": F.when(F.col("_few"), low).otherwise(F.least(low, y)), "yhat_upper": F.when(F.col("_few"), high).otherwise(F.greatest(high, y))}).drop("_few", "_lo", "_hi")


def coverage(pairs: DataFrame, keys: Keys, target: float = 0.9) -> DataFrame:
    """Share of actuals inside their bounds against the target, and mean widths."""
    inside = F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper"))
    width = F.col("yhat_upper") - F.col("yhat_lower")
    out = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(inside).alias("n_within"), F.avg(width).alias("mean_width"),
        (F.avg(width / F.greatest("y", F.lit(0.01))) * 100).alias("mean_width_pct"))
    out = out.withColumn("actual_coverage", F.col("n_within") / F.col("n_samples"))
    return out.withColumns({"coverage_gap": F.col("actual_coverage") - target, "is_calibrated": F.abs(F.col("actual_coverage") - target) < 0.05})


def calibrate(pairs: DataFrame, keys: Keys, target: float = 0.9, steps: int = 10) -> DataFrame:
    """Scale of the interval width that brings coverage within a point of the target: ×1.1 or ×0.95, at most ten times."""
    half = (F.col("yhat_upper") - F.col("yhat_lower")) / 2
    rows = pairs.groupBy(*keys).agg(F.collect_list(F.struct(
        F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).alias("first"), F.abs(F.col("y") - F.col("yhat")).alias("d"), half.alias("w"))).alias("_v"))

    def step(acc: Column, i: Column) -> Column:
        def inside(v):
            return F.when(i == 1, v["first"]).otherwise(v["d"] <= v["w"] * acc["scale"])

        share = F.size(F.filter("_v", inside)) / F.size("_v")
        done = acc["done"] | (F.abs(share - target) < 0.01)
        return F.struct(F.when(done, acc["scale"]).when(share < target, acc["scale"] * 1.1).otherwise(acc["scale"] * 0.95).alias("scale"), done.alias("done"))

    fold = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(1.0).alias("scale"), F.lit(False).alias("done")), step)
    return rows.select(*keys, fold["scale"].alias("scale"))


class ConformalIntervals:
    """Fitted interval maker: ``fit`` stores quantiles (and a calibration scale) per series, ``transform`` applies them."""

    def __init__(self, keys: Keys, coverage: float = 0.9, method: str = "symmetric", growth: float = 0.02, calibrate: bool = True):
        self.keys, self.coverage, self.method, self.growth, self.calibrate = list(keys), coverage, method, growth, calibrate
        self.table: DataFrame | None = None

    def fit(self, pairs: DataFrame) -> ConformalIntervals:
        """``pairs`` holds y and yhat, and for calibration the bounds to be calibrated."""
        t = conformal_table(pairs.withColumn("res", F.col("y") - F.col("yhat")), self.keys, self.coverage)
        if self.calibrate and {"yhat_lower", "yhat_upper"} <= set(pairs.columns):
            t = join_on_keys(t, calibrate(pairs, self.keys, self.coverage), self.keys)
        else:
            t = t.withColumn("scale", F.lit(1.0))
        self.table = t
        return self

    def transform(self, fc: DataFrame) -> DataFrame:
        if self.table is None:
            raise ValueError("fit first")
        lo, hi = _bounds(self.method, self.growth)
        out = join_on_keys(fc, self.table, self.keys, "left").withColumns({"_lo": lo, "_hi": hi})
        y, s, half = F.col("yhat"), F.coalesce("scale", F.lit(1.0)), (F.col("_hi") - F.col("_lo")) / 2
        low, high = F.when(s != 1, y - half * s).otherwise(F.col("_lo")), F.when(s != 1, y + half * s).otherwise(F.col("_hi"))
        return out.withColumns({"yhat_lower": F.greatest(low, F.lit(0.0)), "yhat_upper": F.greatest(high, y)}).drop(
            "_lo", "_hi", "scale", "n_residuals", "q_size", "q_low", "q_high")


def bootstrap_interval(fc: DataFrame, res: DataFrame, keys: Keys, n: int = 1000, levels: Sequence[float] = (0.5, 0.8, 0.95), seed: int = 42) -> DataFrame:
    """Percentiles of the forecast plus n drawn residuals. Draw i of a step takes the residual (in order) whose index is the
    first 32 bits of md5 of ``seed|keys|h|i`` modulo their number, so draws depend on nothing else and are the same in any
    engine; no sample rows are shuffled. A null key counts as empty text; a series without residuals has no row."""
    pool = res.where(F.col("res").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list("res")).alias("_r"))
    out = join_on_keys(fc, pool, keys)
    head = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, "h")])

    def draw(i: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws("|", head, i.cast("string"))), 1, 8), 16, 10).cast("bigint")
        return F.element_at("_r", (bits % F.size("_r") + 1).cast("int"))

    draws = F.transform(F.sequence(F.lit(1), F.lit(n)), draw)
    out = out.withColumn("_s", F.array_sort(draws))
    for lv in levels:
        a, name = 1 - lv, int(lv * 100)
        out = out.withColumns({f"lower_{name}": F.col("yhat") + array_quantile(F.col("_s"), F.lit(a / 2)), f"upper_{name}": F.col("yhat") + array_quantile(F.col("_s"), F.lit(1 - a / 2))})
    return out.drop("_r", "_s")
