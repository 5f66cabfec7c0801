"""Aggregations.  All group by the full key with map-side combine; nothing keeps a whole group in memory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_numeric
from .base import Keys, join_on_keys
from .quantiles import exact_quantiles


def _method(c: Column, how: str, ds: Column | None = None) -> Column:
    match how:
        case "sum":
            return F.coalesce(F.sum(c), F.lit(0.0))
        case "mean":
            return F.avg(c)
        case "max":
            return F.max(c)
        case "min":
            return F.min(c)
        case "last":
            return F.max_by(c, F.when(c.isNotNull(), ds))
    raise ValueError(f"unknown method {how}")


def aggregate_series(df: DataFrame, ds: str, y: str, dims: Keys = (), how: str = "sum",
                     extra: Mapping[str, str] | None = None) -> DataFrame:
    """Total per date, or per date and dimensions; rows with a NULL dimension are left out."""
    extra = {c: m for c, m in (extra or {}).items() if c in df.columns and c != y}
    kinds = dict(df.dtypes)
    value = clean_numeric(F.col(y)) if kinds[y] == "string" else F.col(y).cast("double")
    rows = df.select(F.col(ds).cast("date").alias("ds"), *dims, value.alias("y"), *extra)
    rows = rows.where(F.col("ds").isNotNull())
    for c in dims:
        rows = rows.where(F.col(c).isNotNull())
    methods = {"y": how, **extra}
    keys = ["ds", *dims]
    plain = [_method(F.col(c), m).alias(c) for c, m in methods.items() if m != "median"]
    medians = [c for c, m in methods.items() if m == "median"]
    out = rows.groupBy(*keys).agg(*plain) if plain else rows.select(*keys).distinct()
    for c in medians:
        out = out.join(exact_quantiles(rows, keys, c, {c: 0.5}), keys, "left")
    return out.select(*keys, *methods)


def binary_columns(df: DataFrame, cols: Sequence[str]) -> dict[str, bool]:
    """For each column: are all filled values 0 or 1?  One pass; the answer is one row."""
    if not cols:
        return {}
    row = df.agg(*[F.bool_and(F.col(c).cast("double").isin(0.0, 1.0)).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols if row[c] is not None}


def covariate_aggs(df: DataFrame, covs: Sequence[str], cont: str = "sum") -> dict[str, str]:
    """Flags are aggregated by max, other covariates by ``cont`` (sum when preparing, mean when resampling)."""
    return {c: "max" if flag else cont for c, flag in binary_columns(df, [c for c in covs if c in df.columns]).items()}


# fixed order of frequencies, finest first
_RANK = {"daily": 0, "weekly": 1, "monthly": 2}
_DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def period_label(ds: Column, freq: str) -> Column:
    """Right edge label: week ending on the named day (Sunday for 'weekly'), or month end."""
    if freq == "monthly":
        return F.last_day(ds)
    day = "SUN" if freq == "weekly" else freq.removeprefix("W-")
    if day not in _DAYS:
        raise ValueError(f"unknown target frequency {freq}")
    return F.next_day(F.date_sub(ds, 1), day)


def resample(df: DataFrame, keys: Keys, freq: str, aggs: Mapping[str, str], source: str = "daily") -> DataFrame:
    """To a lower frequency.  Sum-only keeps empty periods as 0; otherwise incomplete periods are dropped."""
    if freq in _RANK and _RANK[freq] <= _RANK[source]:
        raise ValueError(f"cannot go from {source} to {freq}")
    label = period_label(F.col("ds"), freq)
    out = df.groupBy(*keys, label.alias("period")).agg(
        *[_method(F.col(c).cast("double"), m, F.col("ds")).alias(c) for c, m in aggs.items()])
    if set(aggs.values()) == {"sum"}:
        step = F.expr("INTERVAL 1 MONTH") if freq == "monthly" else F.expr("INTERVAL 7 DAY")
        lo, hi = F.min("period"), F.max("period")
        if freq == "monthly":
            span = F.transform(F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), step), F.last_day)
        else:
            span = F.sequence(lo, hi, step)
        spine = out.groupBy(*keys).agg(span.alias("p")).select(*keys, F.explode("p").alias("period"))
        out = spine.join(out, [*keys, "period"], "left").fillna(0.0, list(aggs))
    else:
        out = out.dropna(subset=list(aggs))
    return out.withColumnRenamed("period", "ds")


# fixed values: name parts that mean the target is an average
AVERAGE_NAMES = ("avg", "average", "mean", "rate", "per_")


def rollup_named(df: DataFrame, keys: Keys, ds: str, y: str, freq: str) -> DataFrame:
    """Monday week or month start; a target whose name says average is averaged (first per day, then per period)."""
    mean = any(p in y.lower() for p in AVERAGE_NAMES)
    value = F.coalesce(F.col(y).cast("double"), F.lit(0.0))
    how = F.avg if mean else F.sum
    days = df.where(F.col(ds).isNotNull()).groupBy(*keys, F.col(ds).cast("date").alias("ds")).agg(how(value).alias(y))
    if freq == "daily":
        return days
    unit = {"weekly": "week", "monthly": "month"}[freq]
    return days.groupBy(*keys, F.trunc("ds", unit).alias("ds")).agg(how(y).alias(y))


def segment_id(keys: Keys, sep: str = " | ") -> Column:
    return F.concat_ws(sep, *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in keys])


def list_segments(df: DataFrame, keys: Keys) -> DataFrame:
    """Segments with their row counts, largest first."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .select(segment_id(keys).alias("segment"), *keys, "n_rows").orderBy(F.desc("n_rows"), "segment"))


def slice_stats(df: DataFrame, keys: Keys, y: str) -> DataFrame:
    """Rows, sum and mean of the target per combination; blank names become 'Unknown'."""
    named = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("Unknown")).alias(c) for c in keys]
    value = F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias("_v")
    out = df.select(*named, value).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("_v").alias("target_sum"), F.avg("_v").alias("target_avg"))
    return out.select(F.concat_ws(" | ", *keys).alias("slice"), "*").orderBy(F.desc("target_sum"), "slice")


def sibling_rollup(df: DataFrame, dims: Keys, ds: str = "ds", y: str = "y") -> DataFrame:
    """Slices merged over each single dimension in turn; ``merged_dim`` names the dimension summed away."""
    base = df.groupBy(*dims, F.col(ds).alias("ds")).agg(F.sum(y).alias("y"))
    sets = [[F.col("ds"), *[F.col(c) for c in dims if c != d]] for d in dims]
    merged = F.coalesce(*[F.when(F.grouping(F.col(c)) == 1, F.lit(c)) for c in dims])
    return base.groupingSets(sets, F.col("ds"), *[F.col(c) for c in dims]).agg(
        merged.alias("merged_dim"), F.sum("y").alias("y"))


def snapshot(df: DataFrame, keys: Keys, ds: str, y: str, covs: Sequence[str] = ()) -> DataFrame:
    """Numbers that describe a table at one stage: rows, dates, target, covariates."""
    aggs = [
        F.count(F.lit(1)).alias("n_rows"), F.min(ds).alias("min_ds"), F.max(ds).alias("max_ds"),
        F.count_distinct(ds).alias("n_dates"), F.min(y).alias("min_y"), F.max(y).alias("max_y"),
        F.avg(y).alias("mean_y"), F.stddev_samp(y).alias("std_y"), F.count_if(F.col(y).isNull()).alias("null_y"),
        F.count_if(F.col(y) == 0).alias("zero_y"), F.coalesce(F.sum(y), F.lit(0.0)).alias("sum_y")]
    for c in covs:
        # a missing value is unequal to zero, as in the floating-point comparison it stands for
        aggs += [F.count(c).alias(f"{c}_non_null"), F.count_if(F.coalesce(F.col(c) != 0, F.lit(True))).alias(f"{c}_non_zero"),
                 F.count_distinct(c).alias(f"{c}_unique"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    base = df.groupBy(*keys).agg(*aggs)
    return join_on_keys(base, exact_quantiles(df, keys, y, {"median_y": 0.5}), keys, "left")


def date_coverage(df: DataFrame, keys: Keys) -> DataFrame:
    out = df.groupBy(*keys).agg(F.min("ds").alias("start"), F.max("ds").alias("end"), F.count(F.lit(1)).alias("n_rows"))
    days = F.datediff("end", "start")
    return out.select("*", days.alias("span_days"), (days / 365.25).alias("span_years"), (days / 30.44).alias("history_months"))


def describe_series(df: DataFrame, keys: Keys, y: str = "y") -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"),
        F.coalesce(F.bool_or(F.col(y) < 0), F.lit(False)).alias("has_negative"),
        F.coalesce(F.bool_or(F.col(y) == 0), F.lit(False)).alias("has_zero"))
    return out.withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")).otherwise(0.0))


def total_forecast(fc: DataFrame, keys: Keys) -> DataFrame:
    """Sum over series of forecast and bounds per step, with the mean holdout error of the series."""
    per = fc.groupBy(*keys).agg(F.max("holdout_mape").alias("m"))
    clean = F.when(F.col("m").isNull() | F.isnan("m") | (F.abs("m") == float("inf")), 100.0).otherwise(F.col("m"))
    mean = per.agg(F.avg(clean).alias("holdout_mape"), F.count(F.lit(1)).alias("n_series"))
    steps = fc.groupBy("h").agg(F.min("ds").alias("ds"), F.sum("yhat").alias("yhat"), F.sum("yhat_lower").alias("yhat_lower"),
                                F.sum("yhat_upper").alias("yhat_upper"))
    return steps.crossJoin(F.broadcast(mean))


def aggregation_needed(df: DataFrame, ds: str) -> DataFrame:
    """Is there more than one row per date?"""
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col(ds).cast("date")).alias("n_dates"))
    return out.select("*", (F.col("n_rows") > F.col("n_dates")).alias("recommended"),
                      F.coalesce(F.try_divide("n_rows", "n_dates"), F.lit(0.0)).alias("rows_per_date"))


