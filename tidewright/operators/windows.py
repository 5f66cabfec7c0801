"""Window operators.  Every window of one operator shares the partitioning by series key: one exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage
from .base import Keys, YOY_LAG, by, median, ordered, position, running, series_len

# fixed values -----------------------------------------------------------------------------
LAGS = {"daily": (1, 7, 14, 28, 364), "weekly": (1, 4, 13, 26, 52), "monthly": (1, 3, 6, 12)}
ROLLING = {
    "daily": ((7, "mean"), (7, "std"), (28, "mean")),
    "weekly": ((4, "mean"), (4, "std"), (13, "mean")),
    "monthly": ((3, "mean"), (3, "std"), (6, "mean")),
}
YOY_MIN_ROWS = {"daily": 400, "weekly": 60, "monthly": 15}
YOY_SMOOTH = {"daily": 7, "weekly": 4, "monthly": 3}
# ------------------------------------------------------------------------------------------


def add_trend(df: DataFrame, keys: Keys) -> DataFrame:
    """Position, elapsed days, weeks and months, and time scaled to 0..1."""
    n, start = series_len(keys), F.min("ds").over(by(keys))
    out = df.select("*", position(keys).alias("time_index"), F.datediff("ds", start).alias("days_since_start"), n.alias("_n"))
    return out.select(
        *df.columns, "time_index", F.year("ds").alias("year"), "days_since_start",
        (F.col("days_since_start") / 7).alias("weeks_since_start"),
        (F.col("days_since_start") / 30.44).alias("months_since_start"),
        F.when(F.col("_n") > 1, F.col("time_index") / (F.col("_n") - 1)).otherwise(0.0).alias("time_normalized"))


def add_lags(df: DataFrame, keys: Keys, freq: str, lags: Sequence[int] | None = None, y: str = "y") -> DataFrame:
    """Lags of the frequency; a series not longer than the lag gets NULLs."""
    o = ordered(keys)
    return df.select("*", *[F.lag(y, k).over(o).alias(f"lag_{k}") for k in (lags or LAGS[freq])])


def add_rolling(df: DataFrame, keys: Keys, freq: str, y: str = "y") -> DataFrame:
    """Statistics of the previous w values, the current one left out."""
    n = series_len(keys)
    fn = {"mean": F.avg, "std": F.stddev_samp}
    return df.select("*", *[
        F.when(n > w, fn[how](y).over(running(keys, -w, -1))).alias(f"rolling_{how}_{w}") for w, how in ROLLING[freq]])


def add_yoy(df: DataFrame, keys: Keys, freq: str, y: str = "y") -> DataFrame:
    """Value one year back by position and its trailing mean, for series with enough filled rows."""
    k, w = YOY_LAG[freq], YOY_SMOOTH[freq]
    enough = F.count(y).over(by(keys)) >= YOY_MIN_ROWS[freq]
    return df.select(
        "*", F.when(enough, F.lag(y, k).over(ordered(keys))).alias(f"lag_{k}"),
        F.when(enough, F.avg(y).over(running(keys, -(k + w - 1), -k))).alias(f"lag_{k}_avg"))


def _fill_edges(df: DataFrame, keys: Keys, cols: Sequence[str]) -> DataFrame:
    ahead, back = running(keys, 0, W.unboundedFollowing), running(keys, W.unboundedPreceding, 0)
    return df.withColumns({
        c: F.coalesce(F.first(c, ignorenulls=True).over(ahead), F.last(c, ignorenulls=True).over(back)) for c in cols})


def add_tree_lags(df: DataFrame, keys: Keys, freq: str, y: str = "y") -> DataFrame:
    """Lag set of the tree model: recent lags, year-over-year lag, centred mean and ratio; edges are filled."""
    k, o = YOY_LAG[freq], ordered(keys)
    out = df.select(
        "*", F.lag(y, 1).over(o).alias("lag_1"), F.lag(y, 7).over(o).alias("lag_7"),
        F.avg(y).over(running(keys, -7, -1)).alias("rolling_mean_7"), F.lag(y, k).over(o).alias(f"lag_{k}"),
        *([F.lag(y, 365).over(o).alias("lag_365")] if freq == "daily" else []),
        F.avg(y).over(running(keys, -(k + 3), -(k - 3))).alias(f"lag_{k}_rolling_avg"))
    ratio = F.col(y) / F.nullif(F.col(f"lag_{k}"), F.lit(0.0))
    ratio = F.coalesce(F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.1)), F.lit(10.0))), F.lit(1.0))
    lagged = [c for c in out.columns if c not in df.columns]
    return _fill_edges(out.withColumn("yoy_ratio", ratio), keys, lagged)


# fixed values: days of one step of each frequency
STEP_DAYS = {"daily": 1, "weekly": 7, "monthly": 30}
EXPECTED_DAYS = {"daily": 1, "weekly": 7, "monthly": 30, "quarterly": 91, "yearly": 365}


def gap_limit(freq: str, rule: str) -> float:
    """Longest distance in days that is not yet a gap."""
    match rule:
        case "quality":
            return STEP_DAYS[freq] * (2.0 if freq == "daily" else 1.5)
        case "analysis":
            return EXPECTED_DAYS[freq] * 1.5
        case "slice":
            return STEP_DAYS[freq] * 1.5
    raise ValueError(rule)


def gaps(df: DataFrame, keys: Keys, freq: str, rule: str = "quality") -> DataFrame:
    """Rows that follow a gap, with the last date before it and its length in days."""
    out = df.withColumn("prev_ds", F.lag("ds").over(ordered(keys)))
    out = out.withColumn("gap_days", F.datediff("ds", "prev_ds"))
    return out.where(F.col("gap_days") > gap_limit(freq, rule)).select(*keys, "prev_ds", "ds", "gap_days")


def fill(df: DataFrame, keys: Keys, cols: Sequence[str], how: Sequence[str] = ("forward", "backward"),
         constant: float | None = None) -> DataFrame:
    """Forward and/or backward fill in the given order, then a constant."""
    frames = {"forward": (F.last, running(keys, W.unboundedPreceding, 0)),
              "backward": (F.first, running(keys, 0, W.unboundedFollowing))}

    def filled(c: str) -> Column:
        parts = [F.col(c)] + [frames[h][0](c, ignorenulls=True).over(frames[h][1]) for h in how]
        return F.coalesce(*parts, *([F.lit(constant)] if constant is not None else []))

    return df.withColumns({c: filled(c) for c in cols})


def dedup_dates(df: DataFrame, keys: Keys, order: Sequence[str]) -> DataFrame:
    """One row per date: the last one by ``order``.  An aggregate, so a hot date combines map-side."""
    rest = [c for c in df.columns if c not in (*keys, "ds")]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(*keys, "ds").agg(best).select(*keys, "ds", *[F.col(f"r.{c}").alias(c) for c in rest])


def flag_incomplete_tail(df: DataFrame, keys: Keys, y: str = "y", lookback: int = 4, threshold: float = 0.5) -> DataFrame:
    """Adds ``is_tail``: unbroken run of low values at the end, compared with the median before the last rows."""
    n = series_len(keys)
    out = df.select("*", position(keys).alias("_i"), n.alias("_n"))
    stable = median(F.when(F.col("_i") < F.col("_n") - lookback, F.col(y))).over(by(keys))
    out = out.withColumn("_med", stable)
    low = (
        (F.col("_n") >= lookback + 2) & (F.col("_med") > 0)
        & (F.col("_i") > F.greatest(F.col("_n") - lookback - 1, F.lit(lookback)))
        & (F.col(y) / F.nullif(F.col("_med"), F.lit(0.0)) < threshold))
    out = out.withColumn("_low", F.coalesce(low, F.lit(False)))
    run = F.bool_and("_low").over(running(keys, 0, W.unboundedFollowing))
    return out.withColumn("is_tail", run).drop("_i", "_n", "_med", "_low")


def drop_incomplete_tail(df: DataFrame, keys: Keys, y: str = "y", lookback: int = 4, threshold: float = 0.5) -> DataFrame:
    return flag_incomplete_tail(df, keys, y, lookback, threshold).where(~F.col("is_tail")).drop("is_tail")


def incomplete_final(df: DataFrame, keys: Keys, y: str = "y") -> DataFrame:
    """One row per series: does the last period look unfinished, and why.  Takes raw rows."""
    return incomplete_final_day(day_counts(df, keys, y), keys)


def day_counts(df: DataFrame, keys: Keys, y: str = "y") -> DataFrame:
    """Raw rows reduced to one per date: sum ``v``, filled rows ``c`` and all rows ``rows``."""
    return df.groupBy(*keys, "ds").agg(
        F.coalesce(F.sum(y), F.lit(0.0)).alias("v"), F.count(y).alias("c"), F.count(F.lit(1)).alias("rows"))


def incomplete_final_day(days: DataFrame, keys: Keys) -> DataFrame:
    """The same from rows made by :func:`day_counts`."""
    late = F.row_number().over(ordered(keys, F.col("ds").desc()))
    hist = F.col("_rn") > 1
    out = days.withColumn("_rn", late).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_dates"), (F.sum("rows") > F.count(F.lit(1))).alias("multi"),
        F.max("ds").alias("last_date"), F.max(F.when(F.col("_rn") == 1, F.col("v"))).alias("last_value"),
        F.max(F.when(F.col("_rn") == 2, F.col("v"))).alias("prev_value"),
        F.max(F.when(F.col("_rn") == 1, F.col("c"))).alias("last_rows"),
        median(F.when(hist, F.col("v"))).alias("median_value"), median(F.when(hist, F.col("c"))).alias("median_rows"))

    def drop_pct(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, (1 - F.col(part) / F.col(whole)) * 100)

    out = out.withColumn("drop_pct", drop_pct("last_value", "median_value"))
    out = out.withColumn("row_drop_pct", F.when(F.col("multi"), drop_pct("last_rows", "median_rows")))
    out = out.withColumn("sudden_drop_pct", drop_pct("last_value", "prev_value"))
    reason = (F.when(F.col("n_dates") < 5, None).when(F.col("drop_pct") > 50, "below_median")
              .when(F.col("row_drop_pct") > 30, "fewer_rows").when(F.col("sudden_drop_pct") > 70, "sudden_drop"))
    return out.withColumn("reason", reason).withColumn("is_incomplete", F.col("reason").isNotNull())


def partial_weeks(df: DataFrame, keys: Keys, y: str = "y") -> DataFrame:
    """Weeks under half of the mean of two weeks either side, near a month edge."""
    near = running(keys, -2, 2)
    out = df.select("*", position(keys).alias("_i"), series_len(keys).alias("_n"), F.sum(y).over(near).alias("_s"))
    out = out.where((F.col("_i") >= 2) & (F.col("_i") < F.col("_n") - 2))
    out = out.withColumn("surrounding_mean", (F.col("_s") - F.col(y)) / 4)
    edge = (F.dayofmonth("ds") <= 10) | (F.dayofmonth("ds") >= F.dayofmonth(F.last_day("ds")) - 6)
    out = out.where((F.col("surrounding_mean") > 0) & (F.col(y) < 0.5 * F.col("surrounding_mean")) & edge)
    return out.withColumn("drop_pct", (F.col(y) / F.col("surrounding_mean") - 1) * 100).drop("_i", "_n", "_s")


def rank_models(results: DataFrame, job: Keys, mape: str = "mape") -> DataFrame:
    """Rank of each model in its job by error, NULLs last, with the best flag."""
    r = F.rank().over(W.partitionBy(*job).orderBy(F.col(mape).asc_nulls_last()))
    return results.withColumn("rank", F.when(F.col(mape).isNotNull(), r)).withColumn(
        "is_best", F.coalesce(F.col("rank") == 1, F.lit(False)))


def growth(df: DataFrame, keys: Keys, y: str = "y") -> DataFrame:
    """Percent change from the previous period, NULL at the start or after zero."""
    prev = F.lag(y).over(ordered(keys))
    return df.withColumn("growth_pct", F.try_divide(F.col(y) - prev, prev) * 100)


def split_series(df: DataFrame, keys: Keys, h: int, mode: str = "full", test_size: int | None = None) -> DataFrame:
    """Labels train, eval and holdout counted from the end of each series."""
    n = series_len(keys)
    out = df.select("*", F.row_number().over(ordered(keys, F.col("ds").desc())).alias("_back"), n.cast("int").alias("_n"))
    n = F.col("_n")

    def part(k: int) -> Column:
        return F.floor(n / k).cast("int")

    if mode == "full":
        hold = F.least(F.lit(h), F.greatest(F.lit(1), part(7)))
        ev = F.lit(test_size) if test_size else hold
        short = n - ev - hold < max(2 * h, 30)
        small = F.lit(test_size) if test_size else F.least(F.lit(h), part(5))
        ev, hold = F.when(short, small).otherwise(ev), F.when(short, 0).otherwise(hold)
    elif mode == "simple":
        size = F.greatest(F.floor(n * F.lit(0.15)).cast("int"), F.lit(min(h, 12)), F.lit(3))
        # with less than half left for training both parts are cut back
        half = F.greatest(F.floor(F.floor(n * F.lit(0.5)) / 2).cast("int"), F.lit(h), F.lit(3))
        size = F.when(n - 2 * size < n * 0.5, half).otherwise(size)
        size = F.when(n < 50, F.greatest(F.least(F.lit(h), part(4)), F.lit(3))).otherwise(size)
        ev = hold = size
    else:
        raise ValueError(mode)
    label = F.when(F.col("_back") <= hold, "holdout").when(F.col("_back") <= hold + ev, "eval").otherwise("train")
    return out.withColumn("split", label).drop("_back", "_n")


# fixed values: error limits of the quality bands of a segment
SEGMENT_BANDS = ((10.0, "good"), (20.0, "acceptable"))


def segment_quality(mape: Column) -> Column:
    return F.when(mape <= 10, "good").when(mape <= 20, "acceptable").otherwise("poor")


def rank_segments(metrics: DataFrame, segment: str = "segment", mape: str = "mape") -> DataFrame:
    """Worst first, numbered over all segments."""
    valid = metrics.where(F.col(mape).isNotNull() & ~F.isnan(mape))
    return global_rank(valid, -F.col(mape), ties=[segment]).withColumn("quality", segment_quality(F.col(mape)))


def global_rank(df: DataFrame, value: Column, lead: Sequence[str] = (), ties: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1-based position in the order (lead…, value, ties…) without one task seeing all rows.

    Rows are dealt by ranges of the whole order, so equal values are split by their ties, and sorted within a range;
    the sizes of the earlier ranges are added.  The numbered rows are written once, so both uses of them agree.
    """
    order = [*lead, "_v", *ties]
    work = df.withColumn("_v", value.cast("double")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(work.withColumn("_id", F.monotonically_increasing_id()))
    # the number holds the range above its 33 lower bits and the place in it below
    sizes = placed.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (placed.withColumn("_part", F.shiftright("_id", 33)).join(starts, "_part")
            .select(*df.columns, (F.col("_before") + place).alias(name)))


def queue_position(q: DataFrame, priority_rank: Column, time: str = "enqueued_at", job: str = "job_id") -> DataFrame:
    """One more than the number of active jobs ahead: higher priority first, then earlier; equals share a place."""
    waiting = q.where(F.col("is_active")).withColumn("_pr", priority_rank)
    placed = global_rank(waiting, F.unix_micros(F.col(time).cast("timestamp")), lead=["_pr"], ties=[job], name="_place")
    return placed.withColumn("position", F.min("_place").over(W.partitionBy("_pr", time))).drop("_pr", "_place")
