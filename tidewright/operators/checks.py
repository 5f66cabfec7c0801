"""Checks of finished forecasts.  ``keys`` are those of a forecast (series and model), ``hkeys`` those of its history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import Keys, codes, join_on_keys, ordered
from .windows import fill

INF = float("inf")


def _inf(c: Column) -> Column:
    return F.coalesce(F.abs(c) == INF, F.lit(False))


def _nan(c: Column) -> Column:
    """Missing or not a number."""
    return c.isNull() | F.isnan(c)


def _ok(c: Column) -> Column:
    return ~_nan(c) & ~_inf(c)


def history_stats(hist: DataFrame, hkeys: Keys) -> DataFrame:
    """Mean, spread, range and last values of the filled history, as the checks need them."""
    rows = hist.where(_ok(F.col("y"))).select(*hkeys, "ds", F.col("y").cast("double").alias("y"))
    back = F.row_number().over(ordered(hkeys, F.desc("ds")))
    rows = rows.select("*", back.alias("_b"), (F.col("y") - F.lag("y").over(ordered(hkeys))).alias("_d"), F.count(F.lit(1)).over(W.partitionBy(*hkeys)).alias("_n"))
    six = F.least(F.col("_n"), F.lit(6))
    out = rows.groupBy(*hkeys).agg(
        F.count(F.lit(1)).alias("hist_n"), F.avg("y").alias("hist_mean"), F.stddev_pop("y").alias("hist_std"), F.min("y").alias("hist_min"), F.max("y").alias("hist_max"),
        F.max("ds").alias("hist_end"), F.max(F.when(F.col("_b") == 1, F.col("y"))).alias("last_y"), F.max(F.when(F.col("_b") == six, F.col("y"))).alias("_six"),
        F.stddev_pop("_d").alias("hist_vol"))
    trend = F.when(F.col("hist_n") > 1, (F.col("last_y") - F.col("_six")) / F.least(F.col("hist_n"), F.lit(6))).otherwise(0.0)
    return out.withColumn("recent_trend", trend).withColumn("hist_vol", F.when(F.col("hist_n") > 1, F.col("hist_vol")).otherwise(F.col("hist_std"))).drop("_six")


def validate_forecast(fc: DataFrame, hist: DataFrame, keys: Keys, hkeys: Keys, max_ratio: float = 10.0) -> DataFrame:
    """Invalid when not finite, extreme, far from the history's mean, flat, zero or mostly negative; milder signs warn."""
    p = F.col("yhat")
    stat = fc.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_nan(p)).alias("n_nan"), F.count_if(_inf(p)).alias("n_inf"), F.max(F.abs(p)).alias("max_abs"),
        F.avg(p).alias("pred_mean"), F.stddev_pop(p).alias("pred_std"), F.bool_and(p == 0).alias("zeros"), F.count_if(p < 0).alias("n_neg"))
    out = join_on_keys(stat, history_stats(hist, hkeys).select(*hkeys, "hist_mean", "hist_std"), hkeys, "left")
    ratio = F.when(F.col("hist_mean") != 0, F.col("pred_mean") / F.col("hist_mean")).otherwise(INF)
    out = out.withColumn("mean_ratio", ratio)
    broken = (F.col("n_nan") > 0) | (F.col("n_inf") > 0)
    r, sound = F.col("mean_ratio"), ~broken
    high, low = r > max_ratio, r < 1 / max_ratio
    neg = (F.col("hist_mean") > 0) & (F.col("n_neg") > 0)
    most = F.col("n_neg") > F.col("n") * 0.5
    flat = F.col("pred_std") < 1e-6
    out = out.withColumn("issues", codes(
        (F.col("n_nan") > 0, "nan"), (F.col("n_inf") > 0, "infinite"), (sound & (F.col("max_abs") > 1e30), "extreme"), (sound & high, "too_high"), (sound & low, "too_low"),
        (sound & flat, "flat"), (sound & F.col("zeros"), "all_zero"), (sound & neg & most, "mostly_negative")))
    out = out.withColumn("warnings", codes(
        (sound & ~high & ~low & ((r > 3) | (r < 0.33)), "unusual_level"), (sound & ~flat & (F.col("pred_std") < F.col("hist_std") * 0.01), "low_variance"), (sound & neg & ~most, "some_negative")))
    return out.select(*keys, (F.size("issues") == 0).alias("is_valid"), "mean_ratio", "pred_std", "issues", "warnings")


def validate_intervals(fc: DataFrame, keys: Keys) -> DataFrame:
    """Order of bounds, width beyond ten times the forecast, missing and infinite bounds."""
    lo, hi, p = F.col("yhat_lower"), F.col("yhat_upper"), F.col("yhat")
    wide = (hi - lo) / F.abs(p + 1e-10) > 10
    # NaN compares as the largest value here, while a comparison with it should not hold
    num = ~_nan(lo) & ~_nan(hi) & ~_nan(p)
    s = fc.groupBy(*keys).agg(
        F.count_if(num & (lo > p)).alias("low_above"), F.count_if(num & (hi < p)).alias("high_below"), F.count_if(num & (lo > hi)).alias("crossed"),
        F.count_if(num & wide).alias("wide"), F.count_if(_nan(lo) | _nan(hi)).alias("nan"), F.count_if(_inf(lo) | _inf(hi)).alias("inf"))
    issues = codes(*[(F.col(c) > 0, c) for c in ("low_above", "high_below", "crossed", "wide", "nan", "inf")])
    return s.select(*keys, issues.alias("issues")).withColumn("is_valid", F.size("issues") == 0)


def validate_output(fc: DataFrame, hist: DataFrame, keys: Keys, hkeys: Keys, h: int) -> DataFrame:
    """Length, start after history, finite values, signs, order and width of bounds."""
    p, lo, hi = F.col("yhat"), F.col("yhat_lower"), F.col("yhat_upper")
    num = ~_nan(p)
    s = fc.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("horizon"), F.min("ds").alias("start"), F.count_if(_nan(p)).alias("n_nan"), F.count_if(_inf(p)).alias("n_inf"),
        F.count_if(num & (p < 0)).alias("n_neg"), F.count_if(num & (lo > p)).alias("low_above"), F.count_if(num & (hi < p)).alias("high_below"),
        F.avg(hi - lo).alias("width"), F.min(F.when(num, p)).alias("min_yhat"), F.max(F.when(num, p)).alias("max_yhat"), F.avg(F.when(num, p)).alias("mean_yhat"))
    ends = hist.groupBy(*hkeys).agg(F.max("ds").alias("hist_end"))
    s = join_on_keys(s, ends, hkeys, "left")
    issues = codes((F.col("start") <= F.col("hist_end"), "starts_in_history"), (F.col("n_nan") > 0, "nan"), (F.col("n_inf") > 0, "infinite"))
    warn = codes((F.col("horizon") != h, "wrong_length"), (F.col("n_neg") > 0, "negative"), (F.col("low_above") > 0, "low_above"), (F.col("high_below") > 0, "high_below"),
                 (F.col("width") <= 0, "no_width"))
    return s.select(*keys, "horizon", "min_yhat", "max_yhat", "mean_yhat", issues.alias("issues"), warn.alias("warnings")).withColumn("is_valid", F.size("issues") == 0)


def _ends(fc: DataFrame, keys: Keys) -> DataFrame:
    p = F.col("yhat")
    rows = fc.where(~_nan(p)).withColumn("_d", p - F.lag(p).over(ordered(keys, "h")))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("fc_mean"), F.stddev_pop(p).alias("fc_std"), F.var_pop(p).alias("fc_var"), F.min(p).alias("fc_min"), F.max(p).alias("fc_max"),
        F.min_by(p, "h").alias("first_fc"), F.max_by(p, "h").alias("last_fc"), F.stddev_pop("_d").alias("fc_vol"), F.count_distinct(F.round(p, 4)).alias("unique_values"))


def reasonableness(fc: DataFrame, hist: DataFrame, keys: Keys, hkeys: Keys, max_change: float = 5.0) -> DataFrame:
    """Mean within five times of the history's, no jump over half at the start, spread between a tenth and three times."""
    s = join_on_keys(_ends(fc, keys), history_stats(hist, hkeys), hkeys, "left")
    ratio = F.when(F.col("hist_mean") != 0, F.col("fc_mean") / F.col("hist_mean"))
    jump = F.when(F.col("last_y") != 0, F.abs(F.col("first_fc") - F.col("last_y")) / F.abs("last_y"))
    spread = F.when(F.col("hist_std") > 0, F.col("fc_std") / F.col("hist_std"))
    bad = (ratio > max_change) | (ratio < 1 / max_change)
    return s.select(*keys, ratio.alias("change_ratio"), jump.alias("boundary_jump"), spread.alias("std_ratio"), (~F.coalesce(bad, F.lit(False))).alias("is_reasonable"),
                    codes((bad, "mean_level"), (jump > 0.5, "boundary_jump"), ((spread > 3) | (spread < 0.1), "variability")).alias("concerns"))


def flat_forecast(fc: DataFrame, hist: DataFrame, keys: Keys, hkeys: Keys) -> DataFrame:
    """Is the forecast constant, or nearly so beside its history, and why."""
    s = join_on_keys(_ends(fc.where(_ok(F.col("yhat"))), keys), history_stats(hist, hkeys).select(*hkeys, "hist_std", "hist_n"), hkeys, "left")
    hv = F.when(F.col("hist_n") > 1, F.col("hist_std") ** 2).otherwise(1.0)
    ratio = F.when(hv > 0, F.col("fc_var") / hv).otherwise(0.0)
    u, n = F.col("unique_values"), F.col("n")
    why = (F.when(n < 2, None).when(F.col("fc_var") < 1e-6, "zero_variance").when((hv > 0) & (ratio < 0.01), "low_variance_ratio").when(u == 1, "identical")
           .when((n > 5) & (u <= 2), "few_values"))
    return s.select(*keys, F.col("fc_var").alias("forecast_variance"), ratio.alias("variance_ratio"), "unique_values", why.alias("flat_reason"), why.isNotNull().alias("is_flat"))


def forecast_anomalies(fc: DataFrame, hist: DataFrame, keys: Keys, hkeys: Keys) -> DataFrame:
    """One row per finding: type, severity and how many periods it concerns."""
    h = history_stats(hist, hkeys)
    rows = join_on_keys(fc.where(~_nan(F.col("yhat"))), h, hkeys)
    p = F.col("yhat")
    edge = 2 * F.col("hist_std")
    marks = rows.groupBy(*keys).agg(
        F.count_if(p > F.col("hist_max") + edge).alias("n_high"), F.count_if(p < F.col("hist_min") - edge).alias("n_low"), F.count_if(p < 0).alias("n_neg"))
    s = join_on_keys(join_on_keys(_ends(fc, keys), h, hkeys), marks, keys)
    jump = F.when(F.col("last_y") != 0, F.abs(F.col("first_fc") - F.col("last_y")) / F.abs("last_y") * 100).otherwise(0.0)
    rt, n = F.col("recent_trend"), F.col("n")
    ft = (F.col("last_fc") - F.col("first_fc")) / n
    turn = ((rt > 0) & (ft < -F.abs(rt) * 0.5)) | ((rt < 0) & (ft > F.abs(rt) * 0.5))
    found = [
        (F.col("n_high") > 0, "out_of_range_high", F.lit("warning"), F.col("n_high")),
        ((F.col("n_low") > 0) & (F.col("n_neg") > 0), "negative_values", F.lit("critical"), F.col("n_neg")),
        ((F.col("n_low") > 0) & (F.col("n_neg") == 0), "out_of_range_low", F.lit("warning"), F.col("n_low")),
        (jump > 30, "sudden_jump", F.when(jump < 50, "warning").otherwise("critical"), F.lit(1)),
        ((n > 2) & (F.col("fc_vol") > F.col("hist_vol") * 2), "high_volatility", F.lit("info"), n),
        ((n > 3) & turn & (F.abs(rt) > F.col("hist_std") * 0.1), "trend_reversal", F.lit("info"), n),
        ((n > 2) & (F.col("fc_max") - F.col("fc_min") < F.col("hist_std") * 0.1), "flat_forecast", F.lit("info"), n)]
    per = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(t).alias("type"), sev.alias("severity"), k.cast("bigint").alias("n_periods"))) for c, t, sev, k in found]))
    return s.select(*keys, F.inline(per))


def clip_forecast(fc: DataFrame, floor: float = 0.0) -> DataFrame:
    """Values and lower bounds not under the floor, upper bounds not under the value."""
    f = F.lit(floor)
    out = fc.withColumns({c: F.greatest(F.col(c), f) for c in ("yhat", "yhat_lower") if c in fc.columns})
    return out.withColumn("yhat_upper", F.greatest("yhat_upper", "yhat")) if "yhat_upper" in fc.columns else out


def sanitize_forecast(fc: DataFrame, keys: Keys, floor: float = 0.0, cols: tuple[str, ...] = ("yhat", "yhat_lower", "yhat_upper")) -> DataFrame:
    """Not finite values are filled forward, then backward, then 0; then all are clipped at the floor."""
    cols = tuple(c for c in cols if c in fc.columns)
    rows = fc.withColumns({c: F.when(_ok(F.col(c)), F.col(c)) for c in cols})
    return fill(rows, keys, cols, constant=0.0).withColumns({c: F.greatest(F.col(c), F.lit(floor)) for c in cols})


# fixed order of overfit bands
SEVERITY = ("none", "low", "medium", "high", "severe")


def acceptance(m: DataFrame, max_mape: float = 50.0, max_severity: str = "high") -> DataFrame:
    """Gate of a model: valid forecast, error under the limit, overfit band at most the given one, a run id."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    checks = {
        "predictions_valid": F.col("is_valid"), "mape_reasonable": F.coalesce(F.col("mape") < max_mape, F.lit(False)),
        "no_severe_overfitting": place <= SEVERITY.index(max_severity) + 1, "has_run_id": F.col("run_id").isNotNull()}
    out = m.withColumns(checks)
    return out.withColumns({
        "accepted": F.col("predictions_valid") & F.col("mape_reasonable") & F.col("no_severe_overfitting") & F.col("has_run_id"),
        "reasons": codes(*[(~F.col(c), c) for c in checks])})
