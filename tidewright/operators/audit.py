"""Forecasts against actuals: per period, per series, per segment, and what the errors have in common."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import Keys, bands, codes
from .columns import kinds
from .setops import worst_periods

# fixed values: error limits of the bands, weekday names
BANDS = ((5.0, "excellent"), (10.0, "good"), (15.0, "acceptable"), (25.0, "review"))
BAND_NAMES = ("excellent", "good", "acceptable", "review", "significant_deviation")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
YES = ("1", "true", "yes", "y")


def error_band(mape: Column) -> Column:
    return bands(mape, BANDS, "significant_deviation", "le")


def audit_periods(fc: DataFrame, act: DataFrame, keys: Keys, hist: DataFrame | None = None, covs: Sequence[str] = ()) -> DataFrame:
    """Matched periods with error, percent error, band, weekday and the flags switched on that day.

    Actuals of one date are summed.  A zero actual counts as 100 % unless zero was forecast.
    """
    total = act.where(F.col("y").isNotNull() & ~F.isnan("y")).groupBy(*keys, "ds").agg(F.sum("y").alias("actual"))
    rows = fc.select(*keys, "ds", F.col("yhat").alias("predicted")).join(total, [*keys, "ds"])
    a, p = F.col("actual"), F.col("predicted")
    pct = F.when(a != 0, (a - p) / F.when(a != 0, a) * 100).when(p != 0, 100.0).otherwise(0.0)
    rows = rows.withColumns({"error": a - p, "abs_error": F.abs(a - p), "pct_error": pct})
    rows = rows.withColumn("mape", F.abs("pct_error"))
    names = F.array(*[F.lit(w) for w in WEEKDAYS])
    rows = rows.withColumns({
        "status": error_band(F.col("mape")), "is_weekend": F.weekday("ds") >= 5, "weekday": F.element_at(names, F.weekday("ds") + 1)})
    if hist is None or not covs:
        return rows.withColumn("flags", F.array().cast("array<string>"))
    types = kinds(hist)

    def on(c: str) -> Column:
        if types[c] == "boolean":
            return F.col(c)
        return F.lower(F.trim(c)).isin(*YES) if types[c] == "string" else F.col(c) == 1

    flags = codes(*[(F.coalesce(on(c), F.lit(False)), c) for c in covs])
    context = hist.groupBy(*keys, "ds").agg(*[F.max(c).alias(c) for c in covs]).select(*keys, "ds", flags.alias("flags"))
    out = rows.join(context, [*keys, "ds"], "left")
    return out.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def audit_summary(cmp: DataFrame, keys: Keys) -> DataFrame:
    """Volume-weighted error, RMSE, bias and how many periods fall in each band."""
    total = F.sum(F.abs("actual"))
    return cmp.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"), F.when(total > 0, F.sum("abs_error") / total * 100).otherwise(0.0).alias("overall_mape"),
        F.sqrt(F.avg(F.col("error") ** 2)).alias("overall_rmse"), F.avg("error").alias("overall_bias"),
        *[F.count_if(F.col("status") == b).alias(f"n_{b}") for b in BAND_NAMES])


def audit_cli(fc: DataFrame, act: DataFrame, keys: Keys, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Plain comparison: ``(one row of mean error, RMSE, bias; the n worst periods)``."""
    rows = fc.select(*keys, "ds", "yhat").join(act.select(*keys, "ds", F.col("y").alias("actual")), [*keys, "ds"])
    rows = rows.withColumn("error", F.col("actual") - F.col("yhat"))
    rows = rows.withColumn("mape", F.abs(F.try_divide(F.col("error"), F.col("actual")) * 100))
    total = rows.agg(F.count(F.lit(1)).alias("n_periods"), F.avg("mape").alias("mape"), F.sqrt(F.avg(F.col("error") ** 2)).alias("rmse"), F.avg("error").alias("bias"))
    return total, worst_periods(rows, n, "mape", [*keys, "ds"])


def match_segments(fc: DataFrame, act: DataFrame, keys: Keys) -> DataFrame:
    """Actuals summed per segment and date with their forecast, NULL where there is none."""
    total = act.where(F.col("y").isNotNull() & ~F.isnan("y")).groupBy(*keys, "ds").agg(F.sum("y").alias("actual"))
    return total.join(fc.select(*keys, "ds", "yhat"), [*keys, "ds"], "left")


def scorecard(fc: DataFrame, act: DataFrame, training: DataFrame, keys: Keys) -> DataFrame:
    """Error, bias and RMSE per segment over matched periods with a non-zero actual; without any the training error stays.

    Segments without actuals are left out.  ``training`` holds keys, mape and rmse.
    """
    m = match_segments(fc, act, keys)
    hit = F.col("yhat").isNotNull() & (F.col("actual") != 0)
    e = F.when(hit, F.col("actual") - F.col("yhat"))
    agg = m.groupBy(*keys).agg(
        F.count_if(hit).alias("periods"), F.avg(F.when(hit, F.abs(e / F.when(hit, F.col("actual"))) * 100)).alias("_m"), F.avg(e).alias("_b"), F.sqrt(F.avg(e * e)).alias("_r"))
    out = agg.join(training.select(*keys, F.col("mape").alias("train_mape"), F.col("rmse").alias("_tr")), list(keys))
    out = out.select(*keys, "train_mape", F.coalesce("_m", "train_mape").alias("actual_mape"), F.coalesce("_r", "_tr", F.lit(0.0)).alias("actual_rmse"),
                     F.coalesce("_b", F.lit(0.0)).alias("actual_bias"), "periods")
    return out.withColumn("status", error_band(F.col("actual_mape")))


def scorecard_total(score: DataFrame) -> DataFrame:
    """Overall error weighted by matched periods, and segments per band."""
    n = F.sum("periods")
    return score.agg(
        F.count(F.lit(1)).alias("total_segments"), F.when(n > 0, F.sum(F.col("actual_mape") * F.col("periods")) / n).otherwise(0.0).alias("overall_mape"),
        *[F.count_if(F.col("status") == b).alias(f"n_{b}") for b in BAND_NAMES])


def diagnose(score: DataFrame) -> DataFrame:
    """One row of statistics over the scorecard and the codes of what stands out."""
    total = score.agg(F.sum("periods").alias("_p"), F.sum(F.col("actual_mape") * F.col("periods")).alias("_mp")).select(
        F.when(F.col("_p") > 0, F.col("_mp") / F.col("_p")).otherwise(0.0).alias("_overall"))
    rows = score.crossJoin(F.broadcast(total))
    m, b, r = F.col("actual_mape"), F.col("actual_bias"), F.col("actual_rmse")
    drift = m - F.coalesce("train_mape", F.lit(0.0))
    seen = F.col("periods") > 0
    s = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max("_overall").alias("overall_mape"), F.avg(b).alias("avg_bias"), F.stddev_pop(b).alias("bias_std"),
        F.count_if(b > 0).alias("_pos"), F.count_if(b < 0).alias("_neg"), F.sqrt(F.avg((m - F.col("_overall")) ** 2)).alias("mape_std"), F.avg(drift).alias("avg_drift"),
        F.count_if(m > 20).alias("n_high"), F.count_if(m > 30).alias("_over30"), F.count_if((m > 15) & (m <= 30)).alias("_mid"), F.count_if(F.abs(drift) > 10).alias("_drifted"),
        F.count_if(~seen).alias("n_no_match"), F.count_if(seen).alias("n_matched"), F.count_if(F.col("status").isin("review", "significant_deviation")).alias("_problem"),
        F.count_if(seen & (r > 0) & (F.abs(b) > r * 0.7)).alias("_biased"))
    n, k, some = F.col("n"), F.col("_pos") + F.col("_neg"), F.col("n_matched") > 0
    s = s.withColumn("bias_ratio", F.when(k > 0, F.col("_pos") / k).otherwise(0.5))
    q = F.col("bias_ratio")
    trouble = (F.col("_problem") > 0) | (F.col("n_no_match") > 0)
    grave = F.col("_problem") > n * 0.3
    found = codes(
        (trouble & grave, "error:summary"), (trouble & ~grave, "warning:summary"), (F.col("n_no_match") > 0, "error:no_overlap"),
        (some & (q > 0.65) & (k >= 3), "warning:under_forecasting"), (some & (q < 0.35) & (k >= 3), "warning:over_forecasting"),
        (some & (F.col("mape_std") > 12) & (n >= 3), "warning:inconsistent"), (some & (F.col("_over30") > 0), "error:major_deviations"),
        (some & (F.col("_over30") == 0) & (F.col("_mid") > n * 0.3), "warning:moderate_deviations"),
        (some & (F.col("avg_drift") > 8) & (F.col("_drifted") > 0), "warning:worse_than_training"), (some & (F.col("avg_drift") < -8), "info:better_than_training"),
        (some & (F.col("_biased") > F.col("n_matched") * 0.3) & (F.col("_biased") >= 2), "info:systematic_errors"))
    return s.select("n", "overall_mape", "avg_bias", "bias_std", "bias_ratio", "mape_std", "avg_drift", "n_high", "n_no_match", "n_matched",
                    F.when(F.size(found) == 0, F.array(F.lit("info:strong"))).otherwise(found).alias("findings"))


def accuracy(pairs: DataFrame, keys: Keys) -> DataFrame:
    """100 minus the mean percentage error of pairs where both values are positive."""
    ok = pairs.where((F.col("y") > 0) & (F.col("yhat") > 0))
    return ok.groupBy(*keys).agg(F.round(100 - F.avg(F.abs((F.col("y") - F.col("yhat")) / F.col("y")) * 100), 1).alias("accuracy"))


# fixed values: quality tiers of a model by its error
TIERS = ((5.0, "excellent"), (10.0, "good"), (15.0, "acceptable_with_caution"), (25.0, "needs_improvement"))
RISK = ((5.0, "low"), (10.0, "low_medium"), (15.0, "medium"), (25.0, "high"))


def performance_report(cmp: DataFrame, best: DataFrame, keys: Keys) -> DataFrame:
    """Numbers of a report: success and failure rates, bias direction, five worst periods, quality tier and risk.

    ``cmp`` comes from :func:`audit_periods`, ``best`` holds the error of the chosen model per series.
    """
    s = audit_summary(cmp, keys)
    good = F.col("n_excellent") + F.col("n_good") + F.col("n_acceptable")
    s = s.withColumns({"success_rate": good / F.col("n_periods") * 100, "failure_rate": (F.col("n_periods") - good) / F.col("n_periods") * 100,
                       "bias_direction": F.when(F.col("overall_bias") > 0, "under_forecasting").otherwise("over_forecasting")})
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("mape"), "ds"))
    worst = cmp.withColumn("_p", place).where(F.col("_p") <= 5).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", F.col("ds").cast("string").alias("d")))), lambda x: x["d"]).alias("worst_periods"))
    out = s.join(worst, list(keys)).join(best.select(*keys, F.col("mape").alias("model_mape")), list(keys))
    m = F.col("model_mape")
    return out.withColumns({"quality": bands(m, TIERS, "critical", "le"), "risk": bands(m, RISK, "very_high", "le")})
