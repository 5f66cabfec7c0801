"""Explanation of forecasts in numbers and codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import Keys, bands, by, codes, join_on_keys, position, series_len
from .quality import fingerprint

# fixed values: name parts of holiday-like covariates
HOLIDAY_WORDS = ("holiday", "thanksgiving", "christmas", "easter", "black_friday", "super_bowl", "new_years", "july4", "labor", "memorial", "halloween",
                 "valentines", "mothers_day", "fathers_day", "_week", "_day", "_window", "weeks_to_", "days_to_", "days_since_")


def holiday_effect(impacts: DataFrame, keys: Keys) -> DataFrame:
    """Sum of the sizes of holiday-like covariate impacts per series (``covariate``, ``mean_impact``)."""
    hit = F.lower("covariate").rlike("|".join(HOLIDAY_WORDS))
    return impacts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(hit, F.abs("mean_impact"))), F.lit(0.0)).alias("holiday_total"))


def decompose_forecast(fc: DataFrame, keys: Keys, effect: DataFrame | None = None) -> DataFrame:
    """Base (mean), trend (slope times position), seasonal (rest) and holiday (spread evenly) of every step."""
    w = by(keys)
    rows = fc.select("*", position(keys, "h").alias("_i"), series_len(keys).alias("_n"))
    slope = F.coalesce(F.when(F.col("_n") > 1, F.regr_slope("yhat", "_i").over(w)), F.lit(0.0))
    rows = rows.withColumns({"base": F.avg("yhat").over(w), "trend": slope * F.col("_i")})
    rows = rows.withColumn("seasonal", F.col("yhat") - F.col("base") - F.col("trend"))
    if effect is None:
        return rows.withColumn("holiday", F.lit(0.0)).drop("_i", "_n")
    rows = join_on_keys(rows, effect.select(*keys, "holiday_total"), keys, "left")
    return rows.withColumn("holiday", F.coalesce(F.col("holiday_total") / F.col("_n"), F.lit(0.0))).drop("_i", "_n", "holiday_total")


def component_totals(parts: DataFrame, keys: Keys) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.round(F.sum(c), 2).alias(f"total_{c}") for c in ("base", "trend", "seasonal", "holiday")])


def mape_confidence(mape: Column) -> Column:
    return F.when(mape <= 5, "high").when(mape <= 10, "medium").otherwise("low")


def confidence(rows: DataFrame) -> DataFrame:
    """Score .4 accuracy + .3 history + .2 quality + .1 holiday coverage, and its level."""
    acc = bands(F.col("mape"), [(1, 100.0), (3, 90.0), (5, 75.0), (10, 50.0)], 25.0, "le")
    hist = bands(F.col("history_months"), [(36, 100.0), (24, 80.0), (12, 60.0)], 30.0)
    out = rows.withColumns({"accuracy_score": acc, "history_score": hist})
    raw = F.col("accuracy_score") * 0.4 + F.col("history_score") * 0.3 + F.col("data_quality_score") * 0.2 + F.col("holiday_coverage") * 0.1
    # rounding away the last bits keeps a score of exactly 80 or 60 on its side
    raw = F.round(raw, 9)
    return out.withColumns({"confidence_score": F.round(raw, 1), "confidence_level": bands(raw, [(80, "high"), (60, "medium")], "low")})


def forecast_summary(fc: DataFrame, best: DataFrame, keys: Keys) -> DataFrame:
    """Total, direction of the second half against the first, and confidence from the error."""
    rows = fc.select("*", position(keys, "h").alias("_i"), series_len(keys).alias("_n"))
    half = F.floor(F.col("_n") / 2)
    s = rows.groupBy(*keys).agg(
        F.max("_n").alias("horizon"), F.sum("yhat").alias("total"), F.avg(F.when(F.col("_i") < half, F.col("yhat"))).alias("_a"), F.avg(F.when(F.col("_i") >= half, F.col("yhat"))).alias("_b"))
    pct = F.when((F.col("horizon") >= 2) & (F.col("_a") != 0), (F.col("_b") - F.col("_a")) / F.col("_a") * 100).otherwise(0.0)
    s = s.withColumn("trend_pct", pct)
    s = s.withColumn("direction", F.when(F.col("trend_pct") > 1, "increasing").when(F.col("trend_pct") < -1, "decreasing").otherwise("stable"))
    out = join_on_keys(s.drop("_a", "_b"), best.select(*keys, "mape"), keys)
    return out.withColumn("confidence", mape_confidence(F.col("mape")))


def caveats(rows: DataFrame) -> DataFrame:
    """What to keep in mind: short history, thin holiday coverage, error over 10 %, and always continuity."""
    return rows.withColumn("caveats", codes((F.col("history_months") < 24, "short_history"), (F.col("holiday_coverage") < 70, "holiday_coverage"),
                                            (F.col("mape") > 10, "accuracy"), (F.lit(True), "patterns_continue")))


def config_hash(config: Mapping[str, object]) -> Column:
    """First 16 characters of the SHA-256 of a configuration with sorted keys and lists."""
    def text(v: object) -> str:
        return ",".join(sorted(map(str, v))) if isinstance(v, (list, tuple, set)) else str(v)

    return F.substring(F.sha2(F.lit(":".join(f"{k}={text(config[k])}" for k in sorted(config))), 256), 1, 16)


def audit_row(df: DataFrame, config: Mapping[str, object], version: str = "1.0", seed: int = 42) -> DataFrame:
    """Data hash, configuration hash, seed and the token made of them: same token, same result."""
    out = fingerprint(df).withColumnRenamed("hash", "data_hash").withColumns({"config_hash": config_hash(config), "random_seed": F.lit(seed), "model_version": F.lit(version)})
    return out.withColumn("token", F.concat_ws(":", "data_hash", "config_hash", "model_version"))


def selection_findings(m: DataFrame, keys: Keys) -> DataFrame:
    """Winner, runner-up, gap between holdout and eval, overfitted losers and the first three, per series."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("holdout_mape").asc_nulls_last(), "model"))
    rows = m.withColumns({"_p": place, "_over": F.col("holdout_mape") > F.col("eval_mape") * 1.5})

    def at(i: int, c: str) -> Column:
        return F.max(F.when(F.col("_p") == i, F.col(c)))

    s = rows.groupBy(*keys).agg(
        at(1, "model").alias("best_model"), at(1, "holdout_mape").alias("best_holdout"), at(1, "eval_mape").alias("best_eval"), at(2, "model").alias("runner_up"),
        at(2, "holdout_mape").alias("runner_up_mape"), F.count(F.lit(1)).alias("n_models"),
        F.array_sort(F.collect_list(F.when(F.col("_over"), F.col("model")))).alias("_o"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_p") <= 3, F.struct("_p", "model")))), lambda x: x["model"]).alias("top3"))
    gap = F.col("best_holdout") - F.col("best_eval")
    s = s.withColumn("gap", gap)
    losers = F.when(F.array_contains("_o", F.col("best_model")), F.array().cast("array<string>")).otherwise(F.col("_o"))
    return s.withColumns({"gap_note": F.when(F.col("gap") > 5, "overfit_to_eval").when(F.col("gap") < -2, "generalises"), "overfit_models": losers}).drop("_o")
