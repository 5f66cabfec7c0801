"""Ensembles: member filter, weights, blend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import Keys, bands, by
from .checks import _inf, _nan, validate_forecast
from .evaluate import OVERFIT, metrics


def select_members(fc: DataFrame, m: DataFrame, hist: DataFrame, keys: Keys, form: str = "divergence", max_ratio: float = 3.0, max_models: int = 5) -> DataFrame:
    """Every model with ``included`` and the first reason against it.

    ``top``: valid, error within three times the best, the five best.  ``divergence``: bounds valid too, level
    within six times history, not severely overfitted, and mean forecast within half to one and a half of the
    median of members (from three members on, when two remain).
    """
    mk = [*keys, "model"]
    second = form == "divergence"
    val = validate_forecast(fc, hist, mk, keys, 2 * max_ratio if second else 10.0).select(*mk, "is_valid")
    cols = [c for c in ("yhat", "yhat_lower", "yhat_upper") if c in fc.columns]
    bad = None
    for c in cols:
        b = F.bool_or(_nan(F.col(c)) | _inf(F.col(c)) | (F.abs(c) > 1e30)) | F.bool_and(F.col(c) == 0)
        bad = b if bad is None else bad | b
    shape = fc.groupBy(*mk).agg(F.avg("yhat").alias("_mean"), bad.alias("_bad"))
    rows = m.join(val, mk, "left").join(shape, mk, "left")
    no_error = F.col("mape").isNull() | F.isnan("mape") | _inf(F.col("mape"))
    invalid = F.coalesce(~F.col("is_valid"), F.lit(True)) | (F.coalesce(F.col("_bad"), F.lit(True)) if second else F.lit(False))
    severe = F.lit(False)
    if second and "train_mape" in m.columns:
        base = F.when(F.col("train_mape") <= 0, 0.01).otherwise(F.col("train_mape"))
        severe = F.coalesce(bands(F.col("mape") / base, OVERFIT, "none") == "severe", F.lit(False))
    rows = rows.withColumn("reason", F.when(invalid, "invalid_forecast").when(no_error, "no_error").when(severe, "severe_overfit"))
    w = by(keys)
    best = F.min(F.when(F.col("reason").isNull(), F.col("mape"))).over(w)
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("mape") > best * max_ratio, "far_from_best")))
    live = F.col("reason").isNull()
    if second:
        rows = rows.withColumns({"_k": F.count_if(live).over(w), "_med": F.percentile(F.when(live, F.col("_mean")), F.lit(0.5)).over(w)})
        share = F.when(F.col("_med") != 0, F.col("_mean") / F.col("_med")).otherwise(1.0)
        off = live & (F.col("_k") >= 3) & ~share.between(0.5, 1.5)
        rows = rows.withColumn("_off", off)
        left = F.col("_k") - F.count_if("_off").over(w)
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("_off") & (left >= 2), "diverges")))
    else:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("reason").isNotNull(), "mape", "model"))
        rows = rows.withColumn("_p", place).withColumn("reason", F.coalesce("reason", F.when(F.col("_p") > max_models, "beyond_limit")))
    return rows.select(*mk, "mape", F.col("reason").isNull().alias("included"), "reason")


def ensemble_weights(m: DataFrame, keys: Keys, method: str = "inverse_mape", min_weight: float = 0.05, max_weight: float = 0.40) -> DataFrame:
    """Weights per model: raw by method, floored, normalised, then capped and normalised up to ten times."""
    rows = m.where((F.col("mape") > 0) & ~F.isnan("mape") & (F.col("mape") < float("inf"))).select(*keys, "model", "mape")
    w = by(keys)
    n = F.count(F.lit(1)).over(w)
    raw = {
        "equal": 1.0 / n, "inverse_mape": 1.0 / (F.col("mape") + 1e-10), "inverse_mape_squared": 1.0 / (F.col("mape") + 1e-10) ** 2,
        "softmax": F.exp(-F.col("mape") / F.avg("mape").over(w)),
        "rank": (n - F.row_number().over(W.partitionBy(*keys).orderBy("mape", "model")) + 1).cast("double"),
    }.get(method)
    if raw is None:
        raise ValueError(f"unknown method {method}")
    members = rows.withColumn("_w", F.greatest(raw, F.lit(min_weight))).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("model", "_w"))).alias("_m"))  # as many as there are models

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def scaled(a):
        t = total(a)
        return F.transform(a, lambda x: x / t)

    def cap(a, _):
        return F.when((F.size(a) > 1) & F.exists(a, lambda x: x > max_weight), scaled(F.transform(a, lambda x: F.least(x, F.lit(max_weight))))).otherwise(a)

    first = scaled(F.transform("_m", lambda x: x["_w"]))
    final = F.aggregate(F.sequence(F.lit(1), F.lit(10)), first, cap) if max_weight < 1 else first
    return members.select(*keys, F.inline(F.arrays_zip(F.transform("_m", lambda x: x["model"]).alias("model"), final.alias("weight")))).toDF(*keys, "model", "weight")


def simple_weights(m: DataFrame, keys: Keys, min_weight: float = 0.05) -> DataFrame:
    """Inverse error, normalised, floored, normalised again."""
    w = by(keys)
    rows = m.withColumn("_i", 1.0 / F.greatest("mape", F.lit(0.001)))
    rows = rows.withColumn("_i", F.greatest(F.col("_i") / F.sum("_i").over(w), F.lit(min_weight)))
    return rows.select(*keys, "model", (F.col("_i") / F.sum("_i").over(w)).alias("weight"))


def ensemble(fc: DataFrame, weights: DataFrame, keys: Keys) -> DataFrame:
    """Weighted forecast and bounds per step, not negative, upper not under the value; a lone member passes unchanged."""
    rows = fc.join(weights, [*keys, "model"]).where(F.col("weight") > 0)
    extra = [c for c in ("y",) if c in fc.columns]
    cols = ("yhat", "yhat_lower", "yhat_upper")
    out = rows.groupBy(*keys, "h", "ds").agg(
        *[F.sum(F.col("weight") * F.col(c)).alias(c) for c in cols], *[F.max(c).alias(c) for c in extra], F.count(F.lit(1)).alias("n_members"))
    many = F.col("n_members") > 1
    out = out.withColumns({c: F.when(many, F.greatest(F.col(c), F.lit(0.0))).otherwise(F.col(c)) for c in ("yhat", "yhat_lower")})
    return out.withColumn("yhat_upper", F.when(many, F.greatest("yhat_upper", "yhat")).otherwise(F.col("yhat_upper")))


def ensemble_metrics(fc: DataFrame, weights: DataFrame, keys: Keys) -> DataFrame:
    """Metrics of the blend over validation rows (with y)."""
    return metrics(ensemble(fc, weights, keys), keys)
