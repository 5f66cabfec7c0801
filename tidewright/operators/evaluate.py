"""Accuracy, cross-validation, overfitting and batch statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import Keys, bands, join_on_keys, median
from .signals import numbered
from .windows import rank_segments, segment_quality

EPS = 1e-10

# fixed values: eval/train error ratios of the overfit bands, and caps
OVERFIT = ((20.0, "severe"), (10.0, "high"), (5.0, "medium"), (2.0, "low"))
MAX_MAPE = 500.0


def _y() -> Column:
    return F.col("y")


def _p() -> Column:
    return F.col("yhat")


def smape_agg() -> Column:
    """Symmetric error 0..100 over columns y and yhat."""
    e = F.abs(_y() - _p()) / (F.abs(_y()) + F.abs(_p()) + EPS) * 100
    return F.avg(F.least(e, F.lit(100.0)))


def wape_agg() -> Column:
    """Sum of errors over sum of actuals, at most 500; without actuals the mean forecast size stands in."""
    total, err, size = F.sum(F.abs(_y())), F.sum(F.abs(_y() - _p())), F.sum(F.abs(_p()))
    none = F.when(size > EPS, F.least(F.avg(F.abs(_p())) * 100, F.lit(500.0))).otherwise(0.0)
    return F.when(total < EPS, none).otherwise(F.least(err / total * 100, F.lit(500.0)))


def mape_agg() -> Column:
    """Mean percentage error of non-zero actuals (each at most 1000); symmetric when more than a fifth are zero."""
    filled = F.abs(_y()) > EPS
    ape = F.avg(F.when(filled, F.least(F.abs((_y() - _p()) / F.when(filled, _y())) * 100, F.lit(1000.0))))
    n, nz = F.count(F.lit(1)), F.count_if(filled)
    return F.when((nz == 0) | ((n - nz) / n * 100 > 20), smape_agg()).otherwise(ape)


def mape(pairs: DataFrame, keys: Keys) -> DataFrame:
    return pairs.groupBy(*keys).agg(mape_agg().alias("mape"))


def smape(pairs: DataFrame, keys: Keys) -> DataFrame:
    return pairs.groupBy(*keys).agg(smape_agg().alias("smape"))


def wape(pairs: DataFrame, keys: Keys) -> DataFrame:
    return pairs.groupBy(*keys).agg(wape_agg().alias("wape"))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def metrics(pairs: DataFrame, keys: Keys) -> DataFrame:
    """rmse, mape, wape and r2 of finite pairs; groups without any get 0, 100, NULL and 0."""
    ok = _finite(_y()) & _finite(_p())
    rows = pairs.select(*keys, F.when(ok, _y()).alias("y"), F.when(ok, _p()).alias("yhat"))
    d2 = (_y() - _p()) ** 2
    # aggregates skip the NULL pairs; only the row counts have to be those of finite pairs
    n = F.count("y")
    filled = F.abs(_y()) > EPS
    ape = F.avg(F.when(filled, F.least(F.abs((_y() - _p()) / F.when(filled, _y())) * 100, F.lit(1000.0))))
    m = F.when((F.count_if(filled) == 0) | ((n - F.count_if(filled)) / n * 100 > 20), smape_agg()).otherwise(ape)
    out = rows.groupBy(*keys).agg(
        n.alias("n"), F.sqrt(F.avg(d2)).alias("rmse"), F.when(n > 0, m).alias("mape"), F.when(n > 0, wape_agg()).alias("wape"),
        F.sum(d2).alias("_res"), (F.var_pop("y") * n).alias("_tot"))
    r2 = F.when(F.col("_tot") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("_res") / F.col("_tot")))).otherwise(0.0)
    return out.select(
        *keys, "n", F.round(F.coalesce("rmse", F.lit(0.0)), 2).alias("rmse"), F.least(F.round(F.coalesce("mape", F.lit(100.0)), 2), F.lit(MAX_MAPE)).alias("mape"),
        F.round("wape", 2).alias("wape"), F.round(F.coalesce(r2, F.lit(0.0)), 4).alias("r2"))


def holdout_mape(pairs: DataFrame, keys: Keys) -> DataFrame:
    """Mean percentage error, or the median when some but not all errors exceed 500 %."""
    rows = pairs.withColumn("_e", F.abs((_y() - _p()) / (_y() + EPS)) * 100)
    wild, n = F.count_if(F.col("_e") > 500), F.count("_e")
    return rows.groupBy(*keys).agg(
        n.alias("n"), wild.alias("n_extreme"), F.when((wild > 0) & (wild < n), median(F.col("_e"))).otherwise(F.avg("_e")).alias("holdout_mape"))


def fold_table(df: DataFrame, keys: Keys, n_splits: int, h: int, gap: int = 0, min_train: int | None = None) -> DataFrame:
    """Expanding folds per series: ``fold, split_point, test_start, test_end`` in row positions."""
    lens = df.where(F.col("y").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"))
    first = F.lit(min_train) if min_train is not None else F.greatest(F.floor(F.col("n") / 2).cast("int"), F.lit(10))
    lens = lens.withColumn("_first", first).withColumn("_room", F.col("n") - F.col("_first") - gap)
    k = F.when(F.col("_room") < n_splits * h, F.greatest(F.lit(1), F.floor(F.col("_room") / h).cast("int"))).otherwise(F.lit(n_splits))
    lens = lens.withColumn("_k", k).withColumn("_size", F.floor(F.col("_room") / F.col("_k")).cast("int"))
    folds = lens.select("*", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("fold"))
    folds = folds.withColumn("split_point", F.col("_first") + F.col("fold") * F.col("_size"))
    folds = folds.withColumn("test_start", F.col("split_point") + gap)
    folds = folds.withColumn("test_end", F.least(F.col("test_start") + h, F.col("n")))
    return folds.where(F.col("test_end") > F.col("test_start")).select(*keys, "fold", "split_point", "test_start", "test_end")


def cross_validate(df: DataFrame, keys: Keys, forecaster: Callable, n_splits: int = 3, h: int = 1, gap: int = 0) -> DataFrame:
    """Expanding-window scores of any forecaster; the fold is one more key, so all folds run in one job."""
    folds = fold_table(df, keys, n_splits, h, gap)
    rows = join_on_keys(numbered(df, keys), folds, keys)
    ks = [*keys, "fold"]
    train = rows.where(F.col("t") < F.col("split_point")).select(*ks, "ds", "y")
    test = rows.where((F.col("t") >= F.col("test_start")) & (F.col("t") < F.col("test_end"))).select(
        *ks, "ds", "y", (F.col("t") - F.col("test_start") + 1).cast("int").alias("h"))
    fc = forecaster(train, test.drop("y"), ks).where(F.col("yhat").isNotNull())
    pairs = fc.select(*ks, "cand", "h", "yhat").join(test.select(*ks, "h", "y"), [*ks, "h"])
    scores = mape(pairs, [*ks, "cand"])
    out = scores.groupBy(*keys, "cand").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "mape"))), lambda s: s["mape"]).alias("cv_scores"),
        F.round(F.avg("mape"), 2).alias("cv_mape"), F.round(F.stddev_pop("mape"), 2).alias("cv_mape_std"), F.count(F.lit(1)).alias("n_splits"))
    return out


def weighted_cv(folds: DataFrame, keys: Keys, recency: float = 1.5, score: str = "mape") -> DataFrame:
    """Mean and spread of fold scores with weights growing to the later folds."""
    w = W.partitionBy(*keys)
    i = F.row_number().over(w.orderBy("fold")) - 1
    rows = folds.withColumn("_w", 1 + i / F.count(F.lit(1)).over(w) * (recency - 1))
    rows = rows.withColumn("_m", F.sum(F.col("_w") * F.col(score)).over(w) / F.sum("_w").over(w))
    return rows.groupBy(*keys).agg(F.max("_m").alias("weighted_mean"), F.sqrt(F.sum(F.col("_w") * (F.col(score) - F.col("_m")) ** 2) / F.sum("_w")).alias("weighted_std"))


def overfit(m: DataFrame) -> DataFrame:
    """Ratio of eval to train error, its band, and the plain flag above three."""
    base = F.when(F.col("train_mape") <= 0, 0.01).otherwise(F.col("train_mape"))
    out = m.withColumn("overfit_ratio", F.col("eval_mape") / base)
    out = out.withColumn("severity", bands(F.col("overfit_ratio"), OVERFIT, "none"))
    return out.withColumns({"is_overfitting": F.col("severity") != "none",
                            "is_overfit": F.col("eval_mape") / F.greatest("train_mape", F.lit(0.001)) > 3})


def compare_models(m: DataFrame, keys: Keys) -> DataFrame:
    """Models of a series by holdout error with the gap to eval and an overfit warning; rank 1 is best."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("holdout_mape").asc_nulls_last(), "model"))
    out = m.withColumns({
        "mape_difference": F.round(F.col("holdout_mape") - F.col("eval_mape"), 2), "overfit_warning": F.col("holdout_mape") > F.col("eval_mape") * 1.5, "place": place})
    return out.withColumn("is_best", F.col("place") == 1)


def batch_stats(res: DataFrame, status: str = "status") -> DataFrame:
    """Success counts and spread of the error over a batch; the median is the upper middle value."""
    ok = F.col(status) == "success"
    good = res.where(ok & F.col("mape").isNotNull())
    from .windows import global_rank

    n = good.agg(F.count(F.lit(1)).alias("_n"), F.min("mape").alias("min_mape"), F.max("mape").alias("max_mape"), F.avg("mape").alias("mean_mape"))
    ranked = global_rank(good.select("mape"), F.col("mape"))
    mid = ranked.crossJoin(F.broadcast(n)).agg(F.max(F.when(F.col("rank") == F.floor(F.col("_n") / 2) + 1, F.col("mape"))).alias("median_mape"))
    counts = res.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok | F.col(status).isNull()).alias("failed"))
    return counts.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(mid)).drop("_n")


def segment_summary(m: DataFrame, segment: str = "segment") -> DataFrame:
    """Error statistics over segments and how many are good, acceptable and poor."""
    ok = m.where(F.col("mape").isNotNull() & ~F.isnan("mape") & (F.abs("mape") < float("inf")))
    q = segment_quality(F.col("mape"))
    from .quantiles import exact_quantiles

    base = ok.agg(
        F.count(F.lit(1)).alias("total_segments"), F.round(F.avg("mape"), 2).alias("mean_mape"), F.round(F.stddev_pop("mape"), 2).alias("std_mape"),
        F.round(F.min("mape"), 2).alias("min_mape"), F.round(F.max("mape"), 2).alias("max_mape"), F.count_if(q == "good").alias("good"),
        F.count_if(q == "acceptable").alias("acceptable"), F.count_if(q == "poor").alias("poor"))
    mid = exact_quantiles(ok, [], "mape", {"median_mape": 0.5}).select(F.round("median_mape", 2).alias("median_mape"))
    return base.crossJoin(F.broadcast(mid))


__all__ = ["rank_segments", "segment_summary", "batch_stats", "compare_models", "overfit", "weighted_cv", "cross_validate", "fold_table", "holdout_mape",
           "metrics", "mape", "smape", "wape", "mape_agg", "smape_agg", "wape_agg"]
