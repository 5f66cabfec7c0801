"""Preparation: filter, aggregate, repair, log scale, lag fill, regressor admission."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import aggregate_series, covariate_aggs
from .base import Keys, by, join_on_keys, position, series_len
from .filters import filter_dimensions
from .quality import validate_quality
from .windows import drop_incomplete_tail


def prepare(df: DataFrame, ds: str, y: str, dims: Keys = (), how: str = "sum", filters: Mapping[str, object] | None = None,
            freq: str = "weekly", covs: Sequence[str] = (), detect_tail: bool = True) -> tuple[DataFrame, DataFrame]:
    """Filter, aggregate, drop the unfinished tail, validate and repair: ``(series with covariates, report)``."""
    rows = filter_dimensions(df, filters or {})
    extra = covariate_aggs(rows, [c for c in covs if c in df.columns and c != y], "sum")
    panel = aggregate_series(rows, ds, y, dims, how, extra)
    if detect_tail:
        panel = drop_incomplete_tail(panel, dims)
    clean, report = validate_quality(panel.select(*dims, "ds", "y"), dims, freq)
    if extra:
        clean = clean.join(panel.select(*dims, "ds", *extra), [*dims, "ds"], "left")
    return clean, report


def log_flags(df: DataFrame, keys: Keys, mode: str = "auto") -> DataFrame:
    """Which series get the log scale: 52 or more values, none negative, and for ``auto`` both over tenfold
    level change and over 500 % growth between halves."""
    rows = df.select(*keys, F.col("y"), position(keys).alias("t"), series_len(keys).alias("n"))
    n, t = F.col("n"), F.col("t")
    k = F.least(n, F.lit(52))
    half = F.floor(n / 2)
    out = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), F.avg(F.when(t >= n - k, F.col("y"))).alias("recent"), F.avg(F.when(t < k, F.col("y"))).alias("early"),
        F.avg(F.when(t < half, F.col("y"))).alias("first"), F.avg(F.when(t >= n - half, F.col("y"))).alias("second"),
        F.coalesce(F.bool_or(F.col("y") < 0), F.lit(False)).alias("negative"))
    early = F.when(n > 52, F.col("early")).otherwise(F.col("recent"))
    ratio = F.greatest("recent", early) / F.greatest(F.least("recent", early), F.lit(1.0))
    grown = F.when(F.col("first") > 0, (F.col("second") - F.col("first")) / F.col("first") * 100).otherwise(0.0)
    want = {"never": F.lit(False), "always": F.lit(True), "auto": (ratio > 10) & (grown > 500)}[mode]
    return out.select(*keys, ratio.alias("magnitude_ratio"), grown.alias("growth_pct"), ((n >= 52) & ~F.col("negative") & want).alias("log_applied"))


def log_transform(df: DataFrame, keys: Keys, mode: str = "auto") -> DataFrame:
    """History on log scale where :func:`log_flags` says so; ``log_applied`` tells which."""
    out = join_on_keys(df, log_flags(df, keys, mode).select(*keys, "log_applied"), keys, "left")
    return out.withColumn("y", F.when(F.col("log_applied"), F.log1p("y")).otherwise(F.col("y")))


def inverse_log(fc: DataFrame, cols: Sequence[str] = ("yhat", "yhat_lower", "yhat_upper", "y")) -> DataFrame:
    """Values back to the original scale where ``log_applied`` holds."""
    return fc.withColumns({c: F.when(F.col("log_applied"), F.expm1(c)).otherwise(F.col(c)) for c in cols if c in fc.columns})


def fill_lags_from_train(df: DataFrame, keys: Keys, cols: Sequence[str], split: str = "split") -> DataFrame:
    """Missing lags become the mean of the series' train rows, or 0: evaluation rows do not leak into it."""
    def filled(c: str) -> Column:
        train = F.avg(F.when(F.col(split) == "train", F.col(c))).over(by(keys))
        return F.coalesce(F.col(c), train, F.lit(0.0))

    return df.withColumns({c: filled(c) for c in cols})


def admit_regressors(df: DataFrame, keys: Keys, cols: Sequence[str], min_share: float = 0.5, split: str = "split") -> DataFrame:
    """Filled share of every regressor in the train rows of each series, and whether it is admitted."""
    train = df.where(F.col(split) == "train").groupBy(*keys).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols])
    per = F.array(*[F.struct(F.lit(c).alias("regressor"), F.col(c).alias("filled_share")) for c in cols])
    return train.select(*keys, F.inline(per)).withColumn("admitted", F.col("filled_share") >= min_share)


def split_future(df: DataFrame, covs: Sequence[str], y: str = "y") -> tuple[DataFrame, DataFrame]:
    """``(history, future rows)``: future rows lack the target and carry a covariate."""
    known = None
    for c in covs:
        known = F.col(c).isNotNull() if known is None else known | F.col(c).isNotNull()
    future = F.col(y).isNull() & known
    return df.where(~future), df.where(future)
