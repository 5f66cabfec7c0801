"""Filters and projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_numeric
from ..functions.dates import parse_date
from .base import Keys, codes, ordered, series_len


def filter_dimensions(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Scalar means equality, a list means membership; unknown columns are ignored."""
    for c, v in wanted.items():
        if c in df.columns:
            df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def filter_categories(df: DataFrame, filters: Mapping[str, str | None], y: str) -> DataFrame:
    """Text comparison; an empty filter value keeps all rows; rows without target are dropped."""
    out = df.where(F.col(y).isNotNull())
    for c, v in filters.items():
        if v not in (None, ""):
            out = out.where(F.col(c).cast("string") == v)
    return out


def filter_dates(df: DataFrame, ds: str = "ds", from_: str | None = None, to: str | None = None) -> DataFrame:
    """Inclusive range on whole days; no end means up to the last date."""
    day = F.col(ds).cast("date")
    if from_:
        df = df.where(day >= F.lit(from_).cast("date"))
    if to:
        df = df.where(day <= F.lit(to).cast("date"))
    return df


def to_series(df: DataFrame, keys: Keys, ds: str, y: str, covs: Sequence[str] = ()) -> DataFrame:
    """Canonical projection; absent covariates become NULL and the target is never a covariate."""
    kinds = dict(df.dtypes)

    def number(c: str) -> Column:
        return clean_numeric(F.col(c)) if kinds[c] == "string" else F.col(c).cast("double")

    covs = [c for c in covs if c not in (y, "y", ds)]
    return df.select(
        *keys, F.col(ds).cast("date").alias("ds"), number(y).alias("y"),
        *[(number(c) if c in kinds else F.lit(None).cast("double")).alias(c) for c in covs])


def select_segments(df: DataFrame, keys: Keys, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Keep listed series, then drop listed ones.  Join strategy is left to the size seen at run time."""
    if include is not None:
        df = df.join(include.select(*keys).distinct(), list(keys), "left_semi")
    if exclude is not None:
        df = df.join(exclude.select(*keys).distinct(), list(keys), "left_anti")
    return df


def trim_window(df: DataFrame, keys: Keys, n: int) -> DataFrame:
    """Last n observations of each series."""
    rn = F.row_number().over(ordered(keys, F.col("ds").desc()))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def min_rows(df: DataFrame, keys: Keys, n: int) -> DataFrame:
    """Series with at least n rows, counted where they are read."""
    named = [F.col(k).alias(f"_{k}") for k in keys]
    enough = df.groupBy(*named).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(enough, same, "left_semi")


def filter_status(df: DataFrame, statuses: Sequence[str], col: str = "status") -> DataFrame:
    return df.where(F.col(col).isin(list(statuses)))


def validate_input(df: DataFrame, ds: str, y: str, horizon: int) -> DataFrame:
    """One row of counts and codes about a raw table before anything is fitted."""
    target, day = F.col(y), parse_date(F.col(ds))
    any_blank = None
    for c in df.columns:
        blank = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
        any_blank = blank if any_blank is None else any_blank | blank
    num = clean_numeric(target) if dict(df.dtypes)[y] == "string" else target.cast("double")
    out = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(num.isNull()).alias("missing_target"),
        F.count_if(day.isNull()).alias("invalid_dates"),
        F.count_if(any_blank).alias("blank_rows"))
    share = F.coalesce(F.try_divide(F.col("blank_rows"), F.col("n_rows")), F.lit(0.0))
    return out.withColumn("codes", codes(
        (F.col("n_rows") == 0, "no_data"),
        ((F.col("n_rows") > 0) & (F.col("missing_target") == F.col("n_rows")), "no_target"),
        (F.col("missing_target") > 0, "missing_target"),
        (F.col("invalid_dates") > 0, "invalid_dates"),
        ((F.col("n_rows") > 0) & (F.col("n_rows") <= horizon), "insufficient_rows"),
        (share > 0.1, "many_blanks")))
