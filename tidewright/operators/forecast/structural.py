"""Regression on trend, Fourier season, holiday windows and covariates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..base import Keys
from ..calendar import WINDOWS, holiday_windows, years_of
from .base import fan_out, grid_table, limit_grid, rms

# fixed values: parameter lists of the full grid
GRID = {
    "growth": ("linear", "flat"), "mode": ("additive", "multiplicative"),
    "trend_flexibility": (0.01, 0.05, 0.1, 0.5), "season_flexibility": (0.1, 1.0, 10.0),
}
KNOTS = 12


def holiday_columns(df: DataFrame, ds: str = "ds", weekly: bool = True) -> DataFrame:
    """One 0/1 column per holiday: the effect window touches the day, or for weekly rows one of its seven days.

    The day table covers the years of the data and one either side (some 5 days for 13 holidays a year), so it is broadcast.
    """
    days = holiday_windows(years_of(df, ds, 1)).select("holiday", "day")
    if weekly:
        days = days.select("holiday", F.explode(F.sequence(F.date_sub("day", 6), F.col("day"))).alias("day"))
    names = days.groupBy(F.col("day").alias(ds)).agg(F.collect_set("holiday").alias("_hol"))
    out = df.join(F.broadcast(names), ds, "left")
    return out.select(*df.columns, *[F.coalesce(F.array_contains("_hol", n), F.lit(False)).cast("double").alias(f"hol_{n}") for n in WINDOWS])


HOLIDAY_COLS = tuple(f"hol_{n}" for n in WINDOWS)


def structural_grid(spark: SparkSession, freq: str, n: int | None = None, seed: int = 42, grid=GRID) -> DataFrame:
    return limit_grid(grid_table(spark, {**grid, "freq": (freq,)}), n, seed)


# parameters that change the columns or the target; candidates that differ in the others share their sums
DESIGN = ("growth", "mode", "freq", "yearly", "weekly")


def _season(ds: pd.Series, params, years: float) -> np.ndarray:
    """Waves of the year and of the week.  ``yearly`` and ``weekly`` may say true or false; else frequency and length decide."""
    day = (ds - pd.Timestamp("2000-01-01")).dt.days.to_numpy(float)
    freq = params["freq"]
    usual = {"yearly": freq == "monthly" or years >= 1, "weekly": freq == "daily"}
    wanted = {k: {"true": True, "false": False}.get(str(params.get(k, "auto")).lower(), v) for k, v in usual.items()}
    cols = []
    if wanted["yearly"]:
        cols += [f(2 * np.pi * k * day / 365.25) for k in range(1, 6) for f in (np.sin, np.cos)]
    if wanted["weekly"]:
        cols += [f(2 * np.pi * k * day / 7) for k in range(1, 4) for f in (np.sin, np.cos)]
    return np.column_stack(cols) if cols else np.zeros((len(ds), 0))


class _Sums:
    """Columns of a design and the sums of products that all its penalties share."""

    def __init__(self, y, ds, params, h, x, xf):
        self.log = params["mode"] == "multiplicative"
        if self.log and np.min(y) <= 0:
            raise ValueError("multiplicative mode needs positive values")
        n = len(y)
        self.n, self.h = n, h
        target = np.log(y) if self.log else y
        self.mean, self.scale = target.mean(), max(float(target.std()), 1e-9)
        self.z = (target - self.mean) / self.scale
        t = np.arange(n + h) / max(n - 1, 1)
        cols, kind = [np.ones(n + h)], ["level"]
        if params["growth"] == "linear":
            cols.append(t)
            kind.append("slope")
            if n > 3 * KNOTS:
                cols += [np.maximum(t - k, 0) for k in np.linspace(0, 0.8, KNOTS + 2)[1:-1]]
                kind += ["knot"] * KNOTS
        season = _season(ds, params, (ds.iloc[n - 1] - ds.iloc[0]).days / 365.25)
        cols += list(season.T)
        kind += ["season"] * season.shape[1]
        if x is not None:
            every = np.vstack([x, xf])
            sd = x.std(axis=0)
            keep = sd > 1e-12  # a covariate that never changes in history says nothing
            cols += list(((every - x.mean(axis=0))[:, keep] / sd[keep]).T)
            kind += ["covariate"] * int(keep.sum())
        self.a, self.kind = np.nan_to_num(np.column_stack(cols)), kind
        past = self.a[:n]
        self.xx, self.xy = past.T @ past + 1e-9 * np.eye(len(kind)), past.T @ self.z

    def solve(self, params) -> tuple[np.ndarray, np.ndarray]:
        penalty = {"level": 0.0, "slope": 1e-3, "knot": 0.05 / float(params["trend_flexibility"]),
                   "season": 0.1 / float(params["season_flexibility"]), "covariate": 0.1}
        beta = np.linalg.solve(self.xx + np.diag([penalty[k] for k in self.kind]), self.xy)
        fit = self.a @ beta
        sd = rms(self.z - fit[:self.n]) * self.scale
        f = fit[self.n:] * self.scale + self.mean
        widen = np.sqrt(1 + np.arange(1, self.h + 1) / self.n)
        if self.log:
            f = np.exp(f)
            return f, f * sd * widen
        return f, sd * widen


def structural_family(y, ds, candidates, h, x=None, xf=None) -> list:
    """Ridge regressions whose penalties follow the flexibilities; multiplicative means additive on log scale.

    One result a candidate, or the exception of its design; the sums of a design are made once for all its penalties.
    """
    made: dict[tuple, _Sums | Exception] = {}
    out = []
    for params in candidates:
        design = tuple(str(params.get(k)) for k in DESIGN)
        if design not in made:
            try:
                made[design] = _Sums(y, ds, params, h, x, xf)
            except Exception as e:  # noqa: BLE001 - becomes the row of each candidate of the design
                made[design] = e
        sums = made[design]
        try:
            out.append(sums if isinstance(sums, Exception) else sums.solve(params))
        except Exception as e:  # noqa: BLE001 - a candidate that can't be solved leaves the others alone
            out.append(e)
    return out


def structural_model(y, ds, params, h, x=None, xf=None):
    """One candidate of the family."""
    (r,) = structural_family(y, ds, [params], h, x, xf)
    if isinstance(r, Exception):
        raise r
    return r


def structural(hist: DataFrame, future: DataFrame, keys: Keys, grid: DataFrame, covs=(), weekly: bool = True) -> DataFrame:
    """All candidates of all series, with holiday windows as columns computed by Spark.

    A series travels once a design (four in the full grid of 48), not once a candidate.
    """
    return fan_out(holiday_columns(hist, weekly=weekly), holiday_columns(future, weekly=weekly), keys, grid, structural_family,
                   [*HOLIDAY_COLS, *covs], share=DESIGN)
