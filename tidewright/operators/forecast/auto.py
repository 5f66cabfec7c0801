"""Automatic set: autoregressive, smoothing and theta families, each searched by its corrected information criterion.

The three families of a series advance together in the rounds of one frontier search; the three winners are then
compared by their errors, as criteria of unlike families can't be.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ...session import cut_lineage
from ..base import Keys
from .arima import _lags, arima_model, sarimax_model, usable_period
from .base import fan_out
from .frontier import best_points, frontier_search
from .select import Forecaster
from .smooth import _smooth, ets_model, smoothing_sets

TRENDS, SEASONS, THETAS = ("none", "add", "damped"), ("none", "add", "mul"), (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0)
TOP = 5  # most lags of values, and of shocks
FAMILIES = ("arima", "ets", "theta")
# bounds of the points: (d, p, q, seasonal lag), (trend, season), (theta, season); d is chosen before and stays
BOUNDS = {"arima": ((0, 0, 0, 0), (2, TOP, TOP, 1)), "ets": ((0, 0), (2, 2)), "theta": ((0, 0), (len(THETAS) - 1, 2))}
MOVES = {
    "arima": ((0, 1, 0, 0), (0, 0, 1, 0), (0, 1, 1, 0), (0, 0, 0, 1)),
    "ets": ((1, 0), (0, 1)),
    "theta": ((1, 0), (0, 1)),
}
STARTS = {"arima": ((2, 2, 0), (0, 0, 0), (1, 0, 0), (0, 1, 0)), "ets": ((0, 0), (1, 1)), "theta": ((2, 0), (2, 2), (0, 0))}


def move_table(spark: SparkSession, families=FAMILIES) -> DataFrame:
    """Every move of each family, forth and back, with the family's bounds."""
    rows = [(f, [s * v for v in move], list(BOUNDS[f][0]), list(BOUNDS[f][1])) for f in families for move in MOVES[f] for s in (1, -1)]
    return spark.createDataFrame(rows, "family string, step array<int>, low array<int>, high array<int>")


def aicc(sse: float, n: int, k: int, scale: float) -> float:
    """Corrected criterion of k parameters; errors below rounding count as rounding, so the fewest parameters win among perfect fits."""
    if n - k - 1 < 1:
        raise ValueError(f"too short: {n} values for {k} parameters")
    return n * math.log(max(sse / n, 1e-12 * max(scale, 1e-12))) + 2 * k + 2 * k * (k + 1) / (n - k - 1)


def arima_criterion(y: np.ndarray, point, period: int) -> float:
    """All orders are regressed on the same rows, those after the longest lag, so that their criteria compare."""
    d, p, q, seasonal = point
    m = usable_period(len(y), period)
    if seasonal and m <= p:
        raise ValueError("no season of its own")
    w = np.diff(y, d)
    n, reach = len(w), min(2 * TOP, len(w) // 4)
    start = max(reach + TOP, m if m > 1 else 0)
    if n - start < 3:
        raise ValueError(f"too short: {n} values for lags up to {start}")
    e = np.zeros(n)
    a = np.column_stack([np.ones(n - reach), *_lags(w, [*range(1, reach + 1)], reach)])
    e[reach:] = w[reach:] - a @ np.linalg.lstsq(a, w[reach:], rcond=None)[0]
    ar = [*range(1, p + 1)] + ([m] if seasonal else [])
    a = np.column_stack([np.ones(n - start), *_lags(w, ar, start), *_lags(e, [*range(1, q + 1)], start)])
    left = w[start:] - a @ np.linalg.lstsq(a, w[start:], rcond=None)[0]
    return aicc(float(left @ left), n - start, a.shape[1] + 1, float(np.mean(y * y)))


def ets_criterion(y: np.ndarray, point, period: int) -> float:
    trend, season = TRENDS[point[0]], SEASONS[point[1]]
    m, n = period if season != "none" else 1, len(y)
    if season != "none" and (m < 2 or n < 2 * m):
        raise ValueError(f"needs two seasons of {m} values, has {n}")
    if season == "mul" and np.min(y) <= 0:
        raise ValueError("multiplicative season needs positive values")
    a, b, g = smoothing_sets(trend, season)
    sse = _smooth(y, m, trend, season, a, b, g)[3]
    if not np.isfinite(sse).any():
        raise ValueError("errors are not finite")
    k = 3 + {"none": 0, "add": 2, "damped": 3}[trend] + (m if season != "none" else 0)
    return aicc(float(np.nanmin(np.where(np.isfinite(sse), sse, np.nan))), n, k, float(np.mean(y * y)))


def season_index(y: np.ndarray, m: int, season: str) -> np.ndarray:
    """Phase means against the centred moving average: ratios around one, or differences around zero."""
    if season == "none":
        return np.zeros(1)
    if m < 2 or len(y) < 2 * m:
        raise ValueError(f"needs two seasons of {m} values, has {len(y)}")
    if season == "mul" and np.min(y) <= 0:
        raise ValueError("multiplicative season needs positive values")
    mid = np.convolve(y, np.ones(m) / m, "valid")
    if m % 2 == 0:
        mid = (mid[1:] + mid[:-1]) / 2
    seen = np.full(len(y), np.nan)
    part = y[m // 2:m // 2 + len(mid)]
    seen[m // 2:m // 2 + len(mid)] = part / mid if season == "mul" else part - mid
    index = np.array([np.nanmean(seen[i::m]) for i in range(m)])
    return index / index.mean() if season == "mul" else index - index.mean()


def theta_fit(y: np.ndarray, m: int, theta: float, season: str):
    """Simple smoothing with the share 1 - 1/theta of the linear drift. Result: level, drift, alpha, squared errors, index."""
    n = len(y)
    if n < 4:
        raise ValueError("needs four values")
    index = season_index(y, m, season)
    phase = index[np.arange(n) % len(index)]
    adj, size = (y / phase, phase) if season == "mul" else (y - phase, np.ones(n))
    drift = (1 - 1 / theta) * np.polyfit(np.arange(n), adj, 1)[0]
    a = np.linspace(0.05, 0.95, 19)
    level, sse = np.full(len(a), adj[0]), np.zeros(len(a))
    for t in range(1, n):
        sse += ((adj[t] - level - drift * (1 - (1 - a) ** t) / a) * size[t]) ** 2
        level = a * adj[t] + (1 - a) * level
    j = int(np.argmin(sse))
    return level[j], drift, a[j], float(sse[j]), index


def theta_criterion(y: np.ndarray, point, period: int) -> float:
    theta, season = THETAS[point[0]], SEASONS[point[1]]
    sse = theta_fit(y, period, theta, season)[3]
    k = 3 + (theta > 1) + (period - 1 if season != "none" else 0)
    return aicc(sse, len(y) - 1, k, float(np.mean(y * y)))


CRITERIA: dict[str, Callable] = {"arima": arima_criterion, "ets": ets_criterion, "theta": theta_criterion}


def auto_model(y, ds, params, h, x=None, xf=None):
    """Forecast of one point of one family."""
    family, point, period = params["family"], params["point"], int(params["period"])
    if family == "arima":
        d, p, q, seasonal = point
        order = {"p": p, "d": d, "q": q, "period": period}
        return sarimax_model(y, ds, order, h) if seasonal else arima_model(y, ds, order, h)
    if family == "ets":
        return ets_model(y, ds, {"trend": TRENDS[point[0]], "season": SEASONS[point[1]], "period": period}, h)
    season, n, steps = SEASONS[point[1]], len(y), np.arange(1, h + 1)
    level, drift, a, sse, index = theta_fit(y, period, THETAS[point[0]], season)
    core, ring = level + drift * (steps - 1 + (1 - (1 - a) ** n) / a), index[(n + steps - 1) % len(index)]
    return core * ring if season == "mul" else core + ring, np.sqrt(sse / (n - 1)) * np.sqrt(1 + a * a * (steps - 1))


def pack(hist: DataFrame, keys: Keys) -> DataFrame:
    """``keys, values``: the values of a series in date order, without nulls (a panel has one row per date)."""
    rows = hist.where(F.col("y").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("y")))).alias("_v"))
    return rows.select(*keys, F.transform("_v", lambda r: r["y"]).alias("values"))


def start_points(hist: DataFrame, keys: Keys, families=FAMILIES) -> DataFrame:
    """``keys, family, point``. The autoregressive family differences as often (0 to 2 times) as makes the spread
    least, fewer at ties: criteria of unlike differences don't compare, so this is settled before."""
    keys = list(keys)
    rows = hist.where(F.col("y").isNotNull())
    spark, w = hist.sparkSession, W.partitionBy(*keys).orderBy("ds")
    one = F.col("y") - F.lag("y").over(w)
    two = F.col("y") - 2 * F.lag("y").over(w) + F.lag("y", 2).over(w)
    spread = rows.withColumns({"_1": one, "_2": two}).groupBy(*keys).agg(*[F.stddev_pop(c).alias(n) for n, c in (("_s0", "y"), ("_s1", "_1"), ("_s2", "_2"))])
    first = F.when((F.col("_s1") < F.col("_s0")) & ~(F.col("_s2") < F.col("_s1")), 1).when((F.col("_s2") < F.col("_s0")) & (F.col("_s2") < F.col("_s1")), 2).otherwise(0)
    table = spark.createDataFrame([(f, list(p)) for f in families for p in STARTS[f]], "family string, _p array<int>")
    point = F.when(F.col("family") == "arima", F.concat(F.array("d"), "_p")).otherwise(F.col("_p"))
    return spread.select(*keys, first.alias("d")).crossJoin(F.broadcast(table)).select(*keys, "family", point.alias("point"))  # nine starts a series


def scorer(packed: DataFrame, keys: Keys, period: int) -> Callable[[DataFrame], DataFrame]:
    """Criterion of (keys, family, point) rows; one that can't be fitted gives null and the error."""
    keys = list(keys)

    def score(points: DataFrame) -> DataFrame:
        types = dict(points.dtypes)
        schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["family string, point array<int>, crit double, error string"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                crit, error = [], []
                for family, point, values in zip(batch["family"], batch["point"], batch["values"]):
                    try:
                        v = CRITERIA[family](np.asarray(values, float), [int(i) for i in point], period)
                        if not math.isfinite(v):
                            raise ValueError("criterion is not finite")
                        crit.append(v)
                        error.append(None)
                    except Exception as e:  # the point is out, the search goes on
                        crit.append(None)
                        error.append(f"{type(e).__name__}: {e}"[:200])
                out = batch[[*keys, "family", "point"]].copy()
                yield out.assign(crit=pd.Series(crit, index=out.index, dtype="float64"), error=pd.Series(error, index=out.index, dtype="object"))

        return points.join(packed, keys).select(*keys, "family", "point", "values").mapInPandas(run, schema)

    return score


def auto_search(hist: DataFrame, keys: Keys, period: int, families=FAMILIES) -> DataFrame:
    """Every point tried for every series and family: ``keys, family, point, crit, error, round``."""
    keys = list(keys)
    packed = cut_lineage(pack(hist, keys))
    return frontier_search(start_points(hist, keys, families), [*keys, "family"], move_table(hist.sparkSession, families), scorer(packed, keys, period))


def winner_candidates(tried: DataFrame, keys: Keys, period: int) -> DataFrame:
    """``keys, cand`` of the best point of each family, as ``auto_model`` reads it."""
    best = best_points(tried, [*keys, "family"])
    return best.select(*keys, F.to_json(F.struct("family", F.lit(period).alias("period"), "point")).alias("cand"))


def auto_set(period: int, families=FAMILIES) -> Callable[[DataFrame | None], Forecaster]:
    """Maker of forecasters as the training plan takes them: with None each series is searched and its best point of
    each family forecasts; with winners only those are fitted. The plan then keeps the family of least error."""
    def maker(winners: DataFrame | None) -> Forecaster:
        def forecast(hist: DataFrame, future: DataFrame, keys: Keys) -> DataFrame:
            cands = winner_candidates(auto_search(hist, keys, period, families), keys, period) if winners is None else winners
            return fan_out(hist, future, keys, cands, auto_model)

        return forecast

    return maker
