"""Autoregressive models by two-stage least squares, plain and seasonal with covariates."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..base import Keys
from .base import fan_out, grid_table, limit_grid

# fixed values: orders without any dynamics, and orders tried when nothing else is left
DEGENERATE = ((0, 0, 0), (0, 1, 0), (0, 2, 0))
FALLBACK = ((1, 1, 1), (2, 1, 1), (1, 1, 2), (2, 1, 2), (1, 0, 1))


def arima_grid(spark: SparkSession, p=(0, 1, 2), d=(0, 1), q=(0, 1), n: int | None = None) -> DataFrame:
    """Orders without the degenerate ones, simplest first, at most n if given; fallback orders when none remain."""
    orders = [o for o in product(p, d, q) if o not in DEGENERATE] or list(FALLBACK)
    grid = grid_table(spark, [{"p": a, "d": b, "q": c} for a, b, c in orders])
    size = sum((F.get_json_object("cand", f"$.{k}").cast("int") for k in ("p", "d", "q")), F.lit(0))
    return limit_grid(grid, n, complexity=size)


def sarimax_grid(spark: SparkSession, period: int, p=(0, 1, 2), d=(0, 1), q=(0, 1), n: int | None = None) -> DataFrame:
    orders = [o for o in product(p, d, q) if o not in DEGENERATE] or list(FALLBACK)
    grid = grid_table(spark, [{"p": a, "d": b, "q": c, "period": period} for a, b, c in orders])
    size = sum((F.get_json_object("cand", f"$.{k}").cast("int") for k in ("p", "d", "q")), F.lit(0))
    return limit_grid(grid, n, complexity=size)


def _lags(v: np.ndarray, ks: list[int], start: int) -> list[np.ndarray]:
    return [v[start - k:len(v) - k] for k in ks]


def _ridge(x: np.ndarray, y: np.ndarray, lam: float = 1e-6) -> np.ndarray:
    scale = np.maximum(np.sqrt((x * x).mean(axis=0)), 1e-12)
    xs = x / scale
    return np.linalg.solve(xs.T @ xs + lam * len(y) * np.eye(x.shape[1]), xs.T @ y) / scale


def _fit_forecast(w: np.ndarray, ar: list[int], ma: list[int], h: int, x: np.ndarray | None, xf: np.ndarray | None):
    """A long autoregression gives the shocks; then the wanted lags of values and shocks are regressed together."""
    n = len(w)
    long = [*range(1, min(max(2 * max(ar + ma + [1]), 4), n // 4) + 1)] if ma else []
    e = np.zeros(n)
    if ma:
        s = max(long)
        a = np.column_stack([np.ones(n - s), *_lags(w, long, s)])
        e[s:] = w[s:] - a @ _ridge(a, w[s:])
    start = max([0, *ar, *[k + (max(long) if long else 0) for k in ma]])
    if n - start < len(ar) + len(ma) + 3:
        raise ValueError(f"too short: {n} values for lags up to {start}")
    cols = [np.ones(n - start), *_lags(w, ar, start), *_lags(e, ma, start)]
    if x is not None:
        cols += list(x[start:].T)
    a = np.column_stack(cols)
    beta = _ridge(a, w[start:])
    resid = w[start:] - a @ beta
    past, shocks = list(w), [*e[:start], *resid]
    for i in range(h):
        row = [1.0, *[past[-k] for k in ar], *[shocks[-k] for k in ma]]
        if x is not None:
            row += list(xf[i])
        past.append(float(np.dot(row, beta)))
        shocks.append(0.0)
    # response to a unit shock, for the width of the interval
    psi = [1.0]
    for i in range(1, h):
        v = sum(beta[1 + j] * psi[i - k] for j, k in enumerate(ar) if i >= k)
        v += sum(beta[1 + len(ar) + j] for j, k in enumerate(ma) if i == k)
        psi.append(float(v))
    return np.array(past[n:]), np.array(psi), float(np.sqrt(np.mean(resid**2)))


def _difference(y: np.ndarray, lag: int) -> np.ndarray:
    return y[lag:] - y[:-lag]


def _undo(history: np.ndarray, change: np.ndarray, lag: int) -> np.ndarray:
    out = list(history)
    for c in change:
        out.append(out[-lag] + c)
    return np.array(out[len(history):])


def _limit(yhat: np.ndarray, y: np.ndarray) -> None:
    if not np.all(np.isfinite(yhat)) or np.max(np.abs(yhat)) > 1e3 * max(np.max(np.abs(y)), 1e-9):
        raise ValueError("forecast explodes")


def arima_model(y, ds, params, h, x=None, xf=None):
    p, d, q = int(params["p"]), int(params["d"]), int(params["q"])
    levels = [y]
    for _ in range(d):
        levels.append(_difference(levels[-1], 1))
    f, psi, s = _fit_forecast(levels[-1], [*range(1, p + 1)], [*range(1, q + 1)], h, None, None)
    for lvl in reversed(levels[:-1]):
        f, psi = _undo(lvl, f, 1), np.cumsum(psi)
    _limit(f, y)
    return f, s * np.sqrt(np.cumsum(psi**2))


def usable_period(n: int, period: int) -> int:
    """Season a series of n values supports: 52, 26, 13 or none."""
    for m in (period, period // 2, period // 4):
        if m > 1 and n >= 2 * m + 10:
            return m
    return 1


def sarimax_model(y, ds, params, h, x=None, xf=None):
    """Seasonal lags beside the plain ones, and covariates in levels differenced like the target."""
    p, d, q = int(params["p"]), int(params["d"]), int(params["q"])
    m = usable_period(len(y), int(params["period"]))
    w, steps = y, []
    xx, xxf = x, xf
    both = None if x is None else np.vstack([x, xf])
    for lag in [1] * d:
        steps.append((w, lag))
        w = _difference(w, lag)
        both = None if both is None else both[lag:] - both[:-lag]
    if both is not None:
        xx, xxf = both[:len(w)], both[len(w):]
    ar = [*range(1, p + 1)] + ([m] if m > 1 and m > p else [])
    f, psi, s = _fit_forecast(w, ar, [*range(1, q + 1)], h, xx, xxf)
    for lvl, lag in reversed(steps):
        f, psi = _undo(lvl, f, lag), np.cumsum(psi)
    _limit(f, y)
    return f, s * np.sqrt(np.cumsum(psi**2))


def arima(hist: DataFrame, future: DataFrame, keys: Keys, orders: DataFrame) -> DataFrame:
    return fan_out(hist, future, keys, orders, arima_model)


def sarimax(hist: DataFrame, future: DataFrame, keys: Keys, orders: DataFrame, covs=()) -> DataFrame:
    return fan_out(hist, future, keys, orders, sarimax_model, covs)
