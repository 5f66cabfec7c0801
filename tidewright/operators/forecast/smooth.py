"""Exponential smoothing and theta."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..base import Keys
from .base import fan_out, grid_table, steps_sigma

# fixed values: forms tried, without trend and season none is left out because it is flat
FORMS = (("add", "add"), ("add", "mul"), ("add", "none"), ("none", "add"), ("none", "mul"))
ALPHAS, BETAS, GAMMAS = (0.1, 0.3, 0.5, 0.8), (0.01, 0.1, 0.3), (0.05, 0.2, 0.4)
DAMPING = 0.9  # of what is left of a damped trend, a period


def smoothing_sets(trend: str, season: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameter sets of a form; what it lacks is not smoothed."""
    sets = np.array(list(product(ALPHAS, BETAS if trend != "none" else (0.0,), GAMMAS if season != "none" else (0.0,))))
    return sets[:, 0], sets[:, 1], sets[:, 2]


def _smooth(y: np.ndarray, m: int, trend: str, season: str, a: np.ndarray, b: np.ndarray, g: np.ndarray):
    """Run all parameter sets side by side: one pass over time, vectors over the sets."""
    k, n = len(a), len(y)
    level = np.full(k, y[:m].mean() if season != "none" else y[0])
    slope = np.zeros(k)
    damp = DAMPING if trend == "damped" else 1.0
    if trend == "mul":  # a factor a period, so its rest is 1
        slope += (y[m:2 * m].mean() / y[:m].mean()) ** (1 / m) if season != "none" and n >= 2 * m else (y[min(n, 10) - 1] / y[0]) ** (1 / max(min(n, 10) - 1, 1))
    elif trend != "none" and n > 1:
        slope += (y[m:2 * m].mean() - y[:m].mean()) / m if season != "none" and n >= 2 * m else (y[min(n, 10) - 1] - y[0]) / max(min(n, 10) - 1, 1)
    base = y[:m] - level[0] if season == "add" else y[:m] / level[0] if season == "mul" else np.zeros(m)
    s = np.tile(base, (k, 1))
    sse = np.zeros(k)
    for t in range(n):
        i = t % m
        core = level * slope if trend == "mul" else level + damp * slope
        fit = core + s[:, i] if season == "add" else core * s[:, i] if season == "mul" else core
        sse += (y[t] - fit) ** 2
        seen = y[t] - s[:, i] if season == "add" else y[t] / np.where(s[:, i] == 0, 1e-9, s[:, i]) if season == "mul" else y[t]
        new = a * seen + (1 - a) * core
        if trend == "mul":
            slope = b * new / np.where(level == 0, 1e-9, level) + (1 - b) * slope
        elif trend != "none":
            slope = b * (new - level) + (1 - b) * damp * slope
        if season == "add":
            s[:, i] = g * (y[t] - new) + (1 - g) * s[:, i]
        elif season == "mul":
            s[:, i] = g * y[t] / np.where(new == 0, 1e-9, new) + (1 - g) * s[:, i]
        level = new
    return level, slope, s, sse


def ets_model(y, ds, params, h, x=None, xf=None):
    """Holt-Winters of one form; smoothing parameters by least squares over a small grid.

    Trend: none, add, damped or mul (a factor a period); ``damped`` true makes an added trend a damped one.
    """
    trend, season, m = params["trend"], params["season"], int(params["period"])
    if trend == "add" and str(params.get("damped", "false")).lower() == "true":
        trend = "damped"
    n = len(y)
    if season != "none" and n < 2 * m:
        raise ValueError(f"needs {2 * m} values for the season, has {n}")
    if season == "mul" and np.min(y) <= 0:
        raise ValueError("multiplicative season needs positive values")
    if trend == "mul" and np.min(y) <= 0:
        raise ValueError("multiplicative trend needs positive values")
    if season == "none":
        m = 1
    a, b, g = smoothing_sets(trend, season)
    level, slope, s, sse = _smooth(y, m, trend, season, a, b, g)
    j = int(np.nanargmin(np.where(np.isfinite(sse), sse, np.inf)))
    steps = np.arange(1, h + 1)
    core = level[j] * slope[j]**steps if trend == "mul" else level[j] + slope[j] * (np.cumsum(DAMPING**steps) if trend == "damped" else steps)
    ring = s[j][(n + steps - 1) % m]
    yhat = core + ring if season == "add" else core * ring if season == "mul" else core
    sigma = np.sqrt(sse[j] / n) * np.sqrt(1 + a[j] ** 2 * (steps - 1))
    return yhat, sigma


def ets_grid(spark: SparkSession, period: int, forms=FORMS) -> DataFrame:
    return grid_table(spark, [{"trend": t, "season": s, "period": period} for t, s in forms])


def ets(hist: DataFrame, future: DataFrame, keys: Keys, grid: DataFrame) -> DataFrame:
    """All forms of all series."""
    return fan_out(hist, future, keys, grid, ets_model)


def theta_model(y, ds, params, h, x=None, xf=None):
    """Seasonally adjusted simple smoothing plus half the linear drift."""
    m, n = int(params["period"]), len(y)
    if n < 3:
        raise ValueError("needs three values")
    index = np.ones(m)
    if n >= 2 * m and m > 1 and np.min(y) > 0:
        c = y - y.mean()
        if abs(float(c[m:] @ c[:-m]) / float(c @ c or 1.0)) > 1.645 / np.sqrt(n):
            kernel = np.ones(m) / m
            mid = np.convolve(y, kernel, "valid")
            if m % 2 == 0:
                mid = (mid[1:] + mid[:-1]) / 2
            off = m // 2
            ratio = np.full(n, np.nan)
            ratio[off:off + len(mid)] = y[off:off + len(mid)] / mid
            index = np.array([np.nanmean(ratio[i::m]) for i in range(m)])
            index = index / index.mean()
    adj = y / index[np.arange(n) % m]
    slope = np.polyfit(np.arange(n), adj, 1)[0]
    alphas = np.linspace(0.05, 0.95, 19)
    level, _, _, sse = _smooth(adj, 1, "none", "none", alphas, np.zeros(19), np.zeros(19))
    j = int(np.argmin(sse))
    a, steps = alphas[j], np.arange(1, h + 1)
    core = level[j] + slope / 2 * (steps - 1 + (1 - (1 - a) ** n) / a)
    return core * index[(n + steps - 1) % m], steps_sigma(np.sqrt(sse[j] / n), h) * a + np.sqrt(sse[j] / n) * (1 - a)


def theta(hist: DataFrame, future: DataFrame, keys: Keys, period: int) -> DataFrame:
    return fan_out(hist, future, keys, grid_table(hist.sparkSession, [{"period": period}]), theta_model)


