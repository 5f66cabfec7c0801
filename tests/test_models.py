"""Forecasters: recovery of known series, brute-force twins, failure rows, selection."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators.evaluate import cross_validate, metrics
from tidewright.operators.forecast import arima as AR
from tidewright.operators.forecast import auto as AU
from tidewright.operators.forecast import base as B
from tidewright.operators.forecast import boosted as BO
from tidewright.operators.forecast import grids as GR
from tidewright.operators.forecast import naive as NV
from tidewright.operators.forecast import smooth as SM
from tidewright.operators.forecast import structural as ST
from tidewright.operators.forecast.frontier import best_points, frontier_search, search_report
from tidewright.operators.forecast.ladder import climb
from tidewright.operators.signals import _adf_p, _kpss_p, forecastability, spectral_entropy
from tidewright.plans.profile import profile
from tidewright.plans.train import train_models, weekly_naive_ranking

K = ["series"]
RNG = np.random.RandomState(42)
SINE = 100 + 30 * np.sin(2 * np.pi * np.arange(156) / 52)
LINE = 50 + 2.0 * np.arange(120)


def dates(n):
    return pd.Series(pd.date_range("2021-01-04", periods=n, freq="7D"))


def test_naive_repeats_a_period(spark, series):
    df = series(a=list(SINE))
    got = [r.yhat for r in NV.seasonal_naive(df, K, 60).orderBy("h").collect()]
    assert got == pytest.approx([SINE[156 - 52 + (i % 52)] for i in range(60)])


def test_naive_drift_on_a_line(spark, series):
    got = [r.yhat for r in NV.seasonal_naive(series(a=list(LINE)), K, 3, drift=True).orderBy("h").collect()]
    assert got == pytest.approx([LINE[-1] + 2, LINE[-1] + 4, LINE[-1] + 6])


def scalar_holt_winters(y, m, trend, season, a, b, g):
    """The same recursion for one parameter set, one value at a time."""
    level = np.mean(y[:m]) if season != "none" else y[0]
    slope = 0.0
    if trend == "add":
        slope = (np.mean(y[m:2 * m]) - np.mean(y[:m])) / m if season != "none" else (y[min(len(y), 10) - 1] - y[0]) / max(min(len(y), 10) - 1, 1)
    s = [y[i] - level if season == "add" else y[i] / level if season == "mul" else 0.0 for i in range(m)]
    sse = 0.0
    for t, v in enumerate(y):
        i, core = t % m, level + slope
        fit = core + s[i] if season == "add" else core * s[i] if season == "mul" else core
        sse += (v - fit) ** 2
        seen = v - s[i] if season == "add" else v / s[i] if season == "mul" else v
        new = a * seen + (1 - a) * core
        if trend == "add":
            slope = b * (new - level) + (1 - b) * slope
        if season == "add":
            s[i] = g * (v - new) + (1 - g) * s[i]
        elif season == "mul":
            s[i] = g * v / new + (1 - g) * s[i]
        level = new
    return level, slope, s, sse


@pytest.mark.parametrize("trend,season", SM.FORMS)
def test_ets_against_scalar_recursion(trend, season):
    m = 12 if season != "none" else 1
    y = 200 + np.arange(72) + 20 * np.sin(2 * np.pi * np.arange(72) / 12) + RNG.normal(0, 3, 72)
    sets = [(a, b, g) for a in SM.ALPHAS for b in (SM.BETAS if trend == "add" else (0.0,)) for g in (SM.GAMMAS if season != "none" else (0.0,))]
    best = min((scalar_holt_winters(y, m, trend, season, *p) for p in sets), key=lambda r: r[3])
    level, slope, s, sse = best
    want = []
    for h in range(1, 7):
        core, ring = level + slope * h, s[(72 + h - 1) % m]
        want.append(core + ring if season == "add" else core * ring if season == "mul" else core)
    yhat, sigma = SM.ets_model(y, dates(78), {"trend": trend, "season": season, "period": 12}, 6)
    assert yhat == pytest.approx(want)
    assert sigma[0] == pytest.approx(np.sqrt(sse / 72))


def test_theta_follows_a_line():
    yhat, _ = SM.theta_model(LINE, dates(126), {"period": 52}, 6)
    assert np.all(np.diff(yhat) > 0.8) and yhat[0] > LINE[-1] - 3


def test_arima_recovers_autoregression():
    y = np.zeros(600)
    for t in range(1, 600):
        y[t] = 5 + 0.7 * y[t - 1] + RNG.normal(0, 0.5)
    yhat, sigma = AR.arima_model(y, dates(620), {"p": 1, "d": 0, "q": 0}, 20)
    x = np.column_stack([np.ones(599), y[:-1]])
    c, phi = np.linalg.lstsq(x, y[1:], rcond=None)[0]
    want, last = [], y[-1]
    for _ in range(20):
        last = c + phi * last
        want.append(last)
    assert yhat == pytest.approx(want, rel=1e-4)
    assert np.all(np.diff(sigma) > 0) and phi == pytest.approx(0.7, abs=0.08)


def test_arima_grid(spark):
    got = [r.cand for r in AR.arima_grid(spark).collect()]
    assert len(got) == 10 and got[:6] == [r.cand for r in AR.arima_grid(spark, n=6).collect()]
    assert not any('"p": 0' in c and '"q": 0' in c for c in got)
    assert len(AR.arima_grid(spark, p=(0,), d=(0, 1), q=(0,)).collect()) == len(AR.FALLBACK)


def test_sarimax_uses_its_covariate():
    x = (np.arange(150) % 9 == 0).astype(float)
    y = 100 + 40 * x + RNG.normal(0, 1, 150)
    f, _ = AR.sarimax_model(y[:140], dates(150), {"p": 1, "d": 0, "q": 0, "period": 52}, 10, x[:140, None], x[140:, None])
    assert np.corrcoef(f, x[140:])[0, 1] > 0.95


def test_structural_recovers_trend_and_season():
    t = np.arange(208)
    y = 500 + 5 * t + 50 * np.sin(2 * np.pi * (t * 7) / 365.25)
    f, sd = ST.structural_model(y[:196], dates(208), {"growth": "linear", "mode": "additive", "freq": "weekly", "trend_flexibility": 0.05, "season_flexibility": 10.0}, 12)
    assert np.max(np.abs(f - y[196:]) / y[196:]) < 0.03 and np.all(sd >= 0)


def test_failed_group_becomes_a_row(spark, series):
    def picky(y, ds, params, h, x=None, xf=None):
        if y[0] < 0:
            raise ValueError("negative start")
        return np.full(h, y[-1]), np.ones(h)

    df = series(good=[1, 2, 3], bad=[-1, 2, 3])
    out = B.fan_out(df, B.future_frame(df, K, 2, "weekly"), K, B.grid_table(spark, [{}]), picky).collect()
    assert {r.series: r.error for r in out}["bad"].startswith("ValueError") and sum(r.error is None for r in out) == 2


def test_future_dates_keep_the_anchor(spark, series):
    got = [str(r.ds) for r in B.future_frame(series(a=[1, 2, 3]), K, 2, "weekly").orderBy("h").collect()]
    assert got == ["2021-01-25", "2021-02-01"]


def test_cross_validation_folds(spark, series):
    r = cross_validate(series(a=list(SINE)), K, NV.naive_forecaster, 3, 12).first()
    assert r.n_splits == 3 and r.cv_mape < 1e-6


def test_training_plan_picks_the_right_model(spark, series):
    def maker(model, grid):
        return lambda winners: B.registered(model, grid if winners is None else winners)

    def last(y, ds, params, h, x=None, xf=None):
        return np.full(h, y[-1]), np.ones(h)

    out = train_models(series(line=list(LINE), other=list(LINE * 3)), K, "weekly", 8, {
        "theta": maker(SM.theta_model, B.grid_table(spark, [{"period": 52}])), "last": maker(last, B.grid_table(spark, [{}])),
        "structural": maker(ST.structural_model, B.grid_table(spark, [{"growth": g, "mode": "additive", "freq": "weekly", "trend_flexibility": 0.05, "season_flexibility": 1.0} for g in ("linear", "flat")]))})
    fc = out["forecast"].collect()
    assert {r.model for r in fc} == {"structural"} and len(fc) == 16
    assert all('"linear"' in r.cand for r in fc)
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in fc)
    got = sorted((r.h, r.yhat) for r in fc if r.series == "line")
    assert [v for _, v in got] == pytest.approx([LINE[-1] + 2 * h for h, _ in got], rel=0.02)


def test_boosted_learns_the_season(spark, series):
    df = series(a=list(SINE), b=list(SINE * 4))
    fc = BO.boosted(df, B.future_frame(df, K, 8, "weekly"), K, "weekly", 8, n_trees=15, depth=4).collect()
    assert len(fc) == 16 and all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in fc)
    want = {h: 100 + 30 * np.sin(2 * np.pi * (156 + h - 1) / 52) for h in range(1, 9)}
    for r in fc:
        assert r.yhat / (4 if r.series == "b" else 1) == pytest.approx(want[r.h], rel=0.15)


def test_short_series_are_not_lost(spark, series):
    df = series(long=list(SINE), short=list(SINE[:36]), one=[5.0])

    def maker(model, grid):
        return lambda winners: B.registered(model, grid if winners is None else winners)

    out = train_models(df, K, "weekly", 8, {"ets": maker(SM.ets_model, SM.ets_grid(spark, 52)), "theta": maker(SM.theta_model, B.grid_table(spark, [{"period": 52}]))})
    rows = out["forecast"].collect()
    assert {s: sum(r.series == s and r.yhat is not None for r in rows) for s in ("long", "short", "one")} == {"long": 8, "short": 8, "one": 0}
    assert [r.error is not None for r in rows if r.series == "one"] == [True] and len(rows) == 17
    assert {r.series for r in weekly_naive_ranking(df, K, 8).collect()} == {"long", "short", "one"}
    fc = BO.boosted(df, B.future_frame(df, K, 4, "weekly"), K, "weekly", 4, n_trees=5, depth=3).collect()
    assert sorted({(r.series, r.h) for r in fc}) == [(s, h) for s in ("long", "one", "short") for h in range(1, 5)]
    assert all(r.yhat is not None for r in fc)


def test_naive_forecaster_of_any_horizon(spark, series):
    df = series(a=list(SINE), b=list(SINE[:20]))
    got = NV.naive_forecaster(df, B.future_frame(df, K, 500, "weekly"), K).collect()
    same = {(r.series, r.h): r.yhat for r in NV.seasonal_naive(df, K, 500).collect()}
    assert len(got) == 1000 and all(r.yhat == pytest.approx(same[r.series, r.h]) for r in got)


def test_holidays_of_distant_years(spark):
    df = spark.sql("SELECT explode(array(DATE'1940-12-23', DATE'2024-12-23', DATE'2110-12-22')) AS ds")
    rows = ST.holiday_columns(df).collect()
    assert len(rows) == 3 and all(sum(v for k, v in r.asDict().items() if k.startswith("hol_")) > 0 for r in rows)


def test_profile_counts_all_outliers(spark, series):
    y = [100.0 + i % 7 for i in range(300)]
    y[::10] = [10_000.0] * 30
    assert profile(series(a=y), K, "weekly").first()["n_outliers"] == 30


def test_metric_pairs(spark):
    df = spark.createDataFrame([(100.0, 102.0), (110.0, 108.0), (120.0, 122.0), (130.0, 128.0), (140.0, 142.0)], "y double, yhat double")
    r = metrics(df, []).first()
    ape = np.mean([2 / 100, 2 / 110, 2 / 120, 2 / 130, 2 / 140]) * 100
    assert (r.rmse, r.mape) == (2.0, round(ape, 2)) and r.r2 == pytest.approx(0.98, abs=1e-6)
    empty = metrics(df.where(F.lit(False)), []).first()
    assert (empty.rmse, empty.mape, empty.r2) == (0.0, 100.0, 0.0)


def test_entropy_and_scores_are_ordered(spark, series):
    noise = 100 + RNG.normal(0, 20, 156)
    df = series(sine=list(SINE), noise=list(noise))
    e = {r.series: r.spectral_entropy for r in spectral_entropy(df, K).collect()}
    assert e["sine"] < 0.2 < 0.6 < e["noise"] <= 1
    s = {r.series: r.score for r in forecastability(df, K, 52).collect()}
    assert s["sine"] > s["noise"] and all(0 <= v <= 100 for v in s.values())


def test_stationarity_tests():
    noise = RNG.normal(0, 1, 300)
    walk = np.cumsum(noise)
    assert _adf_p(noise) < 0.01 and _kpss_p(noise) == pytest.approx(0.1, abs=0.06)
    assert _adf_p(walk) > 0.05 and _kpss_p(walk) < 0.05


def test_series_without_eval_rows_have_a_row(spark, series):
    df = series(long=list(SINE), one=[5.0])
    maker = lambda winners: B.registered(SM.theta_model, B.grid_table(spark, [{"period": 52}]) if winners is None else winners)
    rows = train_models(df, K, "weekly", 8, {"theta": maker})["forecast"].collect()
    assert {r.series for r in rows} == {"long", "one"}
    assert [(r.yhat, r.error is not None) for r in rows if r.series == "one"] == [(None, True)]
    ranked = weekly_naive_ranking(df, K, 8).collect()
    assert [(r.model, r.is_best) for r in ranked if r.series == "one"] == [(None, False)] and any(r.series == "long" for r in ranked)


def test_ladder_refits_only_what_it_doubts(spark, series):
    """A flat, a runaway, a negative and a failing series each end at a named level; the others are fitted once."""
    df = series(good=list(SINE), flat=list(SINE), runaway=list(SINE), negative=list(SINE), failing=list(SINE), lost=list(SINE))
    future, fitted = B.future_frame(df, K, 6, "weekly"), []

    def level(**values):
        def forecast(hist, ahead, keys):
            fitted.append({r.series for r in hist.select("series").distinct().collect()})
            y = F.col("h") * 10 + 90.0
            for name, how in values.items():
                y = F.when(F.col("series") == name, {"flat": F.lit(100.0), "big": y * 50, "minus": F.lit(190.0) - F.col("h") * 40, "none": F.lit(None).cast("double")}[how]).otherwise(y)
            return ahead.select(*keys, "h", "ds", y.alias("yhat"))

        return forecast

    out = climb(df, future, K, [("fine", level(flat="flat", runaway="big", negative="minus", failing="none", lost="none")),
                                ("plain", level(runaway="big", lost="none")), ("last", level(runaway="big", lost="none"))])
    assert fitted == [{"good", "flat", "runaway", "negative", "failing", "lost"}, {"flat", "runaway", "negative", "failing", "lost"}, {"runaway", "lost"}]
    assert {(r.series, r.level_name, r.reason) for r in out["rounds"].where("level = 0").collect()} == {
        ("good", "fine", None), ("flat", "fine", "flat"), ("runaway", "fine", "mean_level"), ("negative", "fine", "negative"), ("failing", "fine", "failed"), ("lost", "fine", "failed")}
    rows = out["forecast"].collect()
    ends = {r.series: r.level_name for r in rows}
    assert ends == {"good": "fine", "flat": "plain", "negative": "plain", "failing": "plain", "runaway": "last", "lost": None}
    assert len(rows) == 5 * 6 + 1 and [r.error is not None for r in rows if r.series == "lost"] == [True]


def test_failures_are_counted(spark, series):
    """A candidate that fails on one series leaves a row with its error; the series goes on with the others."""
    def model(y, ds, params, h, x=None, xf=None):
        if params["k"] == 2 and y[0] > 700:
            raise ValueError("too large")
        return SM.theta_model(y, ds, {"period": 52}, h)

    df = series(small=list(SINE), large=[v + 1000 for v in SINE])
    grid = B.grid_table(spark, {"k": [1, 2]})
    out = train_models(df, K, "weekly", 8, {"own": lambda winners: B.registered(model, grid if winners is None else winners)})
    assert [(r.series, r.model, r.cand, r.stage, r.n_failed, "too large" in r.error) for r in out["failures"].collect()] == [("large", "own", '{"k": 2}', "eval", 1, True)]
    assert {r.series for r in out["forecast"].where("yhat is not null").collect()} == {"small", "large"}


def walk(y, family, start, period):
    """The same search for one series, with a dictionary: what is tried, and the best point."""
    def crit(p):
        try:
            v = AU.CRITERIA[family](y, p, period)
        except ValueError:
            return np.inf
        return v if np.isfinite(v) else np.inf

    low, high = AU.BOUNDS[family]
    moves = [tuple(s * v for v in m) for m in AU.MOVES[family] for s in (1, -1)]
    seen = {p: crit(p) for p in start}
    best = min(seen, key=lambda p: (seen[p], p))
    while True:
        if not np.isfinite(seen[best]):
            return seen, best
        near = {tuple(a + b for a, b in zip(best, m)) for m in moves}
        fresh = {p: crit(p) for p in near - set(seen) if all(a <= b <= c for a, b, c in zip(low, p, high))}
        seen |= fresh
        better = [p for p in fresh if fresh[p] < seen[best]]
        if not better:
            return seen, best
        best = min(better, key=lambda p: (fresh[p], p))


def test_automatic_set_against_walks_and_grids(spark, series):
    """Ten series: the same points as walks one by one, and the best of the whole grid nearly always."""
    rng, t = np.random.RandomState(3), np.arange(96)
    noise = lambda s: rng.normal(0, s, 96)
    ar = np.zeros(96)
    for i in range(1, 96):
        ar[i] = 0.8 * ar[i - 1] + rng.normal(0, 2)
    ring = np.sin(2 * np.pi * t / 12)
    values = {"noise": 50 + noise(3), "line": 50 + 2 * t + noise(2), "ar": 60 + ar, "walk": 200 + np.cumsum(noise(2)), "season": 100 + 20 * ring + noise(2),
              "growing": (100 + 2 * t) * (1 + 0.3 * ring) + noise(2), "square": 10 + 0.1 * t**2 + noise(1), "minus": -20 + noise(4), "short": (30 + noise(3))[:30], "tiny": (30 + noise(3))[:6]}
    df = series(**{k: list(v) for k, v in values.items()})
    tried = AU.auto_search(df, K, 12)
    keys = [*K, "family"]
    got, rows = {}, tried.collect()
    for r in rows:
        got.setdefault((r.series, r.family), {})[tuple(r.point)] = r.crit if r.crit is not None else np.inf
        assert (r.crit is None) == (r.error is not None)
    assert len(rows) == sum(map(len, got.values()))  # no point twice
    best = {(r.series, r.family): tuple(r.point) for r in best_points(tried, keys).collect()}
    hits = 0
    for name, y in values.items():
        y = np.array([float(v) for v in y])
        spreads = [np.std(np.diff(y, d)) for d in range(3)]
        d = int(np.argmin(spreads))
        for family in AU.FAMILIES:
            start = [((d,) if family == "arima" else ()) + p for p in AU.STARTS[family]]
            seen, end = walk(y, family, start, 12)
            assert got[name, family] == pytest.approx(seen)
            if np.isfinite(seen[end]):
                assert best[name, family] == end
                low, high = AU.BOUNDS[family]
                grid = [p for p in np.ndindex(*[b + 1 for b in high]) if family != "arima" or p[0] == d]
                hits += seen[end] <= min(v for v in (walk_crit(y, family, p) for p in grid)) + 1e-9
            else:
                assert (name, family) not in best
    assert ("tiny", "arima") not in best and ("tiny", "theta") in best
    assert hits >= 0.75 * len(best)
    report = {(r.series, r.family): r for r in search_report(tried, keys, AU.move_table(spark)).collect()}
    assert len(report) == 30 and all(r.is_settled for r in report.values())
    assert all(r.is_monotone for k, r in report.items() if k in best)
    assert best["line", "ets"][0] > 0 and best["season", "theta"][1] > 0 and best["growing", "ets"][1] > 0


def walk_crit(y, family, p):
    try:
        return AU.CRITERIA[family](y, p, 12)
    except ValueError:
        return np.inf


def test_automatic_set_in_training(spark, series):
    """Each series gets the family of least error; one of too few rows has a row with its error."""
    df = series(line=list(LINE), season=list(SINE), one=[5.0])
    out = train_models(df, K, "weekly", 8, {"auto": AU.auto_set(52)})
    rows = out["forecast"].collect()
    assert {s: sum(r.series == s and r.yhat is not None for r in rows) for s in ("line", "season", "one")} == {"line": 8, "season": 8, "one": 0}
    got = sorted((r.h, r.yhat) for r in rows if r.series == "line")
    assert [v for _, v in got] == pytest.approx([LINE[-1] + 2 * h for h, _ in got], rel=0.02)
    got = sorted((r.h, r.yhat) for r in rows if r.series == "season")
    assert [v for _, v in got] == pytest.approx([100 + 30 * np.sin(2 * np.pi * (155 + h) / 52) for h, _ in got], rel=0.1)
    assert {r.cand.count("family") for r in out["scores"].collect()} == {1}


def test_frontier_edges(spark):
    """No rows; a series that can't be scored; points at their bounds; equal criteria don't move it."""
    steps = spark.createDataFrame([([1], [0], [3]), ([-1], [0], [3])], "step array<int>, low array<int>, high array<int>")
    score = lambda p: p.select("series", "point", F.when(F.col("series") != "bad", F.when(F.col("series") == "even", 1.0).otherwise(-F.col("point")[0].cast("double"))).alias("crit"), F.lit(None).cast("string").alias("error"))
    starts = spark.createDataFrame([("up", [1]), ("up", [1]), ("even", [2]), ("bad", [0])], "series string, point array<int>")
    tried = frontier_search(starts, K, steps, score)
    assert {(r.series, r.point[0], r.round) for r in tried.collect()} == {("up", 1, 0), ("up", 0, 1), ("up", 2, 1), ("up", 3, 2), ("even", 2, 0), ("even", 1, 1), ("even", 3, 1), ("bad", 0, 0)}
    assert {r.series: r.point[0] for r in best_points(tried, K).collect()} == {"up": 3, "even": 2}
    assert frontier_search(starts.where("false"), K, steps, score).count() == 0


def test_damped_trend_levels_off():
    up, _ = SM.ets_model(LINE, dates(200), {"trend": "add", "season": "none", "period": 1}, 60)
    damped, _ = SM.ets_model(LINE, dates(200), {"trend": "damped", "season": "none", "period": 1}, 60)
    assert up[-1] == pytest.approx(LINE[-1] + 120, rel=0.02)
    steps = np.diff(damped)
    assert np.all(steps[1:] < steps[:-1]) and steps[-1] < 0.02


def by_candidate(df):
    return {(r.series, r.cand, r.h): (r.ds, r.yhat, r.yhat_lower, r.yhat_upper, r.error) for r in df.collect()}


def same_forecasts(a, b):
    assert a.keys() == b.keys()
    for k, (ds, *bounds, error) in a.items():
        assert (ds, error) == (b[k][0], b[k][4]), k
        if error is None:
            assert bounds == pytest.approx(b[k][1:4], rel=1e-7), k


def test_shared_sums_give_the_forecasts_of_single_fits(spark, series):
    t = np.arange(130)
    df = series(up=list(50 + t + 10 * np.sin(2 * np.pi * t / 52)), mixed=list(5 * np.cos(t / 9.0)), short=[3.0, 4.0, 5.0])
    future = B.future_frame(df, K, 5, "weekly")
    grid = ST.structural_grid(spark, "weekly")
    hist, ahead = ST.holiday_columns(df), ST.holiday_columns(future)
    single = by_candidate(B.fan_out(hist, ahead, K, grid, ST.structural_model, ST.HOLIDAY_COLS))
    shared = by_candidate(ST.structural(df, future, K, grid))
    same_forecasts(shared, single)
    assert len({c for _, c, _ in shared}) == 48
    # positive values are needed for one of two modes: one error row for each of these candidates
    assert sum(v[4] is not None for (s, _, _), v in shared.items() if s == "mixed") == 24
    # a list of its own for each series; one series has a list but no rows
    own = df.select("series").distinct().where("series <> 'short'").crossJoin(grid.limit(7)).unionByName(
        spark.createDataFrame([("gone", '{"growth": "flat", "mode": "additive", "freq": "weekly"}')], "series string, cand string"))
    got = by_candidate(ST.structural(df, future, K, own))
    assert [v[4] for (s, _, _), v in got.items() if s == "gone"] == ["ValueError: no history or no future"]
    same_forecasts({k: v for k, v in got.items() if k[0] != "gone"}, {k: v for k, v in single.items() if k[0] != "short" and (k[0], k[1]) in {(s, c) for s, c, _ in got}})
    # empty lists, and a series without a future
    assert ST.structural(df, future, K, grid.limit(0)).count() == 0
    lost = ST.structural(df, future.where("series <> 'up'"), K, grid).where("series = 'up'")
    assert lost.count() == 48 and lost.where("error is null").count() == 0


def test_shared_sums_solve_the_ridge_system():
    """Against least squares on the columns with one more row for every penalty."""
    y = 20 + RNG.rand(60).cumsum()
    params = {"growth": "linear", "mode": "additive", "freq": "weekly", "trend_flexibility": 0.1, "season_flexibility": 1.0}
    sums = ST._Sums(y, dates(64), params, 4, None, None)
    weight = {"level": 0.0, "slope": 1e-3, "knot": 0.5, "season": 0.1}
    a = np.vstack([sums.a[:60], np.diag([np.sqrt(weight[k] + 1e-9) for k in sums.kind])])
    beta = np.linalg.lstsq(a, np.concatenate([sums.z, np.zeros(len(sums.kind))]), rcond=None)[0]
    f, _ = ST.structural_model(y, dates(64), params, 4)
    assert f == pytest.approx((sums.a @ beta)[60:] * sums.scale + sums.mean, rel=1e-6)


def test_grids_of_two_series_differ(spark, series):
    rows = [("a", "structural", "trend_flexibility", ["0.01", "0.05", "0.05"]), ("a", "structural", "season_mode", ["additive"]), ("a", "structural", "yearly", ["false"]),
            ("b", "structural", "season_mode", ["multiplicative"]), ("b", "structural", "weekly", None), ("b", "structural", "yearly", []),
            ("c", "ets", "trend", ["add", "mul"]), ("c", "ets", "damped", ["true", "false"]), ("c", "ets", "seasonal", ["none"])]
    grid = spark.createDataFrame(rows, "series string, model string, param string, values array<string>")
    got = GR.expand_grid(grid, K, "structural", {"freq": "weekly"})
    n = {r.series: r.n for r in got.groupBy("series").agg(F.count_distinct("cand").alias("n")).collect()}
    assert n == {"a": 2 * 1 * 2 * 3, "b": 2 * 1 * 4 * 3, "c": 2 * 2 * 4 * 3}
    assert got.count() == sum(n.values())
    assert got.where("series = 'a'").select(F.get_json_object("cand", "$.yearly")).distinct().collect() == [("false",)]
    orders = GR.expand_grid(grid, K, "arima").where("series = 'a'")
    assert orders.count() == 3 * 2 * 2 - 2
    assert GR.expand_grid(grid.limit(0), K, "ets", {"period": 4}).count() == 0
    forms = GR.expand_grid(grid, K, "ets", {"period": 4}).where("series = 'c'")
    assert forms.count() == 4
    df = series(c=list(100 * 1.02 ** np.arange(40)))
    fc = SM.ets(df, B.future_frame(df, K, 6, "weekly"), K, forms)
    assert fc.where("error is not null").count() == 0
    ends = {r.cand: r.yhat for r in fc.where("h = 6").collect()}
    factor = [v for c, v in ends.items() if '"mul"' in c]
    added = {c: v for c, v in ends.items() if '"add"' in c}
    assert factor == pytest.approx([100 * 1.02 ** 45] * 2, rel=1e-3)
    damped, straight = (next(v for c, v in added.items() if f'"damped":"{d}"' in c) for d in ("true", "false"))
    assert damped < straight


def test_parameters_of_advice_are_read():
    """Switching the waves off or on changes the columns."""
    def n_season(**more):
        sums = ST._Sums(SINE, dates(160), {"growth": "flat", "mode": "additive", "freq": "weekly", **more}, 4, None, None)
        return sums.kind.count("season")

    assert (n_season(), n_season(yearly="false"), n_season(weekly="true"), n_season(yearly="false", weekly="true"), n_season(yearly="auto")) == (10, 0, 16, 6, 10)


def test_default_parameters_become_candidates(spark):
    rows = [("a", "ets", {"error": "add", "trend": "add", "seasonal": "add", "damped": "true", "m": "52"}), ("b", "ets", {"trend": "none", "seasonal": "add", "m": "none"}),
            ("a", "sarimax", {"order": "1,1,1", "seasonal_order": "1,1,1,52"}), ("b", "sarimax", {"order": "2,0,1", "seasonal_order": "none"})]
    params = spark.createDataFrame(rows, "series string, model string, params map<string,string>")
    ets = {r.series: r.cand for r in GR.default_candidates(params, K, "ets").collect()}
    assert ets == {"a": '{"damped":"true","period":"52","season":"add","trend":"add"}', "b": '{"period":"1","season":"none","trend":"none"}'}
    sx = {r.series: r.cand for r in GR.default_candidates(params, K, "sarimax").collect()}
    assert sx == {"a": '{"d":"1","p":"1","period":"52","q":"1"}', "b": '{"d":"0","p":"2","period":"1","q":"1"}'}
