"""Signals of a series: trend, seasonality, autocorrelation, decomposition, entropy, stationarity.

Each is one exchange by series key; the windows and the aggregate that follow share it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_tail_even, z_critical
from .base import Keys, PERIOD, bands, by, codes, join_on_keys, median, ordered, running, series_len
from .windows import gap_limit

EPS = 1e-10

# fixed values: weights of the forecastability score
SIGNAL_WEIGHTS = {
    "spectral_entropy": 0.30, "trend_strength": 0.20, "seasonal_strength": 0.20,
    "linearity": 0.10, "spikiness": 0.10, "acf1_remainder": 0.10,
}


def numbered(df: DataFrame, keys: Keys, y: str = "y") -> DataFrame:
    """Filled values with position ``t`` (from 0) and length ``n``."""
    rows = df.where(F.col(y).isNotNull()).select(*keys, "ds", F.col(y).cast("double").alias("y"))
    return rows.select("*", (F.row_number().over(ordered(keys)) - 1).alias("t"), series_len(keys).alias("n"))


def centred(df: DataFrame, keys: Keys, y: str = "y") -> DataFrame:
    """Numbered rows with the distance ``c`` from the series mean and population variance ``v``."""
    w = by(keys)
    return numbered(df, keys, y).select("*", (F.col("y") - F.avg("y").over(w)).alias("c"), F.var_pop("y").over(w).alias("v"))


def _lag_product(keys: Keys, c: str, k: int) -> Column:
    return F.col(c) * F.lag(c, k).over(ordered(keys, "t"))


def trend(df: DataFrame, keys: Keys, y: str = "y") -> DataFrame:
    """Slope, relative slope band and strength (R²) of a straight line."""
    out = numbered(df, keys, y).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "t").alias("slope"), F.regr_r2("y", "t").alias("r2"),
        F.avg(F.abs("y")).alias("size"), F.stddev_pop("y").alias("sd"))
    rel = F.col("slope") * F.col("n") / (F.col("size") + EPS)
    kind = (F.when(F.col("n") < 3, "flat").when(rel > 0.3, "strong_up").when(rel > 0.1, "moderate_up").when(rel < -0.3, "strong_down")
            .when(rel < -0.1, "moderate_down").otherwise("flat"))
    return out.select(
        *keys, "n", "slope", rel.alias("relative_slope"), kind.alias("trend_type"),
        F.when(F.col("n") < 3, 0.0).otherwise(F.coalesce(F.greatest("r2", F.lit(0.0)), F.lit(0.0))).alias("trend_strength"),
        F.coalesce((F.col("n") >= 10) & (F.abs("slope") > F.col("sd") * 0.01), F.lit(False)).alias("has_trend"))


def seasonality(df: DataFrame, keys: Keys, freq: str, y: str = "y") -> DataFrame:
    """Strength as autocorrelation at the seasonal lag, for series of at least two cycles."""
    p = PERIOD.get(freq, 12)
    rows = centred(df, keys, y).withColumn("prod", _lag_product(keys, "c", p))
    out = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.sum("prod").alias("s"), F.max("v").alias("v"))
    acf = F.col("s") / ((F.col("n") - p) * (F.col("v") + EPS))
    strength = F.when(F.col("n") >= 2 * p, F.abs(acf)).otherwise(0.0)
    return out.select(*keys, F.lit(p).alias("period"), F.coalesce(strength, F.lit(0.0)).alias("seasonality_strength")).withColumn(
        "seasonality_type", bands(F.col("seasonality_strength"), [(0.7, "strong"), (0.4, "moderate"), (0.2, "weak")], "none", "gt"))


def circular_acf(df: DataFrame, keys: Keys, p: int, y: str = "y") -> DataFrame:
    """Autocorrelation at lag p of the series closed to a ring; above 0.3 is seasonal.

    The products that wrap around need only the first and last p rows, paired by an aggregate.
    """
    rows = centred(df, keys, y)
    inner = rows.withColumn("prod", _lag_product(keys, "c", p)).groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("v").alias("v"), F.coalesce(F.sum("prod"), F.lit(0.0)).alias("s"))
    place = F.when(F.col("t") < p, F.col("t")), F.when(F.col("t") >= F.col("n") - p, F.col("t") - F.col("n") + p)
    ends = rows.select(*keys, "c", F.explode(F.array(F.struct(place[0].alias("i"), F.lit("head").alias("e")),
                                                     F.struct(place[1].alias("i"), F.lit("tail").alias("e")))).alias("x")).where("x.i IS NOT NULL")
    wrap = ends.groupBy(*keys, F.col("x.i").alias("i")).agg(
        (F.max(F.when(F.col("x.e") == "head", F.col("c"))) * F.max(F.when(F.col("x.e") == "tail", F.col("c")))).alias("w"))
    wrap = wrap.groupBy(*keys).agg(F.sum("w").alias("w"))
    out = join_on_keys(inner, wrap, keys)
    acf = F.when((F.col("n") > 2 * p) & (F.col("v") > 0), (F.col("s") + F.col("w")) / F.col("n") / F.col("v"))
    return out.select(*keys, acf.alias("acf"), F.coalesce((F.col("n") >= 10) & (acf > 0.3), F.lit(False)).alias("has_seasonality"))


def acf1(df: DataFrame, keys: Keys, y: str = "y") -> DataFrame:
    """Lag-1 autocorrelation; above 0.3 in size counts."""
    rows = centred(df, keys, y).withColumn("prod", _lag_product(keys, "c", 1))
    out = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.sum("prod").alias("s"), F.max("v").alias("v"))
    a = F.when(F.col("n") >= 3, F.col("s") / ((F.col("n") - 1) * (F.col("v") + EPS))).otherwise(0.0)
    return out.select(*keys, a.alias("acf_lag1"), (F.abs(a) > 0.3).alias("has_autocorrelation"))


def season_mode(chars: DataFrame) -> DataFrame:
    """Additive or multiplicative seasonality from signs, trend and spread."""
    up = F.col("trend_type").isin("strong_up", "moderate_up")
    mode = (F.when(F.col("has_negative") | F.col("has_zero"), "additive").when(F.col("trend_type") == "flat", "additive")
            .when((F.col("trend_strength") > 0.3) & (F.col("seasonality_strength") > 0.3), "multiplicative")
            .when(up & (F.col("cv") > 0.2), "multiplicative").otherwise("additive"))
    return chars.withColumn("season_mode", mode)


def decompose(df: DataFrame, keys: Keys, period: int, y: str = "y") -> DataFrame:
    """Classical decomposition: centred moving average (narrower at the ends), centred phase means, remainder."""
    half = period // 2
    rows = numbered(df, keys, y)
    if period % 2:
        level = F.avg("y").over(running(keys, -half, half, "t"))
    else:
        level = (F.avg("y").over(running(keys, -half, half - 1, "t")) + F.avg("y").over(running(keys, 1 - half, half, "t"))) / 2
    rows = rows.withColumn("trend", level)
    rows = rows.withColumns({"_d": F.col("y") - F.col("trend"), "_ph": F.col("t") % period})
    seasonal = F.avg("_d").over(by([*keys, "_ph"])) - F.avg("_d").over(by(keys))
    rows = rows.withColumn("seasonal", seasonal)
    return rows.withColumn("remainder", F.col("y") - F.col("trend") - F.col("seasonal")).drop("_d", "_ph")


def _ratio_strength(rest: Column, both: Column) -> Column:
    return F.when(both > 0, F.greatest(F.lit(0.0), 1 - rest / both)).otherwise(0.0)


def strengths(decomp: DataFrame, keys: Keys) -> DataFrame:
    """Share of variance trend and seasonal explain beside the remainder."""
    r = F.col("remainder")
    out = decomp.groupBy(*keys).agg(F.var_pop(r).alias("vr"), F.var_pop(F.col("trend") + r).alias("vt"), F.var_pop(F.col("seasonal") + r).alias("vs"))
    return out.select(*keys, _ratio_strength(F.col("vr"), F.col("vt")).alias("trend_strength"), _ratio_strength(F.col("vr"), F.col("vs")).alias("seasonal_strength"))


def _entropy(values: np.ndarray) -> float:
    n = len(values)
    if n < 4:
        return 1.0
    power = np.abs(np.fft.rfft(values - values.mean())) ** 2
    power = power[1:]  # the constant term of a centred series carries rounding only
    total = power.sum()
    if total <= 0:
        return 1.0
    p = power[power > 0] / total
    return float(min(1.0, -(p * np.log2(p)).sum() / math.log2(n // 2 + 1)))


def entropy_of(values: Column | str) -> Column:
    """Normalised spectral entropy of an array column."""
    @F.pandas_udf("double")
    def entropy(a: pd.Series) -> pd.Series:
        return a.map(lambda v: _entropy(np.asarray(v, dtype=float)))

    return entropy(values)


def value_array(order: str = "t", value: str = "y") -> Column:
    """Values of one series in order; a series has one row per date, so the array is bounded."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])


def spectral_entropy(df: DataFrame, keys: Keys, y: str = "y") -> DataFrame:
    """0 for one frequency, towards 1 for white noise."""
    arrays = numbered(df, keys, y).groupBy(*keys).agg(value_array().alias("_a"))
    return arrays.select(*keys, entropy_of("_a").alias("spectral_entropy"))


def linearity(decomp: DataFrame, keys: Keys) -> DataFrame:
    """How straight the trend is (R²); a flat one is straight."""
    out = decomp.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_r2("trend", "t").alias("r2"), F.var_pop("trend").alias("v"))
    r2 = F.when(F.col("n") < 3, 0.0).when(F.col("v") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("r2")))
    return out.select(*keys, r2.alias("linearity"))


def _leave_one_out(keys: Keys) -> Column:
    """Variance of the remainder without the row itself, from the sums of the series."""
    w, r = by(keys), F.col("remainder")
    m = F.col("n") - 1
    mean = (F.sum(r).over(w) - r) / m
    return F.greatest(F.lit(0.0), (F.sum(r * r).over(w) - r * r) / m - mean * mean)


def _spikiness(n: Column, v_loo: Column, v: Column) -> Column:
    return F.when(n < 4, 1.0).when(v == 0, 0.0).otherwise(v_loo / (v * v))


def spikiness(decomp: DataFrame, keys: Keys) -> DataFrame:
    """Variance of leave-one-out variances, relative to the squared variance."""
    rows = decomp.withColumn("_loo", F.when(F.col("n") > 1, _leave_one_out(keys)))
    out = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.var_pop("_loo").alias("vl"), F.var_pop("remainder").alias("v"))
    return out.select(*keys, _spikiness(F.col("n"), F.col("vl"), F.col("v")).alias("spikiness"))


def _growth(n: Column, first: Column, last: Column) -> Column:
    return F.when((n < 8) | (first == 0), 0.0).otherwise((last - first) / F.abs(first) * 100)


def _quarter_medians() -> tuple[Column, Column]:
    q = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    return median(F.when(F.col("t") < q, F.col("y"))), median(F.when(F.col("t") >= F.col("n") - q, F.col("y")))


def _half_means(period: int) -> tuple[Column, Column]:
    half, back = period // 2, F.col("n") - F.col("t")
    return (F.avg(F.when(back <= half, F.col("y"))), F.avg(F.when((back > half) & (back <= period), F.col("y"))))


def growth_rates(df: DataFrame, keys: Keys, period: int, y: str = "y") -> DataFrame:
    """Last against first quarter (medians), and the last half period against the one before (means), in percent."""
    first, last = _quarter_medians()
    recent, prior = _half_means(period)
    out = numbered(df, keys, y).groupBy(*keys).agg(
        F.max("n").alias("n"), first.alias("f"), last.alias("l"), recent.alias("r"), prior.alias("p"))
    return out.select(*keys, "n", *_growth_cols(period))


def _growth_cols(period: int) -> list[Column]:
    recent = F.when((F.col("n") < period) | (F.col("p") == 0), 0.0).otherwise((F.col("r") - F.col("p")) / F.abs("p") * 100)
    return [_growth(F.col("n"), F.col("f"), F.col("l")).alias("total_growth_pct"), recent.alias("recent_growth_pct")]


def forecastability(df: DataFrame, keys: Keys, period: int, y: str = "y") -> DataFrame:
    """Score 0..100 from six signals; series under two cycles get a length-based score.

    All signals come out of one pass over the decomposed series.
    """
    rows = decompose(df, keys, period, y)
    w = by(keys)
    rows = rows.withColumn("_rc", F.col("remainder") - F.avg("remainder").over(w))
    rows = rows.withColumns({"_loo": F.when(F.col("n") > 1, _leave_one_out(keys)), "_rp": _lag_product(keys, "_rc", 1)})
    r = F.col("remainder")
    first, last = _quarter_medians()
    recent, prior = _half_means(period)
    agg = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), F.var_pop(r).alias("vr"), F.var_pop(F.col("trend") + r).alias("vt"), F.var_pop(F.col("seasonal") + r).alias("vs"),
        F.regr_r2("trend", "t").alias("r2"), F.var_pop("trend").alias("vtr"), F.var_pop("_loo").alias("vl"), F.sum("_rp").alias("rp"),
        F.avg("y").alias("mean_y"), first.alias("f"), last.alias("l"), recent.alias("r"), prior.alias("p"), value_array().alias("_a"))
    n, vr = F.col("n"), F.col("vr")
    acf = F.when((n < 3) | (vr == 0), 0.0).otherwise(F.least(F.greatest(F.col("rp") / ((n - 1) * vr), F.lit(-1.0)), F.lit(1.0)))
    lin = F.when(n < 3, 0.0).when(F.col("vtr") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("r2")))
    full = n >= 2 * period
    short = {"spectral_entropy": 0.8, "trend_strength": 0.0, "seasonal_strength": 0.0, "linearity": 0.0, "spikiness": 1.0, "acf1_remainder": 0.0}
    out = agg.withColumn("_se", entropy_of("_a"))
    value = {
        "spectral_entropy": F.col("_se"), "trend_strength": _ratio_strength(vr, F.col("vt")),
        "seasonal_strength": _ratio_strength(vr, F.col("vs")), "linearity": lin,
        "spikiness": _spikiness(n, F.col("vl"), vr), "acf1_remainder": acf}
    out = out.select(*keys, "n", "mean_y", *_growth_cols(period), *[F.when(full, v).otherwise(short[k]).alias(k) for k, v in value.items()])
    scores = {
        "spectral_entropy": (1 - F.col("spectral_entropy")) * 100, "trend_strength": F.col("trend_strength") * 100,
        "seasonal_strength": F.col("seasonal_strength") * 100, "linearity": F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("linearity") * 100)),
        "spikiness": 100 / (1 + F.col("spikiness") * 50), "acf1_remainder": F.greatest(F.lit(0.0), (1 - F.abs("acf1_remainder")) * 100)}
    total = sum((SIGNAL_WEIGHTS[k] * s for k, s in scores.items()), F.lit(0.0))
    by_length = F.greatest(F.lit(10.0), F.least(F.lit(30.0), n / (period * 2) * 40))
    score = F.when(full, F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0))).otherwise(by_length)
    return out.withColumn("score", score).withColumn("grade", grade(F.col("score")))


def grade(score: Column) -> Column:
    return bands(score, [(80, "excellent"), (60, "good"), (40, "fair"), (20, "poor")], "unforecastable")


# fixed values: response surface of the unit-root test and KPSS critical values
ADF_TAU_MAX, ADF_TAU_MIN, ADF_TAU_STAR = 2.74, -18.83, -1.61
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
KPSS_STAT = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)


def _adf_p(y: np.ndarray) -> float:
    """p-value of the unit-root test with constant; the lag count minimises AIC on a common sample."""
    n = len(y)
    top = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    d = np.diff(y)

    def fit(k: int, start: int) -> tuple[float, float]:
        resp = d[start:]
        cols = [y[start:-1], *[d[start - j:len(d) - j] for j in range(1, k + 1)], np.ones(len(resp))]
        x = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(x, resp, rcond=None)
        e = resp - x @ beta
        rss = float(e @ e)
        m, q = x.shape
        cov = np.linalg.pinv(x.T @ x) * (rss / (m - q))
        aic = m * math.log(max(rss / m, 1e-300)) + 2 * q
        return aic, float(beta[0] / math.sqrt(max(cov[0, 0], 1e-300)))

    best = min(range(top + 1), key=lambda k: fit(k, top)[0])
    tau = fit(best, best)[1]
    if tau > ADF_TAU_MAX:
        return 1.0
    if tau < ADF_TAU_MIN:
        return 0.0
    coef = ADF_SMALL if tau <= ADF_TAU_STAR else ADF_LARGE
    return 0.5 * math.erfc(-sum(c * tau**i for i, c in enumerate(coef)) / math.sqrt(2))


def _kpss_p(y: np.ndarray) -> float:
    """p-value of level stationarity, automatic bandwidth, interpolated between 0.10 and 0.01."""
    n = len(y)
    r = y - y.mean()

    def cov(k: int) -> float:
        return float(r[k:] @ r[: n - k])

    pre = int(n ** (2 / 9))
    s0 = cov(0) / n + sum(2 * cov(i) / n for i in range(1, pre + 1))
    s1 = sum(i * 2 * cov(i) / n for i in range(1, pre + 1))
    width = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long_run = (cov(0) + 2 * sum(cov(i) * (1 - i / (width + 1)) for i in range(1, width + 1))) / n
    stat = float((np.cumsum(r) ** 2).sum()) / n**2 / long_run
    return float(np.interp(stat, KPSS_STAT, KPSS_P))


def stationarity(df: DataFrame, keys: Keys, y: str = "y", level: float = 0.05) -> DataFrame:
    """Unit-root and level tests of each series with the joint verdict; fewer than 20 values give none."""
    arrays = numbered(df, keys, y).groupBy(*keys).agg(value_array().alias("_a"))

    @F.pandas_udf("adf_p double, kpss_p double")
    def tests(a: pd.Series) -> pd.DataFrame:
        def one(v):
            v = np.asarray(v, dtype=float)
            if len(v) < 20 or np.ptp(v) == 0:
                return None, None
            return _adf_p(v), _kpss_p(v)

        return pd.DataFrame([one(v) for v in a], columns=["adf_p", "kpss_p"], dtype=float)

    out = arrays.withColumn("_p", tests("_a"))
    adf_ok, kpss_ok = F.col("_p.adf_p") < level, F.col("_p.kpss_p") > level
    action = (F.when(adf_ok.isNull() | kpss_ok.isNull(), "inconclusive").when(adf_ok & kpss_ok, "none").when(~adf_ok & ~kpss_ok, "difference")
              .when(adf_ok & ~kpss_ok, "detrend_or_difference").otherwise("difference_for_safety"))
    return out.select(*keys, F.col("_p.adf_p").alias("adf_p"), F.col("_p.kpss_p").alias("kpss_p"), adf_ok.alias("adf_stationary"),
                      kpss_ok.alias("kpss_stationary"), (adf_ok & kpss_ok).alias("stationary"), action.alias("action"))


def residual_acf(res: DataFrame, keys: Keys, col: str = "res", lags: int = 10, level: float = 0.05) -> DataFrame:
    """One row per series and lag: autocorrelation, bound, significance, and the joint test on every row."""
    ok = res.where(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(col) < float("inf")))
    rows = centred(ok, keys, col)
    rows = rows.select(*keys, "n", "v", *[_lag_product(keys, "c", k).alias(f"p{k}") for k in range(1, lags + 1)])
    agg = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.max("v").alias("v"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, lags + 1)])
    agg = agg.where((F.col("n") >= lags + 5) & (F.col("v") > 0))
    n = F.col("n")
    acfs = [F.col(f"p{k}") / (n * F.col("v")) for k in range(1, lags + 1)]
    q = sum((a * a / (n - k) for k, a in enumerate(acfs, 1)), F.lit(0.0)) * n * (n + 2)
    agg = agg.withColumn("ljung_box_q", q).withColumn("ljung_box_p", chi2_tail_even(F.col("ljung_box_q"), lags))
    per = F.array(*[F.struct(F.lit(k).alias("lag"), a.alias("acf")) for k, a in enumerate(acfs, 1)])
    out = agg.select(*keys, "n", "ljung_box_q", "ljung_box_p", F.inline(per))
    bound = z_critical(1 - level) / F.sqrt(n)
    return out.select("*", bound.alias("bound"), (F.abs("acf") > bound).alias("significant"), (F.col("ljung_box_p") >= level).alias("is_white_noise"))


def characteristics(df: DataFrame, keys: Keys, freq: str, y: str = "y") -> DataFrame:
    """All descriptive facts of each series in one row, with quality score and grade."""
    from .quality import quality_grade

    p = PERIOD.get(freq, 12)
    every = df.select("*", F.datediff("ds", F.lag("ds").over(ordered(keys))).alias("_gap"))
    facts = every.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"), F.min("ds").alias("start_date"), F.max("ds").alias("end_date"),
        (F.datediff(F.max("ds"), F.min("ds")) / 365.25).alias("n_years"), F.count_if(F.col("_gap") > gap_limit(freq, "analysis")).alias("gap_count"))
    rows = centred(df, keys, y)
    w = by(keys)
    q1, q3 = F.percentile("y", F.lit(0.25)).over(w), F.percentile("y", F.lit(0.75)).over(w)
    rows = rows.withColumns({"_q1": q1, "_q3": q3, "_p1": _lag_product(keys, "c", 1), "_pp": _lag_product(keys, "c", p)})
    iqr = F.col("_q3") - F.col("_q1")
    out = (F.col("y") < F.col("_q1") - 1.5 * iqr) | (F.col("y") > F.col("_q3") + 1.5 * iqr)
    agg = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.min("y").alias("min"), F.max("y").alias("max"),
        F.bool_or(F.col("y") < 0).alias("has_negative"), F.bool_or(F.col("y") == 0).alias("has_zero"), F.max("v").alias("v"),
        F.regr_slope("y", "t").alias("slope"), F.regr_r2("y", "t").alias("r2"), F.avg(F.abs("y")).alias("size"),
        F.sum("_p1").alias("s1"), F.sum("_pp").alias("sp"), (F.count_if(out) * 100.0 / F.count(F.lit(1))).alias("op"))
    n = F.col("n")
    rel = F.col("slope") * n / (F.col("size") + EPS)
    kind = (F.when(n < 3, "flat").when(rel > 0.3, "strong_up").when(rel > 0.1, "moderate_up").when(rel < -0.3, "strong_down")
            .when(rel < -0.1, "moderate_down").otherwise("flat"))
    season = F.coalesce(F.when(n >= 2 * p, F.abs(F.col("sp") / ((n - p) * (F.col("v") + EPS)))), F.lit(0.0))
    acf = F.when(n >= 3, F.col("s1") / ((n - 1) * (F.col("v") + EPS))).otherwise(0.0)
    signal = agg.select(
        *keys, "mean", "std", "min", "max", F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")).otherwise(0.0).alias("cv"),
        "has_negative", "has_zero", kind.alias("trend_type"),
        F.when(n < 3, 0.0).otherwise(F.coalesce(F.greatest("r2", F.lit(0.0)), F.lit(0.0))).alias("trend_strength"),
        season.alias("seasonality_strength"), F.when(n < 4, 0.0).otherwise(F.col("op")).alias("outlier_pct"), acf.alias("acf_lag1"))
    signal = signal.withColumn("seasonality_type", bands(F.col("seasonality_strength"), [(0.7, "strong"), (0.4, "moderate"), (0.2, "weak")], "none", "gt"))
    joined = join_on_keys(facts, signal, keys, "left")
    joined = joined.withColumns({
        "frequency": F.lit(freq), "has_gaps": F.col("gap_count") > 0, "has_outliers": F.coalesce(F.col("outlier_pct") > 1, F.lit(False)),
        "has_autocorrelation": F.coalesce(F.abs("acf_lag1") > 0.3, F.lit(False))})
    joined = season_mode(quality_grade(joined))
    return joined.withColumn("warnings", codes(
        (F.col("n_observations") < 52, "limited_data"), (F.col("n_years") < 1, "short_history"), (F.col("has_gaps"), "gaps"),
        (F.col("has_negative"), "negatives"), (F.col("outlier_pct") > 5, "many_outliers"), (F.col("cv") > 1.5, "volatile")))
