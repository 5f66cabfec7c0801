"""Advice rules: models, training window, log scale, horizon, expected error, merges, grids, presets.

Almost all are expressions over one row per series.  Model names: structural (trend, season and
holidays by regression), arima, sarimax, ets, boosted (trees), theta (automatic statistical set), naive.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import segment_id
from .base import Keys, PERIOD, bands, codes, join_on_keys
from .quality import HORIZON, slice_quality
from .signals import forecastability, numbered

# fixed values -----------------------------------------------------------------------------
MODELS = ("structural", "arima", "sarimax", "ets", "boosted", "theta", "naive")
DEFAULT_SET = ("structural", "ets", "theta", "naive")
NEVER = ("arima", "sarimax", "boosted")
MIN_LENGTH = {"structural": 12, "boosted": 30, "arima": 20, "ets": 24, "sarimax": 52, "naive": 20, "theta": 24}
MAPE_BANDS = ((80, 3.0, 8.0), (60, 8.0, 15.0), (40, 15.0, 25.0), (20, 25.0, 40.0))
PRESETS = ("fast", "medium", "high_quality", "best")
# ------------------------------------------------------------------------------------------


def _clip01(c: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6)


def _add(*terms: tuple[Column, float], base: float) -> Column:
    out = F.lit(base)
    for cond, amount in terms:
        out = out + F.when(cond, amount).otherwise(0.0)
    return out


def recommend_models(chars: DataFrame, keys: Keys) -> DataFrame:
    """One row per series and model: confidence, recommendation and reason codes."""
    n = F.col("n_observations")
    seasonal = F.col("seasonality_type").isin("strong", "moderate")
    trending = F.col("trend_type") != "flat"
    steep = F.col("trend_type").isin("strong_up", "strong_down")
    wild = F.col("has_outliers") & (F.col("outlier_pct") > 5)
    conf = {
        "structural": _add((seasonal, 0.2), (n < 52, -0.3), (wild, -0.1), (steep, 0.1), base=0.7),
        "ets": _add((seasonal, 0.15), (n < 24, -0.2), base=0.65),
        "theta": _add((F.col("has_autocorrelation"), 0.1), (seasonal, 0.1), (n < 24, -0.2), ((n >= 24) & (n < 52), -0.1), base=0.75),
        "naive": _add((n >= 104, 0.15), (n < 52, -0.15), (F.col("has_outliers"), 0.05), base=0.70),
    }
    limit = {"structural": 0.3, "ets": 0.8, "theta": 0.8, "naive": 0.8}
    why = {
        "structural": codes((seasonal, "seasonal"), (n < 52, "limited_data"), (F.col("n_years") < 2, "no_yearly"), (wild, "outliers"), (steep, "trend")),
        "ets": codes((seasonal, "seasonal"), (~seasonal, "non_seasonal"), (trending, "trend"), (n < 24, "limited_data"), (F.col("has_negative"), "additive_only")),
        "theta": codes((F.col("has_autocorrelation"), "autocorrelated"), (seasonal, "seasonal"), (n < 24, "limited_data"), ((n >= 24) & (n < 52), "moderate_data"), (trending, "trend")),
        "naive": codes((n >= 104, "enough_context"), ((n >= 52) & (n < 104), "marginal_context"), (n < 52, "limited_data"), (F.col("has_outliers"), "robust")),
    }
    rows = []
    for m in MODELS:
        if m in NEVER:
            rows.append(F.struct(F.lit(m).alias("model"), F.lit(0.0).alias("confidence"), F.lit(False).alias("recommended"), F.array(F.lit("disabled")).alias("reasons")))
        else:
            c = _clip01(conf[m])
            rows.append(F.struct(F.lit(m).alias("model"), c.alias("confidence"), (c >= limit[m]).alias("recommended"), why[m].alias("reasons")))
    return chars.select(*keys, F.inline(F.array(*rows)))


def advisor_models(sig: DataFrame) -> DataFrame:
    """Model set of the advisor with exclusions and their reasons, from score, growth and length."""
    hopeless = F.col("score") < 20
    no_naive = (F.col("total_growth_pct") > 200) | (F.col("n") < 104)
    full = F.when(no_naive, F.array(*[F.lit(m) for m in DEFAULT_SET if m != "naive"])).otherwise(F.array(*[F.lit(m) for m in DEFAULT_SET]))
    chosen = F.when(hopeless, F.array(F.lit("structural"), F.lit("ets"))).otherwise(full)
    why_naive = F.when(F.col("n") < 104, "naive:short_history").when(F.col("total_growth_pct") > 200, "naive:high_growth").when(hopeless, "naive:unforecastable")
    out = F.array_compact(F.array(*[F.lit(f"{m}:disabled") for m in NEVER], why_naive, F.when(hopeless, "theta:unforecastable")))
    return sig.withColumns({"recommended_models": chosen, "excluded_models": out})


def training_window(sig: DataFrame) -> DataFrame:
    """Rows of history to keep: shorter the stronger the growth, NULL for all."""
    g, n = F.col("total_growth_pct"), F.col("n")
    return sig.withColumn("training_window", F.when((g > 500) & (n > 104), 78).when((g > 200) & (n > 130), 104).when((g > 100) & (n > 156), 130))


def log_advice(df: DataFrame, keys: Keys, growth: DataFrame) -> DataFrame:
    """never, auto or always: from signs, level ratio, variance of the halves and growth."""
    rows = numbered(df, keys)
    n, t, y = F.col("n"), F.col("t"), F.col("y")
    k, mid = F.least(n, F.lit(52)), F.floor(n / 2)
    out = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), F.bool_or(y < 0).alias("negative"), F.avg(F.when(t >= n - k, y)).alias("recent"), F.avg(F.when(t < k, y)).alias("early"),
        F.var_pop(F.when(t < mid, y)).alias("v1"), F.var_pop(F.when(t >= mid, y)).alias("v2"))
    early = F.when(n > 52, F.col("early")).otherwise(F.col("recent"))
    out = out.withColumn("magnitude_ratio", F.greatest("recent", early) / F.greatest(F.least("recent", early), F.lit(1.0)))
    out = out.withColumn("variance_ratio", F.when((n >= 20) & (F.col("v1") > 0), F.col("v2") / F.col("v1")).otherwise(1.0))
    out = join_on_keys(out, growth.select(*keys, "total_growth_pct"), keys)
    g = F.col("total_growth_pct")
    mode = (F.when(F.col("negative"), "never").when((F.col("magnitude_ratio") > 10) & (g > 500), "always")
            .when((F.col("variance_ratio") > 4) & (g <= 100), "always").when(g > 100, "never").when(g > 50, "auto").otherwise("never"))
    return out.select(*keys, "magnitude_ratio", "variance_ratio", mode.alias("log_transform"))


def horizon_advice(sig: DataFrame, period: int, requested: int | None = None) -> DataFrame:
    """Longest reliable and recommended horizon from score and length; a request is kept and checked."""
    s = F.col("score")
    data = F.greatest(F.lit(1), F.floor(F.col("n") / 4)).cast("int")
    cap = bands(s, [(80, period), (60, period // 2), (40, period // 4), (20, period // 6)], 4)
    default = bands(s, [(60, period // 4), (40, 8)], 4)
    top = F.greatest(F.lit(1), F.least(data, cap))
    usual = F.greatest(F.lit(1), F.least(default, F.least(data, cap)))
    out = sig.withColumns({"max_reliable_horizon": top, "recommended_horizon": usual if requested is None else F.lit(requested)})
    return out.withColumn("horizon_ok", F.col("recommended_horizon") <= F.col("max_reliable_horizon"))


def simple_horizon(freq: str) -> int:
    return HORIZON.get(freq, 12)


def expected_mape(sig: DataFrame) -> DataFrame:
    """Error range to expect from the score, half as much again for small volumes."""
    s = F.col("score")
    low = bands(s, [(b, lo) for b, lo, _ in MAPE_BANDS], 35.0)
    high = bands(s, [(b, hi) for b, _, hi in MAPE_BANDS], 60.0)
    k = F.when(F.col("volume_level").isin("very_low", "low"), 1.5).otherwise(1.0)
    return sig.withColumns({"expected_mape_low": F.round(low * k, 1), "expected_mape_high": F.round(high * k, 1)})


def merge_advice(df: DataFrame, dims: Keys, period: int, scores: DataFrame | None = None, poor: float = 40.0, gain: float = 15.0) -> DataFrame:
    """Merges of weak slices along one dimension that raise the score by ``gain`` or more.

    All candidate merges of all dimensions are scored in one job.
    """
    if len(dims) < 2:
        raise ValueError("merging needs at least two dimensions")
    scores = forecastability(df, dims, period) if scores is None else scores
    weak = scores.where(F.col("score") < poor).select(*dims, "score")
    options = F.array(*[F.struct(F.lit(d).alias("varied_dim"), segment_id([c for c in dims if c != d], "/").alias("parent")) for d in dims])
    groups = weak.select("score", F.inline(options)).groupBy("varied_dim", "parent").agg(
        F.count(F.lit(1)).alias("n_slices"), F.avg("score").alias("avg_score")).where("n_slices >= 2")
    rows = df.join(weak.select(*dims), list(dims), "left_semi").select("ds", "y", F.inline(options))
    merged = rows.groupBy("varied_dim", "parent", "ds").agg(F.sum("y").alias("y")).join(groups.select("varied_dim", "parent"), ["varied_dim", "parent"], "left_semi")
    total = forecastability(merged, ["varied_dim", "parent"], period).where(F.col("n") >= 2 * period)
    out = groups.join(total.select("varied_dim", "parent", F.col("score").alias("combined_score")), ["varied_dim", "parent"])
    out = out.withColumn("improvement", F.col("combined_score") - F.col("avg_score")).where(F.col("improvement") >= gain)
    return out.orderBy(F.desc("improvement"), "varied_dim", "parent")


def advise_slices(df: DataFrame, dims: Keys, freq: str) -> DataFrame:
    """Full advice per slice: score, quality, models, window, expected error.  One job for all slices."""
    p = PERIOD[freq]
    sig = forecastability(df, dims, p)
    qual = slice_quality(df, dims, freq).select(*dims, "has_sufficient_history", "gap_count", "anomalous_count", "volume_level", F.col("warnings").alias("quality_warnings"))
    out = join_on_keys(sig, qual, dims)
    return out.transform(advisor_models).transform(training_window).transform(expected_mape)


def overall_quality(advice: DataFrame) -> DataFrame:
    """One row over all slices: counts and a label."""
    out = advice.agg(F.count(F.lit(1)).alias("total_slices"), F.count_if(F.col("score") >= 40).alias("forecastable_slices"),
                     F.bool_and("has_sufficient_history").alias("all_long"))
    ok, n = F.col("forecastable_slices"), F.col("total_slices")
    label = (F.when(F.col("all_long") & (ok >= n * 0.7), F.when(ok == n, "EXCELLENT").otherwise("GOOD")).when(ok >= n * 0.5, "FAIR").otherwise("POOR"))
    return out.select("total_slices", "forecastable_slices", (n - ok).alias("problematic_slices"), label.alias("overall_data_quality"))


def auto_configure(df: DataFrame, keys: Keys, freq: str, requested: int | None = None) -> DataFrame:
    """Training configuration of each series on its own: models, window and its first date, log scale, horizon, expected error."""
    p = PERIOD[freq]
    sig = forecastability(df, keys, p).withColumn("volume_level", F.lit("medium"))
    out = sig.transform(advisor_models).transform(training_window).transform(lambda s: horizon_advice(s, p, requested)).transform(expected_mape)
    out = join_on_keys(out, log_advice(df, keys, sig), keys)
    dates = join_on_keys(numbered(df, keys).select(*keys, "ds", "t"), out.select(*keys, F.col("n").alias("_n"), "training_window"), keys)
    first = dates.where((F.col("_n") > F.col("training_window")) & (F.col("t") == F.col("_n") - F.col("training_window"))).select(*keys, F.col("ds").alias("from_date"))
    return join_on_keys(out, first, keys, "left")


def _values(*v: object) -> Column:
    return F.array(*[F.lit(str(x)) for x in v])


def candidate_grid(chars: DataFrame, keys: Keys) -> DataFrame:
    """Parameter lists per series, model and parameter, narrowed by length, spread, signs and seasonality."""
    n, none = F.col("n_observations"), F.lit(None).cast("array<string>")
    small, mid = n < 50, n < 100

    def orders(m: str) -> list[tuple[str, str, Column]]:
        return [(m, "p", F.when(small, _values(0, 1, 2)).when(mid, _values(0, 1, 2, 3))), (m, "d", F.when(small, _values(0, 1)).when(mid, _values(0, 1, 2))),
                (m, "q", F.when(small, _values(0, 1, 2)).when(mid, _values(0, 1, 2, 3)))]

    additive = F.col("has_negative")
    rows = [
        ("structural", "trend_flexibility", F.when(n < 52, _values(0.01, 0.05, 0.1)).when(n < 104, _values(0.01, 0.05, 0.1, 0.5))),
        ("structural", "season_flexibility", F.when(n < 52, _values(0.1, 1.0)).when(n < 104, _values(0.1, 1.0, 10.0))),
        ("structural", "yearly", F.when(F.col("n_years") < 2, _values("false"))),
        ("structural", "weekly", F.when(F.col("frequency") == "daily", _values("true")).when(F.col("frequency") == "monthly", _values("false"))),
        ("structural", "season_mode", F.array(F.col("season_mode"))),
        *orders("arima"), *orders("sarimax"),
        ("ets", "trend", F.when(additive, _values("none", "add"))),
        ("ets", "seasonal", F.when(additive, _values("none", "add")).when(F.col("seasonality_type") == "none", _values("none"))),
        ("boosted", "n_trees", F.when(mid, _values(50, 100)).when(n < 500, _values(100, 200))),
        ("boosted", "depth", F.when(mid, _values(3)).when(n < 500, _values(3, 5))),
        ("boosted", "rate", F.when(F.col("cv") > 1, _values(0.01, 0.05)).when(mid, _values(0.1)).when(n < 500, _values(0.05, 0.1))),
        ("theta", "season_length", F.array(F.coalesce(*[F.when(F.col("frequency") == f, F.lit(str(k))) for f, k in PERIOD.items()], F.lit("12")))),
        ("theta", "variant", F.when(n < 24, _values("auto")).when(n < 52, _values("auto", "arima")).otherwise(_values("auto", "arima", "ets", "theta"))),
        ("naive", "samples", F.when(F.col("has_outliers") | (F.col("cv") > 0.5), _values(200)).otherwise(_values(100))),
    ]
    all_rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(p).alias("param"), F.coalesce(v, none).alias("values")) for m, p, v in rows])
    return chars.select(*keys, F.inline(all_rows)).where(F.col("values").isNotNull())


def profile_grid(profile: DataFrame, keys: Keys) -> DataFrame:
    """The same from a profile row, with full lists for long series."""
    n, years = F.col("unique_periods"), F.col("history_months") / 12
    small, mid = n < 50, n < 100
    t, s = F.col("has_trend"), F.col("has_seasonality")

    def orders(m: str, top: Column) -> list[tuple[str, str, Column]]:
        pq = F.when(small, _values(0, 1, 2)).when(mid, _values(0, 1, 2, 3)).otherwise(top)
        return [(m, "p", pq), (m, "d", F.when(small, _values(0, 1)).otherwise(_values(0, 1, 2))), (m, "q", pq)]

    rows = [
        ("structural", "trend_flexibility", F.when(n < 52, _values(0.01, 0.05, 0.1)).when(n < 104, _values(0.01, 0.05, 0.1, 0.5)).otherwise(_values(0.01, 0.05, 0.1, 0.5, 1.0))),
        ("structural", "season_flexibility", F.when(n < 52, _values(0.1, 1.0)).otherwise(_values(0.1, 1.0, 10.0))),
        ("structural", "yearly", F.when(years < 2, _values("false"))),
        ("structural", "weekly", F.when(F.col("frequency") == "daily", _values("true")).when(F.col("frequency") == "monthly", _values("false"))),
        ("structural", "season_mode", F.when(t & s, _values("multiplicative")).when(s, _values("additive", "multiplicative")).otherwise(_values("additive"))),
        *orders("arima", _values(0, 1, 2, 3, 4)), *orders("sarimax", _values(0, 1, 2, 3)),
        ("ets", "trend", F.when(t, _values("add", "mul")).otherwise(_values("none", "add"))),
        ("ets", "damped", F.when(t, _values("true", "false")).otherwise(_values("false"))),
        ("ets", "seasonal", F.when(s, _values("add", "mul")).otherwise(_values("none"))),
        ("boosted", "n_trees", F.when(mid, _values(50, 100)).when(n < 500, _values(100, 200)).otherwise(_values(100, 200, 300))),
        ("boosted", "depth", F.when(mid, _values(3)).when(n < 500, _values(3, 5)).otherwise(_values(3, 5, 7))),
        ("boosted", "rate", F.when(F.col("data_quality_score") < 70, _values(0.01, 0.05)).when(mid, _values(0.1)).when(n < 500, _values(0.05, 0.1)).otherwise(_values(0.01, 0.05, 0.1))),
    ]
    none = F.lit(None).cast("array<string>")
    all_rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(p).alias("param"), F.coalesce(v, none).alias("values")) for m, p, v in rows])
    return profile.select(*keys, F.inline(all_rows)).where(F.col("values").isNotNull())


def default_params(profile: DataFrame, keys: Keys) -> DataFrame:
    """One map of default parameters per series and model."""
    t, s, months = F.col("has_trend"), F.col("has_seasonality"), F.col("history_months")

    def text(c: Column) -> Column:
        return c.cast("string")

    def pick(cond: Column, a: object, b: object) -> Column:
        return F.when(cond, F.lit(str(a))).otherwise(F.lit(str(b)))

    period = F.coalesce(text(F.col("seasonality_period")), F.lit("none"))
    params: dict[str, dict[str, Column]] = {
        "structural": {"season_mode": F.lit("multiplicative"), "yearly": text(months >= 12), "weekly": text(F.col("frequency") == "daily"), "growth": F.lit("linear"),
                       "trend_flexibility": pick(t, 0.05, 0.01), "season_flexibility": pick(s, 10.0, 1.0)},
        "arima": {"max_p": F.lit("5"), "max_q": F.lit("5"), "max_d": F.lit("2"), "seasonal": text(s), "m": period},
        "boosted": {"n_trees": pick(months < 24, 100, 200), "depth": F.lit("5"), "rate": F.lit("0.1"), "row_share": F.lit("0.8"), "column_share": F.lit("0.8")},
        "ets": {"error": F.lit("add"), "trend": pick(t, "add", "none"), "seasonal": pick(s, "add", "none"), "damped": text(t), "m": period},
        "sarimax": {"order": F.lit("1,1,1"), "seasonal_order": F.when(s, F.concat(F.lit("1,1,1,"), period)).otherwise("none")},
    }
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.create_map(*[x for k, v in ps.items() for x in (F.lit(k), v)]).alias("params")) for m, ps in params.items()])
    return profile.select(*keys, F.inline(rows))


def eligible_models(profile: DataFrame, n: str = "n_rows") -> DataFrame:
    """Models a series is long enough for; the structural one when it is too short for all."""
    fit = codes(*[(F.col(n) >= k, m) for m, k in MIN_LENGTH.items()])
    return profile.withColumn("eligible", F.when(F.size(fit) == 0, F.array(F.lit("structural"))).otherwise(fit))


def preset(profile: DataFrame, minutes: int | None = None, n: str = "n_rows") -> DataFrame:
    """Effort level from a time budget, else from the length."""
    if minutes is not None:
        level = PRESETS[sum(minutes >= m for m in (5, 15, 45))]
        return profile.withColumn("preset", F.lit(level))
    return profile.withColumn("preset", bands(F.col(n), [(50, "fast"), (100, "medium"), (200, "high_quality")], "best", "lt"))


def recommendation_row(chars: DataFrame, models: DataFrame, keys: Keys) -> DataFrame:
    """Overall recommendation per series: quality, patterns and the two most confident models as codes."""
    place = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    best = models.where("recommended").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), place.alias("p"), "model"))).alias("m"))
    out = join_on_keys(chars, best, keys, "left")
    by_rank = F.transform(F.slice("m", 1, 2), lambda x: x["model"])
    status = F.when(F.col("quality") == "insufficient", "insufficient").when(F.col("quality") == "poor", "poor").otherwise("ok")
    patterns = F.array_compact(F.array(
        F.when(F.col("trend_type") != "flat", F.concat("trend_type", F.lit("_trend"))),
        F.when(F.col("seasonality_type") != "none", F.concat("seasonality_type", F.lit("_seasonality")))))
    return out.select(*keys, status.alias("status"), "quality", "quality_score", "n_observations", F.round("n_years", 1).alias("n_years"), patterns.alias("patterns"),
                      F.coalesce(by_rank, F.array().cast("array<string>")).alias("top_models"))


