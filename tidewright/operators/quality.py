"""Data quality: validation with repair, scores, leak checks, fingerprints, profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import Keys, bands, by, codes, correlation, join_on_keys, median, ordered, percentile, running
from .columns import per_column
from .quantiles import exact_quantiles
from .windows import flag_incomplete_tail, gap_limit, global_rank

# fixed values -----------------------------------------------------------------------------
MIN_ROWS = {"daily": (90, 365, 7), "weekly": (26, 104, 52), "monthly": (12, 36, 12)}  # minimum, recommended, cycle
FUTURE_WORDS = ("future", "next", "forward", "ahead", "predict", "forecast")
LAG_ROWS = {"daily": (400, 7), "weekly": (60, 52), "monthly": (15, 12)}
HORIZON = {"daily": 30, "weekly": 12, "monthly": 6}
# ------------------------------------------------------------------------------------------


def _repair(df: DataFrame, keys: Keys, freq: str, order: Sequence[str], fix: bool, variant: str) -> DataFrame:
    """Rows after filling, de-duplication, winsorising and tail marking, with the numbers each step saw."""
    w = by(keys)
    rows = df.select(*keys, "ds", F.col("y").cast("double").alias("y"), *order)
    seq = ["ds", *order]
    n_rows, nulls = F.count(F.lit(1)).over(w), F.count_if(F.col("y").isNull()).over(w)
    rows = rows.withColumns({"n_rows": n_rows, "null_count": nulls})
    rows = rows.withColumn("null_pct", F.col("null_count") / F.col("n_rows") * 100)
    ahead = F.last("y", ignorenulls=True).over(running(keys, W.unboundedPreceding, 0, *seq))
    back = F.first("y", ignorenulls=True).over(running(keys, 0, W.unboundedFollowing, *seq))
    filled = F.coalesce("y", ahead, back if variant == "automl" else F.lit(0.0))
    if fix:
        rows = rows.withColumn("y", F.when(F.col("null_pct") <= 20, filled).otherwise(F.col("y")))
    same = W.partitionBy(*keys, "ds")
    rows = rows.withColumn("_back", F.row_number().over(same.orderBy(*[F.desc(c) for c in order] or [F.desc("y")])))
    rows = rows.withColumn("duplicate_dates", F.count_if(F.col("_back") > 1).over(w))
    if fix:
        rows = rows.where(F.col("_back") == 1)
    rows = rows.withColumn("_gap", F.datediff("ds", F.lag("ds").over(ordered(keys, *seq))))
    rows = rows.withColumns({"_q1": percentile(F.col("y"), 0.25).over(w), "_q3": percentile(F.col("y"), 0.75).over(w)})
    iqr = F.col("_q3") - F.col("_q1")
    rows = rows.withColumns({"_lo": F.col("_q1") - 3 * iqr, "_hi": F.col("_q3") + 3 * iqr})
    rows = rows.withColumn("_out", F.coalesce((F.col("y") < F.col("_lo")) | (F.col("y") > F.col("_hi")), F.lit(False)))
    rows = rows.withColumn("n_outliers", F.count_if("_out").over(w))
    rows = rows.withColumn("outlier_pct", F.col("n_outliers") / F.col("n_rows") * 100)
    if fix:
        rows = rows.withColumn("y", F.when(F.col("_out") & (F.col("outlier_pct") <= 10), F.least(F.greatest("y", "_lo"), "_hi")).otherwise(F.col("y")))
    if variant == "automl":
        return rows.withColumn("is_tail", F.lit(False))
    return flag_incomplete_tail(rows, keys)


def validate_quality(df: DataFrame, keys: Keys, freq: str, fix: bool = True, order: Sequence[str] = (),
                     variant: str = "standard") -> tuple[DataFrame, DataFrame]:
    """Nine checks in fixed order with repair: ``(cleaned rows, one report row per series)``.

    ``order`` decides which of several rows of a date is the last.  The variant ``automl`` also fills
    backwards, reports small outlier counts and leaves the tail alone.
    """
    need, want, cycle = MIN_ROWS[freq]
    rows = _repair(df, keys, freq, order, fix, variant)
    cleaned = rows.where(~F.col("is_tail") if fix else F.lit(True)).select(*keys, "ds", "y")
    one = ("n_rows", "null_count", "null_pct", "duplicate_dates", "n_outliers", "outlier_pct")
    rep = rows.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in one], F.count_if(F.col("_gap") > gap_limit(freq, "quality")).alias("gaps"),
        F.count_if(F.col("y") < 0).alias("n_negative"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"),
        F.count_if("is_tail").alias("n_tail"), F.array_sort(F.collect_list(F.when(F.col("is_tail"), F.col("ds")))).alias("tail_dates"))
    cv = F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(0.0)
    rep = rep.withColumns({"cv": cv, "cycles": F.col("n_rows") / cycle})
    few = F.col("n_rows") < need
    limited = ~few & (F.col("n_rows") < want)
    outlying = F.col("outlier_pct") > 10
    some = (F.col("n_outliers") > 0) & ~outlying if variant == "automl" else F.lit(False)
    low, high = F.col("cv") < 0.01, F.col("cv") > 2
    return cleaned, rep.select(
        *keys, (~few & (F.col("null_pct") <= 20)).alias("is_valid"), *one, "gaps", "n_negative", "mean", "std", "cv", "cycles", "n_tail", "tail_dates",
        codes((few, "insufficient_data"), (F.col("null_pct") > 20, "high_missing"), (F.col("duplicate_dates") > 0, "duplicate_dates")).alias("issues"),
        codes((limited, "limited_data"), ((F.col("null_pct") > 5) & (F.col("null_pct") <= 20), "moderate_missing"), (F.col("gaps") > 0, "gaps"),
              (outlying, "many_outliers"), (some, "outliers"), (F.col("n_negative") > 0, "negatives"), (low, "low_variance"), (high, "high_variance"),
              (F.col("cycles") < 2, "few_cycles"), (F.col("n_tail") > 0, "incomplete_tail")).alias("warnings"),
        codes((limited, "simpler_models"), (F.col("gaps") > 0, "interpolate"), (outlying, "treat_outliers"), (low, "constant_data"),
              (high, "log_transform"), (F.col("cycles") < 2, "no_yearly_season")).alias("recommendations"),
        codes(((F.col("null_count") > 0) & (F.col("null_pct") <= 20), "filled"), (F.col("duplicate_dates") > 0, "deduplicated"),
              ((F.col("n_outliers") > 0) & ~outlying, "winsorized"), (F.col("n_tail") > 0, "dropped_tail")).alias("repairs") if fix
        else F.array().cast("array<string>").alias("repairs"))


def iqr_outliers(df: DataFrame, keys: Keys, k: float = 1.5, min_n: int = 10, y: str = "y") -> DataFrame:
    """Values outside the quartile fences, with side and share of the series."""
    known = df.where(F.col(y).isNotNull()).select(*keys, "ds", y)
    stats = exact_quantiles(known, keys, y, {"_q1": 0.25, "_q3": 0.75})
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_n)
    rows = join_on_keys(join_on_keys(known, stats, keys), counts, keys)
    iqr = F.col("_q3") - F.col("_q1")
    lo, hi = F.col("_q1") - k * iqr, F.col("_q3") + k * iqr
    rows = rows.select(*keys, "ds", y, "_n", lo.alias("lower"), hi.alias("upper"))
    side = F.when(F.col(y) < F.col("lower"), "low").when(F.col(y) > F.col("upper"), "high")
    found = rows.withColumn("side", side).where(F.col("side").isNotNull())
    share = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    return join_on_keys(found, share, keys).withColumn("outlier_pct", F.col("_k") / F.col("_n") * 100).drop("_n", "_k")


def _expected(freq: str) -> Column:
    lo, hi = F.col("start"), F.col("end")
    if freq == "monthly":
        return (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo) + 1
    days = F.datediff(hi, lo)
    return F.floor(days / 7) + 1 if freq == "weekly" else days + 1


def quality_summary(df: DataFrame, keys: Keys, freq: str, y: str = "y") -> DataFrame:
    """Volume, range, gaps, missing, zeros and spread with quick-win codes."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ds").alias("start"), F.max("ds").alias("end"), F.count_distinct("ds").alias("actual_periods"),
        F.count_if(F.col(y).isNull()).alias("missing"), F.count_if(F.col(y) == 0).alias("zeros"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"), F.max(y).alias("max"))
    out = out.withColumn("expected_periods", _expected(freq))
    out = out.withColumns({
        "gap_count": F.greatest(F.lit(0), F.col("expected_periods") - F.col("actual_periods")), "missing_pct": F.col("missing") / F.col("n_rows") * 100,
        "zero_pct": F.col("zeros") / F.col("n_rows") * 100, "cv": F.when(F.col("mean") != 0, F.col("std") / F.col("mean")),
        "is_sufficient": F.col("n_rows") >= 24, "span_days": F.datediff("end", "start")})
    wins = codes((F.col("gap_count") > 0, "missing_periods"), (F.col("missing_pct") > 10, "missing_values"), (F.col("zero_pct") > 5, "zero_values"),
                 (F.col("cv") > 1, "variability"))
    return out.withColumn("quick_wins", wins)


def quality_score(profile: DataFrame) -> DataFrame:
    """0..100 from missing values, missing periods and outliers, with a bonus for long history."""
    rows, periods = F.col("row_count"), F.col("unique_periods")
    score = 100 - F.coalesce(F.least(F.try_divide(F.col("missing_values"), rows) * 100, F.lit(30)), F.lit(0))
    score = score - F.coalesce(F.least(F.try_divide(F.col("n_missing_periods"), periods + F.col("n_missing_periods")) * 150, F.lit(30)), F.lit(0))
    score = score - F.coalesce(F.least(F.try_divide(F.col("n_outliers"), rows) * 50, F.lit(10)), F.lit(0))
    bonus = F.when(periods >= 104, 10).when(periods >= 52, 5).otherwise(0)
    score = F.when(bonus > 0, F.least(score + bonus, F.lit(100))).otherwise(score)
    return profile.withColumn("data_quality_score", F.round(F.greatest(score, F.lit(0)), 1))


def quality_grade(chars: DataFrame) -> DataFrame:
    """Score and grade from length, gaps, spread, outliers and found patterns."""
    n, years = F.col("n_observations"), F.col("n_years")
    score = F.lit(100.0) - F.when(n < 12, 50).when(n < 24, 30).when(n < 52, 15).otherwise(0)
    score = score - F.when(years < 1, 20).when(years < 2, 10).otherwise(0)
    score = score - F.least(F.lit(20), F.col("gap_count") * 2) - F.when(F.col("cv") > 1, 10).otherwise(0)
    score = score - F.when(F.col("outlier_pct") > 5, 15).when(F.col("outlier_pct") > 2, 5).otherwise(0)
    score = score + F.when(F.col("seasonality_type").isin("strong", "moderate"), 5).otherwise(0) + F.when(F.col("trend_strength") > 0.5, 5).otherwise(0)
    out = chars.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    return out.withColumn("quality", bands(F.col("quality_score"), [(80, "excellent"), (60, "good"), (40, "fair"), (20, "poor")], "insufficient"))


def slice_quality(df: DataFrame, keys: Keys, freq: str, y: str = "y") -> DataFrame:
    """Readiness of each slice: history, missing share, gaps, anomalous periods (first ten) and volume class."""
    from .base import PERIOD

    p = PERIOD[freq]
    w = by(keys)
    rows = df.select(*keys, "ds", F.col(y).alias("y"), F.datediff("ds", F.lag("ds").over(ordered(keys))).alias("_gap"),
                     percentile(F.col(y), 0.25).over(w).alias("_q1"), percentile(F.col(y), 0.75).over(w).alias("_q3"))
    iqr = F.col("_q3") - F.col("_q1")
    bad = (F.col("y") < F.col("_q1") - 2 * iqr) | (F.col("y") > F.col("_q3") + 2 * iqr)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"), F.avg("y").alias("period_mean"), F.count_if(F.col("y").isNull()).alias("_nulls"),
        F.count_if(F.col("_gap") > gap_limit(freq, "slice")).alias("gap_count"), F.count_if(bad).alias("_bad"),
        F.array_sort(F.collect_list(F.when(bad, F.col("ds")))).alias("_dates"))
    n = F.col("n_observations")
    out = out.withColumns({
        "has_sufficient_history": n >= 2 * p, "missing_pct": F.col("_nulls") / n * 100,
        "anomalous_count": F.when(n >= 10, F.col("_bad")).otherwise(0),
        "anomalous_dates": F.when(n >= 10, F.slice("_dates", 1, 10)).otherwise(F.array().cast("array<date>"))})
    out = volume_class(out.drop("_nulls", "_bad", "_dates"), keys, "period_mean")
    return out.withColumn("warnings", codes(
        (~F.col("has_sufficient_history"), "insufficient_history"), (F.col("gap_count") > 0, "gaps"), (F.col("missing_pct") > 5, "missing"),
        (F.col("anomalous_count") > n * 0.05, "anomalous")))


def volume_class(means: DataFrame, keys: Keys, col: str = "period_mean") -> DataFrame:
    """Volume of each series among its peers by order statistics at the quintiles (element int(n·q), not interpolated)."""
    # a mean may differ in its last bits between two evaluations; rounding keeps "equal to the cut" stable
    v = F.round(col, 6)
    peers = means.where(F.col(col).isNotNull()).select(*keys, v.alias("m"))
    ranked = global_rank(peers, F.col("m"), ties=list(keys))
    n = peers.agg(F.count(F.lit(1)).alias("n"))
    at = {f"p{int(q * 100)}": F.max(F.when(F.col("rank") == F.floor(F.col("n") * F.lit(q)) + 1, F.col("m"))).alias(f"p{int(q * 100)}") for q in (0.2, 0.4, 0.6, 0.8)}
    cuts = ranked.crossJoin(F.broadcast(n)).agg(F.max("n").alias("_n"), *at.values())
    label = (F.when(F.col("_n") < 2, "medium").when(v <= F.col("p20"), "very_low").when(v <= F.col("p40"), "low").when(v <= F.col("p60"), "medium")
             .when(v <= F.col("p80"), "high").otherwise("very_high"))
    return means.crossJoin(F.broadcast(cuts)).withColumn("volume_level", label).drop("_n", *at)


def leaky_covariates(df: DataFrame, y: str, covs: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Correlation of each covariate with the target: leaky from the threshold, watched from 0.7.  One pass.
    A covariate that never changes, like a flag set everywhere, has none and is left out."""
    out = per_column(df, covs, lambda c: {
        "n": F.count_if(F.col(y).isNotNull() & F.col(c).isNotNull()), "correlation": correlation(F.col(y), F.col(c))})
    a = F.abs("correlation")
    out = out.where((F.col("n") >= 10) & F.col("correlation").isNotNull() & ~F.isnan("correlation") & (a >= 0.7))
    return out.select("column", "correlation", (a >= threshold).alias("is_leaky"))


def leak_risk(df: DataFrame, y: str, feats: Sequence[str]) -> DataFrame:
    """Risk of each feature to know the target: correlation, lag below one, names that speak of the future."""
    total = F.count(y)
    out = per_column(df, feats, lambda c: {
        "corr": F.when((total == F.count(c)) & (total > 10) & (F.count_if(F.col(y).isNotNull() & F.col(c).isNotNull()) > 10),
                       correlation(F.col(y), F.col(c)))})
    a = F.abs(F.nanvl(F.col("corr"), F.lit(0.0)))
    bad_lag = F.coalesce(F.regexp_extract("column", "^lag_(-?[0-9]+)(_|$)", 1).try_cast("int") < 1, F.lit(False))
    named = F.lower("column").rlike("|".join(FUTURE_WORDS))
    risk = F.when((a > 0.95) | bad_lag, "high").when((a > 0.85) | named, "medium").otherwise("low")
    return out.select("column", "corr", risk.alias("risk"), codes(
        (a > 0.95, "very_high_correlation"), ((a > 0.85) & (a <= 0.95), "high_correlation"), (bad_lag, "lag_below_one"), (named, "future_name")).alias("reasons"))


def check_split(train: DataFrame, test: DataFrame, keys: Keys) -> DataFrame:
    """Do train and test share dates, is test strictly later, how long is the gap?"""
    cols = [*keys, "ds"]
    tagged = train.select(*cols, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(test.select(*cols, F.lit(0).alias("a"), F.lit(1).alias("b")))
    days = tagged.groupBy(*cols).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    in_a, in_b = F.col("a") == 1, F.col("b") == 1
    out = days.groupBy(*keys).agg(
        F.min(F.when(in_a, F.col("ds"))).alias("train_start"), F.max(F.when(in_a, F.col("ds"))).alias("train_end"),
        F.min(F.when(in_b, F.col("ds"))).alias("test_start"), F.max(F.when(in_b, F.col("ds"))).alias("test_end"),
        F.count_if(in_a & in_b).alias("n_overlap"), F.min(F.when(in_a & in_b, F.col("ds"))).alias("first_overlap"))
    gap = F.datediff("test_start", "train_end")
    late = F.col("test_start") <= F.col("train_end")
    return out.select("*", gap.alias("gap_days"), codes((F.col("n_overlap") > 0, "overlap"), (late, "test_not_after_train")).alias("violations"),
                      ((F.col("n_overlap") == 0) & ~late).alias("is_valid"), (gap > 1).alias("has_gap"))


def assert_split(train: DataFrame, test: DataFrame, keys: Keys) -> None:
    """Raise where a series of the split leaks; a few offenders are named."""
    bad = check_split(train, test, keys).where(~F.col("is_valid")).limit(5).collect()
    if bad:
        raise ValueError(f"train and test overlap: {[{k: r[k] for k in (*keys, 'violations')} for r in bad]}")


def future_rows(df: DataFrame, keys: Keys, covs: Sequence[str], y: str = "y") -> DataFrame:
    """Rows without target that carry covariates: count, range, validity and issue codes per series."""
    any_cov = None
    for c in covs:
        any_cov = F.col(c).isNotNull() if any_cov is None else any_cov | F.col(c).isNotNull()
    rows = df.withColumn("_f", F.col(y).isNull() & any_cov)
    past = F.when(~F.col("_f"), F.col("ds"))
    hist = rows.groupBy(*keys).agg(
        F.max(past).alias("_last"), *[x for c in covs for x in (
            F.avg(F.when(~F.col("_f"), F.col(c))).alias(f"_m_{c}"), F.stddev_samp(F.when(~F.col("_f"), F.col(c))).alias(f"_s_{c}"))])
    fut = join_on_keys(rows.where("_f"), hist, keys, "left")
    fut = fut.withColumn("_gap", F.datediff("ds", F.lag("ds").over(ordered(keys))))
    fut = fut.withColumn("_mg", median(F.col("_gap")).over(by(keys)))
    extreme = {c: (F.col(f"_s_{c}") > 0) & (F.abs(F.col(c) - F.col(f"_m_{c}")) > 5 * F.col(f"_s_{c}")) for c in covs}
    out = fut.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_future"), F.min("ds").alias("future_start"), F.max("ds").alias("future_end"), F.max("_last").alias("last_history"),
        F.count_if(F.col("ds") < F.col("_last")).alias("n_interspersed"), F.count_if(F.col("_gap") > 3 * F.col("_mg")).alias("n_large_gaps"),
        *[x for c in covs for x in (F.count_if(F.col(c).isNull()).alias(f"_z_{c}"), F.count_if(F.coalesce(extreme[c], F.lit(False))).alias(f"_x_{c}"))])
    n = F.col("n_future")
    issues = codes(
        (F.col("n_interspersed") > 0, "interspersed"), (F.col("n_large_gaps") > 0, "large_gaps"),
        *[((F.col(f"_z_{c}") > 0) & (F.col(f"_z_{c}") < n), f"partial_{c}") for c in covs], *[(F.col(f"_x_{c}") > 0, f"extreme_{c}") for c in covs],
        (F.datediff("future_end", "last_history") > 730, "far_ahead"))
    return out.select(*keys, "n_future", "future_start", "future_end", "n_interspersed", "n_large_gaps", (F.col("n_interspersed") == 0).alias("is_valid"), issues.alias("issues"))


def align_weeks(df: DataFrame, keys: Keys, anchor: int | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """Move each date to the nearest anchor weekday (forward on ties); adds the share of rows off the anchor.

    The anchor is given, taken from ``anchors`` (keys, weekday), or the most frequent weekday.
    """
    from .roles import week_anchor

    if anchor is not None:
        out = df.withColumn("weekday", F.lit(anchor))
    else:
        table = (anchors if anchors is not None else week_anchor(df, keys)).select(*keys, "weekday")
        out = join_on_keys(df, table, keys, "left")
    ahead = F.pmod(F.col("weekday") - F.weekday("ds"), F.lit(7))
    off = F.weekday("ds") != F.col("weekday")
    share = F.count_if(off).over(by(keys)) / F.count(F.lit(1)).over(by(keys)) * 100
    moved = F.when(ahead <= 7 - ahead, F.date_add("ds", ahead)).otherwise(F.date_sub("ds", 7 - ahead))
    return out.select(*[c for c in df.columns if c != "ds"], F.col("ds").alias("ds_raw"), moved.alias("ds"), off.alias("was_off"), share.alias("off_pct"))


def lag_sufficiency(df: DataFrame, keys: Keys, freq: str) -> DataFrame:
    """Is there history enough for year-over-year lags and for two cycles?"""
    need, cycle = LAG_ROWS[freq]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return out.select("*", (F.col("n_rows") >= need).alias("can_add_yoy_lag"), (F.col("n_rows") >= 2 * cycle).alias("can_add_seasonal"),
                      F.lit(need).alias("recommended_min_rows"), F.lit(cycle).alias("seasonal_period"))


def row_hash(df: DataFrame) -> Column:
    """First 60 bits of the SHA-256 of a row with its columns in name order."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, hash)`` that does not depend on row order or partitioning."""
    out = df.select(row_hash(df).alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("s"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"))
    token = F.concat_ws(":", F.col("n_rows").cast("string"), "s", F.col("x").cast("string"))
    return out.select("n_rows", F.substring(F.sha2(token, 256), 1, 16).alias("hash"))


def verify(df: DataFrame, expected: str) -> DataFrame:
    """Does a table still have the stored hash?"""
    return fingerprint(df).withColumn("is_intact", F.col("hash") == expected)


def profile_warnings(profile: DataFrame) -> DataFrame:
    """Warning codes ``level:what`` of a profile row."""
    months, mv, mp = F.col("history_months"), F.col("missing_values"), F.col("n_missing_periods")
    return profile.withColumn("warnings", codes(
        (months < 12, "high:history"), ((months >= 12) & (months < 24), "medium:history"), (F.col("holiday_coverage") < 50, "medium:holiday_coverage"),
        ((mv > 0) & (mv < 5), "low:missing_values"), (mv >= 5, "medium:missing_values"),
        ((mp > 0) & (mp < 5), "low:missing_periods"), ((mp >= 5) & (mp < 10), "medium:missing_periods"), (mp >= 10, "high:missing_periods"),
        (F.col("data_quality_score") < 70, "high:quality_score")))
