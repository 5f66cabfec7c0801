"""Profile of every series: the facts a forecast is configured from, one row per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import signals as S
from ..operators import windows as WN
from ..operators.base import Keys, PERIOD, by, join_on_keys
from ..operators.events import holiday_coverage
from ..operators.joins import missing_periods


def profile(rows: DataFrame, keys: Keys, freq: str, covs: Sequence[str] = ()) -> DataFrame:
    """``rows`` holds keys, ds, y and covariates, possibly several rows per date.

    The rows are read once and reduced to one per date (map-side combined); everything else works on that.
    """
    days = WN.day_counts(rows, keys)
    base = days.groupBy(*keys).agg(
        F.sum("rows").alias("row_count"), F.min("ds").alias("start"), F.max("ds").alias("end"), F.count(F.lit(1)).alias("unique_periods"),
        (F.sum("rows") - F.sum("c")).alias("missing_values"))
    base = base.withColumns({
        "history_months": F.round(F.datediff("end", "start") / 30.44, 1), "has_multiple_slices": F.col("row_count") > F.col("unique_periods"),
        "slice_count": F.floor(F.col("row_count") / F.col("unique_periods"))})
    panel = days.select(*keys, "ds", F.when(F.col("c") > 0, F.col("v")).alias("y"))
    w = by(keys)
    lines = S.numbered(panel, keys)
    lines = lines.withColumns({"_q1": F.percentile("y", F.lit(0.25)).over(w), "_q3": F.percentile("y", F.lit(0.75)).over(w)})
    iqr = F.col("_q3") - F.col("_q1")
    out = (F.col("y") < F.col("_q1") - 1.5 * iqr) | (F.col("y") > F.col("_q3") + 1.5 * iqr)
    shape = lines.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= 10, F.count_if(out)).otherwise(0).alias("n_outliers"),
        F.coalesce((F.count(F.lit(1)) >= 10) & (F.abs(F.regr_slope("y", "t")) > F.stddev_pop("y") * 0.01), F.lit(False)).alias("has_trend"))
    season = S.circular_acf(panel, keys, PERIOD[freq]).select(*keys, "has_seasonality")
    gaps = missing_periods(panel, keys, freq).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_missing_periods"))
    final = WN.incomplete_final_day(days, keys).select(*keys, F.col("is_incomplete").alias("has_incomplete_final_period"))
    cover = holiday_coverage(panel, keys, freq).select(*keys, "holiday_coverage")
    prof = base
    for part in (shape, season, gaps, final, cover):
        prof = join_on_keys(prof, part, keys, "left")
    prof = prof.fillna(0, ["n_missing_periods", "n_outliers"]).fillna(0.0, ["holiday_coverage"])
    prof = Q.profile_warnings(Q.quality_score(prof))
    models = F.array_compact(F.array(
        F.lit("structural"), F.when((F.col("history_months") >= 12) & F.lit(bool(covs)), "boosted"), F.when(F.col("has_seasonality"), "arima"),
        F.when(F.col("history_months") < 24, "ets")))
    return prof.withColumns({
        "frequency": F.lit(freq), "recommended_horizon": F.lit(Q.HORIZON[freq]), "recommended_models": models,
        "seasonality_period": F.when(F.col("has_seasonality"), PERIOD[freq])})


