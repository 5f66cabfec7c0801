"""Fallback ladder: what a level forecasts badly is fitted again at the next one, and only that."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import cut_lineage
from ..base import Keys
from ..checks import flat_forecast, reasonableness
from .select import Forecaster


def doubts(fc: DataFrame, hist: DataFrame, future: DataFrame, keys: Keys) -> DataFrame:
    """Columns keys and reason, one row per series of ``future``: ``failed`` where a row has no finite forecast, ``flat``,
    ``mean_level`` (its mean is beyond five times, or below a fifth, of the history's), ``negative`` where no value of the
    history is; null if none holds. The first that holds is named."""
    keys = list(keys)
    finite = F.col("yhat").isNotNull() & ~F.isnan("yhat") & (F.abs("yhat") < float("inf"))
    wanted = future.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    got = fc.groupBy(*keys).agg(F.count_if(finite).alias("_ok"), F.min("yhat").alias("_low"))
    past = hist.groupBy(*keys).agg(F.min("y").alias("_least"))
    flat = flat_forecast(fc.where(finite), hist, keys, keys).select(*keys, "is_flat")
    level = reasonableness(fc.where(finite), hist, keys, keys).select(*keys, "is_reasonable")
    out = wanted
    for part in (got, past, flat, level):
        out = out.join(part, keys, "left")
    reason = (F.when(F.coalesce("_ok", F.lit(0)) < F.col("_n"), "failed").when(F.col("is_flat"), "flat").when(~F.col("is_reasonable"), "mean_level")
              .when((F.col("_low") < 0) & (F.col("_least") >= 0), "negative"))
    return out.select(*keys, reason.alias("reason"))


def climb(hist: DataFrame, future: DataFrame, keys: Keys, ladder: Sequence[tuple[str, Forecaster]]) -> dict[str, DataFrame]:
    """Forecasts of all series of ``future`` by the first level of ``ladder`` (names and forecasters) that leaves no doubt.

    Rounds shrink: each is written, judged, and hands on the keys it leaves, so a series that is forecast well at once is
    fitted once. At the last level a forecast stands if it is there at all. Result: ``forecast`` with level and
    level_name (a series that every level fails has one row with ``error``), and ``rounds``, a row for each series and
    level tried, with the reason it went on (null where it stayed). Keys are not null; there is one at least."""
    keys, left = list(keys), None
    kept, rounds = [], []
    for level, (name, forecaster) in enumerate(ladder):
        mine = future if left is None else future.join(left, keys, "left_semi")
        past = hist.join(mine.select(*keys).distinct(), keys, "left_semi")
        fc = cut_lineage(forecaster(past, mine, keys).withColumns({"level": F.lit(level), "level_name": F.lit(name)}))
        judged = doubts(fc, past, mine, keys)
        if level == len(ladder) - 1:
            judged = judged.withColumn("reason", F.when(F.col("reason") == "failed", F.col("reason")))
        judged = cut_lineage(judged.select(*keys, F.lit(level).alias("level"), F.lit(name).alias("level_name"), "reason"))
        rounds.append(judged)
        kept.append(fc.join(judged.where("reason is null").select(*keys), keys, "left_semi"))
        left = judged.where("reason is not null").select(*keys)
        if not left.head(1):
            break
    lost = left.withColumn("error", F.lit("no level of the ladder gave a forecast"))
    forecast, tried = kept[0], rounds[0]
    for more in kept[1:]:
        forecast = forecast.unionByName(more, allowMissingColumns=True)
    for more in rounds[1:]:
        tried = tried.unionByName(more)
    return {"forecast": forecast.unionByName(lost, allowMissingColumns=True), "rounds": tried}
