"""Training of all series with all models: split, candidate search, holdout ranking, refit, forecast."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.base import Keys, by
from ..operators.evaluate import metrics
from ..operators.forecast import naive as NV
from ..operators.forecast.base import future_frame
from ..operators.forecast.select import Forecaster, refit, select_candidate
from ..operators.windows import drop_incomplete_tail, rank_models, split_series
from ..session import cut_lineage


def weekly_naive_ranking(panel: DataFrame, keys: Keys, h: int = 12, freq: str = "weekly") -> DataFrame:
    """Tail removal, split, seasonal naive against mean drift on the holdout, metrics and rank of both. A series too
    short for a holdout is ranked by its eval rows; one too short for these has one row without a model."""
    rows = split_series(drop_incomplete_tail(panel, keys), keys, h)
    test = F.when(F.max(F.col("split") == "holdout").over(by(keys)), "holdout").otherwise("eval")
    rows = rows.withColumn("_test", F.col("split") == test)
    train = rows.where(~F.col("_test")).select(*keys, "ds", "y")
    held = rows.where("_test").select(*keys, "ds", "y", F.row_number().over(by(keys).orderBy("ds")).alias("h"))
    fc = NV.seasonal_naive(train, keys, h).withColumn("model", F.lit("seasonal_naive")).unionByName(
        NV.mean_drift(train, keys, h).withColumn("model", F.lit("mean_drift")))
    pairs = fc.join(held, [*keys, "h"])
    return _all_series(rank_models(metrics(pairs, [*keys, "model"]), keys), panel, keys).withColumn("is_best", F.coalesce("is_best", F.lit(False)))


def _all_series(out: DataFrame, panel: DataFrame, keys: Keys, **more: Column) -> DataFrame:
    """``out`` and a row for each series of the panel that has none in it: its keys and ``more``, NULL elsewhere."""
    keys = list(keys)
    if not keys:  # one series: a row of it only if it has none
        lost = out.sparkSession.range(1).select(F.lit(1).alias("_all")).join(out.limit(1).select(F.lit(1).alias("_all")), "_all", "left_anti")
        return out.unionByName(lost.withColumns(more).drop("_all"), allowMissingColumns=True)
    every = panel.select(*keys).distinct()
    on = [F.col(f"_o.{k}").eqNullSafe(F.col(f"_e.{k}")) for k in keys]
    lost = every.alias("_e").join(out.select(*keys).distinct().alias("_o"), on, "left_anti").select(*keys).withColumns(more)
    return out.unionByName(lost, allowMissingColumns=True)


def _failed(fc: DataFrame, keys: Keys, model: str, stage: str) -> DataFrame:
    """Rows without a forecast by series and candidate, with the first error in their order."""
    error = F.col("error") if "error" in fc.columns else F.lit(None).cast("string")
    lost = fc.where(F.col("yhat").isNull()).groupBy(*keys, "cand").agg(F.count(F.lit(1)).alias("n_failed"), F.min(error).alias("error"))
    return lost.select(*keys, F.lit(model).alias("model"), "cand", F.lit(stage).alias("stage"), "n_failed", "error")


def train_models(panel: DataFrame, keys: Keys, freq: str, h: int, models: Mapping[str, Callable[[DataFrame | None], Forecaster]]) -> dict[str, DataFrame]:
    """``models`` maps a name to a maker of forecasters: called with None it searches its own grid, called with
    winners it fits only those.

    Scores and ranking are written to the shared folder (small tables), so every fit runs once.  Result: ``scores`` of every candidate on the eval rows, ``ranking`` of the models by holdout error (by eval error where a series has no holdout), and the
    ``forecast`` of each series by its best model fitted on all its rows; a series without a scored model has one row
    with ``error`` there. ``failures`` counts, by series, model, candidate and stage (eval or holdout), the rows without a
    forecast, with the first error.
    """
    keys = list(keys)
    rows = split_series(panel, keys, h)
    train = rows.where("split = 'train'").drop("split")

    def numbered_rows(split: str) -> DataFrame:
        part = rows.where(F.col("split") == split).drop("split")
        return part.withColumn("h", F.row_number().over(by(keys).orderBy("ds")))

    held, final = numbered_rows("eval"), numbered_rows("holdout")
    upto_eval = rows.where("split <> 'holdout'").drop("split")
    tested = final.select(*keys).distinct() if keys else None
    scores, winners, holdout, failures = [], {}, [], []
    for name, maker in models.items():
        tried = cut_lineage(maker(None)(train, held.drop("y"), keys))
        failures.append(_failed(tried, keys, name, "eval"))
        fc = tried.where(F.col("yhat").isNotNull())
        s = metrics(fc.join(held.select(*keys, "ds", "y"), [*keys, "ds"]), [*keys, "cand"]).withColumn("model", F.lit(name))
        s = cut_lineage(s)  # a row per series and candidate: the fits behind it must not run again
        scores.append(s)
        winners[name] = select_candidate(s, keys)
        again = cut_lineage(refit(upto_eval, final.drop("y"), keys, winners[name], maker))
        failures.append(_failed(again, keys, name, "holdout"))
        test = again.where(F.col("yhat").isNotNull())
        m = metrics(test.join(final.select(*keys, "ds", "y"), [*keys, "ds"]), [*keys, "cand"]).withColumn("model", F.lit(name))
        # a series too short for a holdout goes on with its eval rows
        chosen = s.join(winners[name].select(*keys, "cand"), [*keys, "cand"])
        chosen = chosen.join(tested, keys, "left_anti") if keys else chosen.where(F.lit(not final.head(1)))
        holdout.append(m.unionByName(chosen.select(*m.columns)))
    every, held_out, failed = scores[0], holdout[0], failures[0]
    for f in failures[1:]:
        failed = failed.unionByName(f)
    for s in scores[1:]:
        every = every.unionByName(s)
    for m in holdout[1:]:
        held_out = held_out.unionByName(m)
    ranking = cut_lineage(rank_models(held_out, keys))
    best = ranking.where("is_best").groupBy(*keys).agg(F.min_by(F.struct("model", "cand"), F.struct("mape", "model")).alias("b")).select(*keys, "b.*")
    future = future_frame(panel, keys, h, freq)
    forecast = None
    for name, maker in models.items():
        mine = best.where(F.col("model") == name)
        part = refit(panel.join(mine.select(*keys), keys, "left_semi"), future.join(mine.select(*keys), keys, "left_semi"), keys, mine, maker).withColumn("model", F.lit(name))
        forecast = part if forecast is None else forecast.unionByName(part)
    forecast = _all_series(forecast, panel, keys, error=F.lit("no model could be scored: too few rows, or all candidates failed"))
    return {"scores": every, "ranking": ranking, "forecast": forecast, "failures": failed}
