"""Contract of pluggable forecasters and the fan-out over series and candidates.

A model is a function ``model(y, ds, params, h, x, xf) -> (yhat, sigma)`` on numpy arrays: ``y`` history in
date order, ``ds`` history and future dates, ``x`` and ``xf`` covariate matrices (or None).  It sees one
series, bounded by its calendar.  Spark distributes the groups: the candidate is part of the group key, so
even a single long series spreads over as many tasks as there are candidates.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from itertools import product
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..base import Keys
from ..joins import future_spine

Model = Callable[..., tuple[np.ndarray, np.ndarray]]


def grid_table(spark: SparkSession, grid: Mapping[str, Sequence[object]] | Iterable[Mapping[str, object]]) -> DataFrame:
    """Candidates as canonical JSON text: the product of parameter lists, or given records."""
    records = [dict(zip(grid, v)) for v in product(*grid.values())] if isinstance(grid, Mapping) else list(grid)
    rows = sorted({json.dumps(r, sort_keys=True) for r in records})
    return spark.createDataFrame([(r,) for r in rows], "cand string")


def limit_grid(grid: DataFrame, n: int | None, seed: int | None = None, complexity: Column | None = None) -> DataFrame:
    """At most n candidates (all if None): the simplest, or a seeded sample that does not depend on partitioning."""
    order = [complexity, F.col("cand")] if complexity is not None else [F.xxhash64(F.col("cand"), F.lit(seed or 0)), F.col("cand")]
    return grid.orderBy(*order) if n is None else grid.orderBy(*order).limit(n)


def future_frame(df: DataFrame, keys: Keys, h: int, freq: str, start: str | None = None) -> DataFrame:
    """``keys, h, ds`` of the forecast periods."""
    return future_spine(df, keys, h, freq, start)


def _designs(rows: DataFrame, keys: list[str], cands: DataFrame, share: Sequence[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Each series once a design (the values of the parameters in ``share``), instead of once a candidate.

    A list for all series is the caller's own grid, so the driver may hold it: the tasks get it with their code.  Where each
    series has its own list, its candidates travel as rows of their own beside the series.
    """
    design = F.concat_ws("|", *[F.coalesce(F.get_json_object("cand", f"$.{p}"), F.lit("")) for p in share])
    listed = cands.withColumn("_design", design)
    if keys and set(keys) <= set(cands.columns):
        own = listed.select(*keys, "_design", "cand").distinct()
        many = rows.join(own.select(*keys, "_design").distinct(), keys).withColumn("cand", F.lit(None).cast("string"))
        return many.unionByName(own, allowMissingColumns=True), {}
    lists: dict[str, list[str]] = {}
    for r in listed.select("_design", "cand").distinct().orderBy("_design", "cand").collect():
        lists.setdefault(r["_design"], []).append(r["cand"])
    every = F.array(*[F.lit(d) for d in lists]).cast("array<string>")
    return rows.withColumns({"_design": F.explode(every), "cand": F.lit(None).cast("string")}), lists


def fan_out(hist: DataFrame, future: DataFrame, keys: Keys, cands: DataFrame, model: Model, xcols: Sequence[str] = (),
            level: float = 0.95, share: Sequence[str] = ()) -> DataFrame:
    """Fit every candidate on every series and forecast its future rows, all in one job.

    ``cands`` is one list for all series, or holds the key columns when each series has its own (a winner to be
    fitted again, a grid narrowed by advice).  A group that fails gives one row with ``error`` set instead of
    failing the job.

    With ``share``, candidates equal in those parameters are one group: ``model`` then takes their list in place of
    ``params`` and returns a list of ``(yhat, sigma)``, or the exception of a candidate that failed.
    """
    keys = list(keys)
    xs = [F.col(c).cast("double").alias(c) for c in xcols]
    rows = hist.select(*keys, "ds", F.col("y").cast("double").alias("y"), F.lit(None).cast("int").alias("h"), *xs).unionByName(
        future.select(*keys, "ds", F.lit(None).cast("double").alias("y"), F.col("h").cast("int").alias("h"), *xs))
    lists: dict[str, list[str]] = {}
    if share:
        work, lists = _designs(rows, keys, cands, share)
    elif keys and set(keys) <= set(cands.columns):
        work = rows.join(cands.select(*keys, "cand"), keys)
    else:
        work = rows.crossJoin(cands.select("cand"))  # broadcast or not by its measured size
    types = dict(work.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["cand string, h int, ds date, yhat double, yhat_lower double, yhat_upper double, error string"])
    z = NormalDist().inv_cdf(0.5 + level / 2)
    xcols, shared = list(xcols), bool(share)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in keys}
        if shared:
            named = pdf["cand"].notna() & pdf["ds"].isna()
            tried = lists.get(pdf["_design"].iloc[0]) or sorted(pdf.loc[named, "cand"])
            pdf = pdf[~named]
        else:
            tried = [pdf["cand"].iloc[0]]
        pdf = pdf.sort_values("ds", kind="stable")
        past, ahead = pdf[pdf["h"].isna() & pdf["y"].notna()], pdf[pdf["h"].notna()].sort_values("h")
        try:
            if past.empty or ahead.empty:
                raise ValueError("no history or no future")
            x, xf = (past[xcols].to_numpy(float), ahead[xcols].to_numpy(float)) if xcols else (None, None)
            ds = pd.to_datetime(pd.concat([past["ds"], ahead["ds"]]))
            params = [json.loads(c) for c in tried]
            got = model(past["y"].to_numpy(float), ds, params if shared else params[0], len(ahead), x, xf)
            results = got if shared else [got]
        except Exception as e:  # a failed group becomes a row, the other groups go on
            results = [e] * len(tried)
        out = []
        for cand, r in zip(tried, results, strict=True):
            if not isinstance(r, Exception) and not np.all(np.isfinite(r[0])):
                r = ValueError("forecast is not finite")
            if isinstance(r, Exception):
                out.append(pd.DataFrame([{**head, "cand": cand, "h": None, "ds": None, "yhat": None, "yhat_lower": None, "yhat_upper": None,
                                          "error": f"{type(r).__name__}: {r}"[:200]}]))
                continue
            yhat, sigma = r
            out.append(pd.DataFrame({**head, "cand": cand, "h": ahead["h"].astype("int32").to_numpy(), "ds": ahead["ds"].to_numpy(), "yhat": yhat,
                                     "yhat_lower": yhat - z * sigma, "yhat_upper": yhat + z * sigma, "error": None}))
        return out[0] if len(out) == 1 else pd.concat([o.astype(object) for o in out], ignore_index=True)

    return work.groupBy(*keys, "_design" if shared else "cand").applyInPandas(run, schema)


def registered(model: Model, cands: DataFrame, xcols: Sequence[str] = (), share: Sequence[str] = ()) -> Callable[[DataFrame, DataFrame, Keys], DataFrame]:
    """A forecaster ``f(hist, future, keys)`` from a model and its candidates, as cross-validation and selection take."""
    return lambda hist, future, keys: fan_out(hist, future, keys, cands, model, xcols, share=share)


def steps_sigma(sigma: float, h: int) -> np.ndarray:
    return sigma * np.sqrt(np.arange(1, h + 1))


def rms(e: np.ndarray) -> float:
    return math.sqrt(float(np.mean(e * e))) if len(e) else 0.0
