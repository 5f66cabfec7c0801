"""From advised parameter lists to candidates: the lists of each series as JSON rows that ``fan_out`` takes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import Keys
from .arima import DEGENERATE

# what a model tries where the advice leaves a parameter open; ``arima`` orders, ``ets`` forms and ``structural`` flexibilities
OPEN_LISTS: dict[str, dict[str, Sequence[object]]] = {
    "structural": {"growth": ("linear", "flat"), "season_mode": ("additive", "multiplicative"), "trend_flexibility": (0.01, 0.05, 0.1, 0.5),
                   "season_flexibility": (0.1, 1.0, 10.0), "yearly": ("auto",), "weekly": ("auto",)},
    "arima": {"p": (0, 1, 2), "d": (0, 1), "q": (0, 1)},
    "sarimax": {"p": (0, 1, 2), "d": (0, 1), "q": (0, 1)},
    "ets": {"trend": ("none", "add"), "seasonal": ("none", "add", "mul"), "damped": ("false",)},
    "theta": {"season_length": (12,)},
}
# names under which the models read what the advice calls otherwise
READ_AS = {"season_mode": "mode", "seasonal": "season", "season_length": "period"}


def _texts(values: Sequence[object]) -> Column:
    return F.array(*[F.lit(str(v)) for v in values])


def _grow(combos: Column, name: str, values: Column) -> Column:
    """Every map so far with every value of one more parameter."""
    return F.flatten(F.transform(combos, lambda m: F.transform(values, lambda v: F.map_concat(m, F.create_map(F.lit(name), v)))))


def expand_grid(grid: DataFrame, keys: Keys, model: str, fixed: Mapping[str, object] | None = None) -> DataFrame:
    """``keys, cand``: the product of each series' own parameter lists of one model, as canonical JSON text.

    ``grid`` holds ``keys, model, param, values`` (``advice.candidate_grid``, ``advice.profile_grid``).  A list that is missing,
    null or empty is the model's own; repeated values count once.  ``fixed`` adds parameters all candidates share, such as
    ``freq`` or ``period``.  A series has candidates if it has any row in ``grid``.  Orders without dynamics are left out.
    """
    open_lists = OPEN_LISTS[model]
    lists = {p: F.max(F.when((F.col("model") == model) & (F.col("param") == p) & (F.size("values") > 0), F.array_distinct("values"))) for p in open_lists}
    rows = grid.groupBy(*keys).agg(*[c.alias(f"_{p}") for p, c in lists.items()])
    combos = F.array(F.create_map().cast("map<string,string>"))
    fixed = {k: str(v) for k, v in (fixed or {}).items()}
    named = {READ_AS.get(p, p): F.coalesce(f"_{p}", _texts(v)) for p, v in open_lists.items()} | {k: F.array(F.lit(v)) for k, v in fixed.items()}
    for name in sorted(named):
        combos = _grow(combos, name, named[name])
    out = rows.select(*keys, F.explode(combos).alias("_c"))
    if model in ("arima", "sarimax"):
        order = F.concat_ws(",", F.col("_c")["p"], F.col("_c")["d"], F.col("_c")["q"])
        out = out.where(~order.isin(*[",".join(map(str, o)) for o in DEGENERATE]))
    return out.select(*keys, F.to_json("_c").alias("cand"))


def default_candidates(params: DataFrame, keys: Keys, model: str, fixed: Mapping[str, object] | None = None) -> DataFrame:
    """``keys, cand``: the one candidate of ``advice.default_params`` per series; a season without period becomes no season.

    ``sarimax`` orders are taken apart into p, d and q; what no model reads (the errors of ets, top orders of a search) is left out.
    """
    get = {
        "structural": {"growth": "growth", "mode": "season_mode", "trend_flexibility": "trend_flexibility", "season_flexibility": "season_flexibility",
                       "yearly": "yearly", "weekly": "weekly"},
        "ets": {"trend": "trend", "season": "seasonal", "damped": "damped", "period": "m"},
        "sarimax": {},
    }[model]
    p = F.col("params")
    values = {k: F.try_element_at(p, F.lit(v)) for k, v in get.items()}
    if model == "ets":
        values["season"] = F.when(values["period"] == "none", "none").otherwise(values["season"])
        values["period"] = F.when(values["period"] == "none", "1").otherwise(values["period"])
    if model == "sarimax":
        order, season = F.split(F.try_element_at(p, F.lit("order")), ","), F.split(F.try_element_at(p, F.lit("seasonal_order")), ",")
        values = {k: F.try_element_at(order, F.lit(i)) for i, k in enumerate("pdq", 1)} | {"period": F.coalesce(F.try_element_at(season, F.lit(4)), F.lit("1"))}
    values |= {k: F.lit(str(v)) for k, v in (fixed or {}).items()}
    return params.where(F.col("model") == model).select(*keys, F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)])).alias("cand"))
