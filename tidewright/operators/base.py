"""Small shared pieces: key lists, window specs, frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

Keys = Sequence[str]

# fixed values: seasonal period and year-over-year lag of each frequency
PERIOD = {"daily": 7, "weekly": 52, "monthly": 12, "quarterly": 4}
YOY_LAG = {"daily": 364, "weekly": 52, "monthly": 12}


def by(keys: Keys) -> WindowSpec:
    """All rows of a series (panel rows only: a series is bounded by its calendar)."""
    return W.partitionBy(*keys)


def ordered(keys: Keys, *order) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*(order or ("ds",)))


def running(keys: Keys, start: int, end: int, *order) -> WindowSpec:
    return ordered(keys, *order).rowsBetween(start, end)


def series_len(keys: Keys) -> Column:
    return F.count(F.lit(1)).over(by(keys))


def position(keys: Keys, *order) -> Column:
    """0-based position in the series."""
    return F.row_number().over(ordered(keys, *order)) - 1


def percentile(c: Column, q: float) -> Column:
    return F.percentile(c, F.lit(q))


def median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def correlation(a: Column, b: Column) -> Column:
    """Aggregate: correlation over the rows that have both; NULL where either never changes, which ``corr`` fails on. Values
    that never change are told by their ends, as their spread may be some last digits in sums of parts."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    changes = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(changes, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def codes(*pairs: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))


def bands(value: Column, steps: Sequence[tuple[float, object]], otherwise, op: str = "ge") -> Column:
    """First matching step; ``op`` says how the value is compared with the step's limit."""
    test = {
        "ge": lambda lim: value >= lim, "gt": lambda lim: value > lim,
        "le": lambda lim: value <= lim, "lt": lambda lim: value < lim,
    }[op]
    out = None
    for lim, label in steps:
        out = F.when(test(lim), F.lit(label)) if out is None else out.when(test(lim), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def step_date(ds: Column, n: Column, freq: str) -> Column:
    """The date n periods after ds."""
    match freq:
        case "daily":
            return F.date_add(ds, n)
        case "weekly":
            return F.date_add(ds, n * 7)
        case "monthly":
            return F.add_months(ds, n)
    raise ValueError(f"unknown frequency {freq}")


def join_on_keys(a: DataFrame, b: DataFrame, keys: Keys, how: str = "inner") -> DataFrame:
    """Join per-series rows to panel rows; with no keys the right side is one row."""
    if keys:
        return a.join(b, list(keys), how)
    return a.crossJoin(b)
