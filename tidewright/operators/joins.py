"""Joins and date spines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import binary_columns
from .base import Keys, YOY_LAG, by, join_on_keys, ordered


def join_features(df: DataFrame, feats: DataFrame, ds: str, order: Sequence[str] = ()) -> DataFrame:
    """Features by date; the last feature row of a date wins, rows without one get 0, equal names are taken over.

    After the reduction the feature side has one row per calendar day, also where the column holds timestamps, which
    bounds its size, so it is broadcast and a hot date on the left needs no shuffle at all.
    """
    cols = [c for c in feats.columns if c not in (ds, *order)]
    last = F.max_by(F.struct(*cols), F.struct(*order)) if order else F.max(F.struct(*cols))
    one = feats.groupBy(F.col(ds).cast("date").alias("_day")).agg(last.alias("_f"))
    joined = df.join(F.broadcast(one), F.col(ds).cast("date") == F.col("_day"), "left")
    keep = [c for c in df.columns if c not in cols]
    return joined.select(*keep, *[F.when(F.col("_f").isNull(), F.lit(0)).otherwise(F.col(f"_f.{c}")).alias(c) for c in cols])


def join_actuals(fc: DataFrame, act: DataFrame, keys: Keys, y: str = "y") -> DataFrame:
    """Forecast rows that have an actual of the same series and date."""
    return fc.join(act.select(*keys, "ds", F.col(y).alias("actual")), [*keys, "ds"], "inner")


def timeline(hist: DataFrame, val: DataFrame, fc: DataFrame, keys: Keys) -> DataFrame:
    """History, validation and forecast on one time axis: a union aggregated by date, one shuffle instead of two joins.

    The forecast line starts at the last history point; absent bounds are 0.8 and 1.2 of the forecast.
    """
    d = F.lit(None).cast("double")
    yhat = F.coalesce(F.col("yhat"), F.lit(0.0))

    def bound(c: str, share: float) -> Column:
        given = F.nullif(F.col(c), F.lit(0.0)) if c in fc.columns else d
        return F.coalesce(given, yhat * share)

    h = hist.select(*keys, "ds", F.col("y").alias("hist_y"), d.alias("val_y"), d.alias("validation_yhat"), d.alias("fc"), d.alias("lo"), d.alias("hi"))
    v = val.select(*keys, "ds", d.alias("hist_y"), F.coalesce("y", F.lit(0.0)).alias("val_y"), yhat.alias("validation_yhat"), d.alias("fc"), d.alias("lo"), d.alias("hi"))
    f = fc.select(*keys, "ds", d.alias("hist_y"), d.alias("val_y"), d.alias("validation_yhat"), yhat.alias("fc"),
                  bound("yhat_lower", 0.8).alias("lo"), bound("yhat_upper", 1.2).alias("hi"))
    cols = ("hist_y", "val_y", "validation_yhat", "fc", "lo", "hi")
    rows = h.unionByName(v).unionByName(f).groupBy(*keys, "ds").agg(*[F.max(c).alias(c) for c in cols])
    w = by(keys)
    last = F.max(F.when(F.col("hist_y").isNotNull(), F.col("ds"))).over(w)
    first_fc = F.min(F.when(F.col("fc").isNotNull(), F.col("ds"))).over(w)
    rows = rows.withColumns({"_last": last, "_first": first_fc})
    anchor = (F.col("ds") == F.col("_last")) & F.col("_first").isNotNull() & (F.col("_first") != F.col("_last"))
    kind = (F.when(F.col("fc").isNotNull(), "forecast").when(F.col("hist_y").isNotNull(), "history").otherwise("validation"))
    return rows.select(
        *keys, "ds", F.coalesce("hist_y", "val_y").alias("actual"), "validation_yhat",
        F.coalesce("fc", F.when(anchor, F.col("hist_y"))).alias("forecast_yhat"), F.col("lo").alias("yhat_lower"),
        F.col("hi").alias("yhat_upper"), kind.alias("type"))


def combine_slices(df: DataFrame, keys: Keys, ds: str = "ds", y: str = "y") -> DataFrame:
    """Sum of slices over the union of their dates; an outer join with zeros is the same as a plain sum."""
    return df.groupBy(*keys, ds).agg(F.coalesce(F.sum(y), F.lit(0.0)).alias(y))


def yoy_lookup(fut: DataFrame, hist: DataFrame, keys: Keys, freq: str, y: str = "y") -> DataFrame:
    """Value one year before each future date, else the mean of the last year of history, else 0."""
    k = YOY_LAG[freq]
    shift = {"daily": F.date_add("ds", 364), "weekly": F.date_add("ds", 364), "monthly": F.add_months("ds", 12)}[freq]
    past = hist.select(*keys, shift.alias("ds"), F.col(y).alias("_past"))
    if freq == "monthly":  # month-end dates may meet on one day: the last of them
        past = hist.groupBy(*keys, shift.alias("ds")).agg(F.max_by(y, "ds").alias("_past"))
    rn = F.row_number().over(ordered(keys, F.col("ds").desc()))
    recent = hist.select(*keys, F.col(y).alias("v"), rn.alias("rn")).where(F.col("rn") <= k).groupBy(*keys).agg(F.avg("v").alias("_recent"))
    out = join_on_keys(fut.join(past, [*keys, "ds"], "left"), recent, keys, "left")
    value = F.coalesce("_past", "_recent", F.lit(0.0))
    return out.withColumn(f"lag_{k}", value).withColumn(f"lag_{k}_avg", F.col(f"lag_{k}")).drop("_past", "_recent")


def _anchored(df: DataFrame, keys: Keys) -> DataFrame:
    """First and last date and the most frequent weekday (earliest on ties), in one pass of two small aggregates."""
    days = df.groupBy(*keys, F.weekday("ds").alias("wd")).agg(
        F.count_distinct("ds").alias("n"), F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    return days.groupBy(*keys).agg(
        F.max_by("wd", F.struct("n", -F.col("wd"))).alias("anchor"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum("n").alias("n_dates"))


def _on_or_after(ds: Column, weekday: Column) -> Column:
    return F.date_add(ds, F.pmod(weekday - F.weekday(ds), F.lit(7)))


def expected_spine(df: DataFrame, keys: Keys, freq: str) -> DataFrame:
    """All dates a complete series would have between its first and last date."""
    span = _anchored(df, keys)
    if freq == "weekly":
        lo, step = _on_or_after(F.col("lo"), F.col("anchor")), F.expr("INTERVAL 7 DAY")
    elif freq == "monthly":
        first = F.trunc("lo", "month")
        lo, step = F.when(first == F.col("lo"), first).otherwise(F.add_months(first, 1)), F.expr("INTERVAL 1 MONTH")
    else:
        lo, step = F.col("lo"), F.expr("INTERVAL 1 DAY")
    span = span.withColumn("lo", lo).where("lo <= hi AND n_dates >= 2")
    return span.select(*keys, F.explode(F.sequence("lo", "hi", step)).alias("ds"))


def missing_periods(df: DataFrame, keys: Keys, freq: str) -> DataFrame:
    """Expected dates a series does not have."""
    return expected_spine(df, keys, freq).join(df.select(*keys, "ds"), [*keys, "ds"], "left_anti")


def fill_future_covariates(fut: DataFrame, hist: DataFrame, keys: Keys, covs: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """Covariates of future dates from rows that know them; flags default to 0, others to the history mean."""
    flags = binary_columns(hist, covs)
    if known is not None:
        fut = fut.join(known.select(*keys, "ds", *covs), [*keys, "ds"], "left")
    else:
        fut = fut.withColumns({c: F.lit(None).cast("double") for c in covs})
    means = hist.groupBy(*keys).agg(*[F.avg(c).alias(f"_{c}") for c in covs])
    out = join_on_keys(fut, means, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0) if flags.get(c) else F.col(f"_{c}")) for c in covs}).drop(*[f"_{c}" for c in covs])


def future_spine(df: DataFrame, keys: Keys, h: int, freq: str, start: str | None = None) -> DataFrame:
    """The h periods after the last date of each series, on its own weekday or on month starts.

    With ``start`` the periods after that date, which is first moved back to the anchor.
    """
    span = _anchored(df, keys)
    last = F.lit(start).cast("date") if start else F.col("hi")
    if freq == "weekly":
        if start:
            last = F.date_sub(last, F.pmod(F.weekday(last) - F.col("anchor"), F.lit(7)))
        first = _on_or_after(F.date_add(last, 1), F.col("anchor"))
        date = F.date_add(F.col("_first"), (F.col("h") - 1) * 7)
    elif freq == "monthly":
        month = F.trunc(last, "month")
        if start:  # the first month start on or after the date counts as the present one
            month = F.when(month == last, month).otherwise(F.add_months(month, 1))
        first = F.add_months(month, 1)
        date = F.add_months(F.col("_first"), F.col("h") - 1)
    else:
        first = F.date_add(last, 1)
        date = F.date_add(F.col("_first"), F.col("h") - 1)
    steps = F.explode(F.sequence(F.lit(1), F.lit(h))).alias("h")
    return span.select(*keys, first.alias("_first"), steps).select(*keys, "h", date.alias("ds"))


def cross_candidates(series: DataFrame, grid: DataFrame) -> DataFrame:
    """Every series with every candidate; whether the grid is broadcast is left to its measured size."""
    return series.crossJoin(grid)


def filter_key(filters: Column) -> Column:
    """Canonical text of a filter map: sorted ``k=v`` joined by ``|``; NULL when empty."""
    entries = F.array_sort(F.map_entries(filters))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return F.nullif(text, F.lit(""))


def key_text(keys: Keys) -> Column:
    """The same canonical text from key columns."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in sorted(keys)])


def route_requests(reqs: DataFrame, fc: DataFrame, keys: Keys) -> DataFrame:
    """Requests ``(request_id, periods, filters map)`` to the forecast rows of their segment.

    A lone segment answers every request; otherwise an unknown filter gives one error row with the number
    of available segments.
    """
    steps = fc.withColumn("segment", key_text(keys)).select("segment", "h", "ds", "yhat")
    segments = steps.select("segment").distinct().agg(F.count(F.lit(1)).alias("n_segments"), F.min("segment").alias("_only"))
    known = steps.select(F.col("segment").alias("key"), F.lit(True).alias("_known")).distinct()
    asked = reqs.withColumn("key", filter_key(F.col("filters"))).join(known, "key", "left").crossJoin(F.broadcast(segments))
    asked = asked.withColumn("segment", F.when(F.col("_known"), F.col("key")).when(F.col("n_segments") == 1, F.col("_only")))
    hit = F.col("segment").isNotNull()
    out = asked.drop("_known", "_only").join(steps, "segment", "left").where(~hit | (F.col("h") <= F.col("periods")))
    return out.select("request_id", "segment", "h", "ds", "yhat", F.when(~hit, "no_matching_segment").alias("error"),
                      F.when(~hit, F.col("n_segments")).alias("n_available"))


def append_future(hist: DataFrame, fut: DataFrame, keys: Keys) -> DataFrame:
    """History plus only those future rows that lie after it."""
    last = hist.groupBy(*keys).agg(F.max("ds").alias("_last"))
    safe = join_on_keys(fut, last, keys, "left").where(F.col("_last").isNull() | (F.col("ds") > F.col("_last"))).drop("_last")
    return hist.unionByName(safe, allowMissingColumns=True)


def join_runs(jobs: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
    return jobs.join(other, "job_id", how)


