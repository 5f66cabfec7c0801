"""Holiday effects: anomalous periods, their holidays, impact over the years, unexplained events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dates as D
from . import calendar as C
from .base import Keys, PERIOD, by, codes, join_on_keys
from .signals import decompose
from .windows import partial_weeks

# fixed values: holidays a good history should hold at least twice
MAJOR = ("thanksgiving", "christmas", "new_years", "july4", "memorial_day", "labor_day")


def holiday_coverage(df: DataFrame, keys: Keys, freq: str) -> DataFrame:
    """Score 0..100: each major holiday counts half per year it is covered, at most twice."""
    ds = F.col("ds")
    w = by(keys)
    rows = df.select(*keys, "ds").distinct().select(
        "*", F.min(F.year(ds)).over(w).alias("_y0"), F.max(F.year(ds)).over(w).alias("_y1"))

    def candidates(year):
        return [F.struct(F.lit(n).alias("holiday"), year.alias("year"), C.key_holiday(n, year).alias("date")) for n in MAJOR]

    years = [F.year(ds)] if freq != "weekly" else [F.year(F.date_sub(ds, 7)), F.year(F.date_add(ds, 13))]
    hits = F.filter(F.array(*[c for y in years for c in candidates(y)]), lambda h: h["year"].between(F.col("_y0"), F.col("_y1")) & (
        F.abs(F.datediff(ds, D.week_start(h["date"]))) <= 7 if freq == "weekly" else h["date"] == ds))
    found = rows.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.holiday", "h.year").distinct()
    per = found.groupBy(*keys, "holiday").agg(F.count(F.lit(1)).alias("n"))
    score = per.groupBy(*keys).agg(
        F.round(F.sum(F.least(F.col("n") / 2, F.lit(1.0))) * 100 / len(MAJOR), 1).alias("holiday_coverage"), F.array_sort(F.collect_set("holiday")).alias("holidays"))
    every = df.select(*keys).distinct() if keys else df.agg(F.count(F.lit(1)).alias("_")).drop("_")
    out = join_on_keys(every, score, keys, "left") if keys else score
    return out.select(*keys, F.coalesce("holiday_coverage", F.lit(0.0)).alias("holiday_coverage"), "holidays")


def anomalies(decomp: DataFrame, keys: Keys, threshold: float = 2.0) -> DataFrame:
    """Periods whose remainder exceeds ``threshold`` standard deviations, in percent of the expected value."""
    sd = F.stddev_pop("remainder").over(by(keys))
    rows = decomp.withColumn("_sd", sd).where((F.col("_sd") > 0) & (F.abs("remainder") > threshold * F.col("_sd")))
    expected = F.col("y") - F.col("remainder")
    dev = F.when(expected != 0, F.col("remainder") / F.abs(expected) * 100).otherwise(0.0)
    return rows.select(*keys, "ds", "y", expected.alias("expected"), dev.alias("deviation_pct"))


def nearest_holidays(years: DataFrame, tol: int = 4) -> DataFrame:
    """For each calendar day the closest holiday within ``tol`` days: one row per day, so a fixed small table."""
    dim = C.holiday_dim(years)
    # of two holidays on one date the later in the list counts
    dim = dim.groupBy("year", "ds").agg(F.max_by("holiday", "ord").alias("holiday"), F.max("ord").alias("ord"))
    near = dim.withColumn("off", F.explode(F.sequence(F.lit(-tol), F.lit(tol)))).withColumn("day", F.date_add("ds", F.col("off")))
    best = F.min_by(F.struct("holiday", "ds", "off"), F.struct(F.abs("off"), "year", "ord"))
    return near.groupBy("day").agg(best.alias("b")).select(
        F.col("day").alias("ds"), F.col("b.holiday").alias("holiday"), F.col("b.ds").alias("holiday_date"), F.abs("b.off").alias("distance"))


def match_holidays(anoms: DataFrame, years: DataFrame, tol: int = 4) -> DataFrame:
    """Anomalies with the nearest holiday within ``tol`` days (NULL where none): an equi join on the day."""
    return anoms.join(F.broadcast(nearest_holidays(years, tol)), "ds", "left")


def holiday_impact(matched: DataFrame, keys: Keys) -> DataFrame:
    """Mean lift per holiday over the strongest deviation of each year, with consistency and confidence."""
    hit = matched.where(F.col("holiday").isNotNull())
    yearly = hit.groupBy(*keys, "holiday", F.year("ds").alias("year")).agg(
        F.max_by("deviation_pct", F.struct(F.abs("deviation_pct"), F.negate(F.unix_date("ds")))).alias("dev"), F.count(F.lit(1)).alias("k"))
    out = yearly.groupBy(*keys, "holiday").agg(
        F.avg("dev").alias("avg_lift_pct"), F.stddev_pop("dev").alias("sd"), F.count(F.lit(1)).alias("n_years"), F.sum("k").alias("n_periods"))
    lift, n = F.col("avg_lift_pct"), F.col("n_years")
    cons = F.when((n > 1) & (lift != 0), F.greatest(F.lit(0.0), 1 - F.abs(F.col("sd") / F.abs(lift)))).otherwise(0.5)
    out = out.withColumn("consistency", cons)
    c, size = F.col("consistency"), F.abs(lift)
    conf = F.when((n >= 3) & (c >= 0.5), "high").when((n >= 2) & (c >= 0.3), "medium").otherwise("low")
    advice = F.when((size > 30) & (c > 0.6), "strong").when(size > 15, "moderate").when(size > 5, "mild").otherwise("minimal")
    return out.select(*keys, "holiday", "avg_lift_pct", "n_years", "n_periods", "consistency", conf.alias("confidence"),
                      F.when(lift > 0, "increase").otherwise("decrease").alias("direction"), advice.alias("effect"))


def unexplained(matched: DataFrame, keys: Keys) -> DataFrame:
    """Anomalies without a holiday; recurring when the same ISO week stands out in another year."""
    rows = matched.where(F.col("holiday").isNull()).withColumn("iso_week", F.weekofyear("ds"))
    w = W.partitionBy(*keys, "iso_week")
    return rows.select(
        *keys, "ds", "deviation_pct", F.when(F.col("deviation_pct") > 0, "spike").otherwise("dip").alias("direction"), "iso_week",
        (F.max(F.year("ds")).over(w) > F.min(F.year("ds")).over(w)).alias("is_recurring"))


def holiday_analysis(df: DataFrame, keys: Keys, freq: str = "weekly", threshold: float = 2.0) -> dict[str, DataFrame]:
    """Impacts, unexplained events, partial weeks and one row of advice codes per series with two cycles of history."""
    p = PERIOD[freq]
    enough = df.withColumn("_n", F.count("y").over(by(keys))).where(F.col("_n") >= 2 * p).drop("_n")
    matched = match_holidays(anomalies(decompose(enough, keys, p), keys, threshold), C.years_of(enough))
    impact, events, partial = holiday_impact(matched, keys), unexplained(matched, keys), partial_weeks(enough, keys)
    size = F.abs("avg_lift_pct")
    none = F.lit(0).cast("bigint")
    cols = ("strong", "moderate", "events", "big_events", "recurring", "partial")

    def tagged(rows: DataFrame, **counts) -> DataFrame:
        return rows.groupBy(*keys).agg(*[(F.count_if(counts[c]) if c in counts else F.max(none)).alias(c) for c in cols])

    parts = tagged(impact, strong=(size > 20) & (F.col("confidence") == "high"), moderate=(size > 10) & (size <= 20)).unionByName(
        tagged(events, events=F.lit(True), big_events=F.abs("deviation_pct") > 20, recurring=F.col("is_recurring"))).unionByName(
        tagged(partial, partial=F.lit(True))).unionByName(tagged(enough))
    counts = parts.groupBy(*keys).agg(*[F.coalesce(F.sum(c), none).alias(c) for c in cols])
    found = codes((F.col("partial") > 0, "partial_weeks"), (F.col("strong") > 0, "strong_holidays"), (F.col("moderate") > 0, "moderate_holidays"),
                  (F.col("big_events") > 0, "unexplained_events"), (F.col("recurring") > 0, "recurring_events"))
    advice = counts.withColumn("advice", F.when(F.size(found) == 0, F.array(F.lit("standard"))).otherwise(found))
    return {"impact": impact, "events": events, "partial": partial, "advice": advice}


