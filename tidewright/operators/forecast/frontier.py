"""Frontier search: each series walks over integer points towards its least criterion, all series in shared rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import cut_lineage
from ..base import Keys

Score = Callable[[DataFrame], DataFrame]


def best_points(tried: DataFrame, keys: Keys) -> DataFrame:
    """``keys, point, crit, round`` of the least criterion; the earlier round, then the smaller point at ties."""
    row = F.struct("crit", "round", "point")
    return tried.where(F.col("crit").isNotNull()).groupBy(*keys).agg(F.min(row).alias("_b")).select(*keys, "_b.point", "_b.crit", "_b.round")


def neighbours(points: DataFrame, keys: Keys, steps: DataFrame) -> DataFrame:
    """``keys, point``: every point one step away and within the bounds. ``steps`` has one row per step with the arrays
    step, low and high, and whichever keys the moves depend on."""
    on = [k for k in keys if k in steps.columns]
    moves = steps.select(*on, "step", "low", "high")
    pairs = points.join(moves, on) if on else points.crossJoin(moves)  # a handful of moves for each point
    moved = pairs.withColumn("point", F.zip_with("point", "step", lambda a, b: a + b))
    above = F.zip_with("point", "low", lambda a, b: a >= b)
    below = F.zip_with("point", "high", lambda a, b: a <= b)
    return moved.where(F.forall(above, lambda ok: ok) & F.forall(below, lambda ok: ok)).select(*keys, "point").distinct()


def frontier_search(starts: DataFrame, keys: Keys, steps: DataFrame, score: Score) -> DataFrame:
    """All points that were tried: ``keys, point, crit, error, round``.

    ``starts`` holds keys and point (array of int), ``score`` adds ``crit`` (null where a point can't be fitted) and
    ``error``. A round scores the untried neighbours of the best point of every series whose best point is of the round
    before; the others have settled. It ends when no series has such a point, which the finite bounds ensure. A series
    none of whose starts can be fitted stays with its starts. Every round is a written table, so that nothing is fitted
    twice. Keys are not null.
    """
    keys, n = list(keys), 0
    shape = [*keys, "point", "crit", "error", "round"]
    tried = cut_lineage(score(starts.select(*keys, "point").distinct()).withColumn("round", F.lit(0)).select(*shape))
    while True:
        moved = best_points(tried, keys).where(F.col("round") == n)
        fresh = cut_lineage(neighbours(moved, keys, steps).join(tried.select(*keys, "point"), [*keys, "point"], "left_anti"))
        if not fresh.head(1):
            return tried
        n += 1
        tried = tried.unionByName(cut_lineage(score(fresh).withColumn("round", F.lit(n)).select(*shape)))


def search_report(tried: DataFrame, keys: Keys, steps: DataFrame) -> DataFrame:
    """One row per series: points and rounds tried, best point and criterion, ``is_monotone`` (each round but the last
    improved on those before it) and ``is_settled`` (no neighbour of the best point is untried)."""
    keys = list(keys)
    rounds = tried.groupBy(*keys, "round").agg(F.min("crit").alias("low"), F.count(F.lit(1)).alias("n"))
    walk = rounds.groupBy(*keys).agg(F.sum("n").alias("n_tried"), F.max("round").alias("n_rounds"), F.array_sort(F.collect_list(F.struct("round", "low"))).alias("_w"))
    inner = F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(1)))
    falls = F.forall(F.sequence(F.lit(1), F.size(inner)), lambda i: (i == 1) | (F.element_at(inner, i)["low"] < F.element_at(inner, F.greatest(i - 1, F.lit(1)))["low"]))
    best = best_points(tried, keys)
    missing = neighbours(best, keys, steps).join(tried.select(*keys, "point"), [*keys, "point"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("_left"))
    out = walk.withColumn("is_monotone", F.coalesce(falls, F.lit(False))).drop("_w").join(best.drop("round"), keys, "left").join(missing, keys, "left")
    return out.withColumn("is_settled", F.col("_left").isNull()).drop("_left")
