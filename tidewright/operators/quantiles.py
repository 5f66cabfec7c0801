"""Exact interpolated quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one buffer, which a group with a third
of all rows would not survive.  A bounded sketch only chooses cut points; equal values are
collapsed first, counts per bucket locate the wanted ranks, and only the buckets holding them
are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import Keys


def exact_quantiles(df: DataFrame, keys: Keys, col: str, probs: dict[str, float], buckets: int = 200) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (linear interpolation), the same way for groups of any size."""
    k = list(keys)
    rows = df.where(F.col(col).isNotNull()).select(*k, F.col(col).cast("double").alias("v"))
    return _by_rank(rows, k, probs, buckets)


def _by_rank(rows: DataFrame, k: list[str], probs: dict[str, float], buckets: int) -> DataFrame:
    counts = rows.groupBy(*k, "v").agg(F.count(F.lit(1)).alias("c"))
    cuts = rows.groupBy(*k).agg(
        F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("cuts"),
        F.count(F.lit(1)).alias("n"))
    glue = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in k]

    def attach(a: DataFrame, b: DataFrame) -> DataFrame:
        extra = [F.col(f"b.{c}") for c in b.columns if c not in k]
        joined = a.alias("a").join(b.alias("b"), glue) if k else a.alias("a").crossJoin(F.broadcast(b.alias("b")))
        return joined.select("a.*", *extra)

    placed = attach(counts, cuts).withColumn("bucket", F.size(F.filter("cuts", lambda s: s < F.col("v")))).drop("cuts")
    sizes = placed.groupBy(*k, "bucket", "n").agg(F.sum("c").alias("size"))
    before = W.partitionBy(*k).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("pos")) for name, p in probs.items()])
    hits = (
        sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("w", F.explode(wanted))
        .where((F.ceil("w.pos") >= F.col("start")) & (F.floor("w.pos") < F.col("start") + F.col("size")))
        .select(*k, "bucket", "start", F.col("w.name").alias("name"), F.col("w.pos").alias("pos")))
    need = hits.groupBy(*k, "bucket", "start").agg(F.collect_list(F.struct("name", "pos")).alias("asks"))
    inside = placed.alias("a").join(
        need.alias("b"), glue + [F.col("a.bucket") == F.col("b.bucket")]).select("a.*", "b.start", "b.asks")
    upto = W.partitionBy(*k, "bucket").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    ranked = inside.withColumn("first", F.col("start") + F.coalesce(F.sum("c").over(upto), F.lit(0)))
    picked = ranked.withColumn("ask", F.explode("asks"))

    def at(pos):
        return (pos >= F.col("first")) & (pos < F.col("first") + F.col("c"))

    lo, hi = F.floor("ask.pos"), F.ceil("ask.pos")
    picked = picked.where(at(lo) | at(hi)).select(
        *k, F.col("ask.name").alias("name"), F.col("ask.pos").alias("pos"),
        F.when(at(lo), F.col("v")).alias("lo_v"), F.when(at(hi), F.col("v")).alias("hi_v"))
    ends = picked.groupBy(*k, "name", "pos").agg(F.max("lo_v").alias("lo_v"), F.max("hi_v").alias("hi_v"))
    value = F.col("lo_v") + (F.col("pos") - F.floor("pos")) * (F.col("hi_v") - F.col("lo_v"))
    return ends.groupBy(*k).agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name in probs])


def exact_median(df: DataFrame, keys: Sequence[str], col: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, col, {name: 0.5})
