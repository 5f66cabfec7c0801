"""Mixing sources to target weights, to the word."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Ranges of the random key within a source; each is sorted by itself.
RANGES = 4096


def targets(sizes: DataFrame, source: str, weights=(3, 1, 2), share=Fraction(3, 2), limit: int = 2) -> DataFrame:
    """Columns source, source_size, target for one row per source. Sources in order of their code points, null last,
    have the weights in turn. Together they get ``share`` of all sizes; a target stops at ``limit`` times its source's
    size and the excess is shared among the others by weight until none is above. By filling level: with sources
    ordered by limit over weight, the first whose limit lies above the level of those left sets it. All sums are whole
    numbers, so each target is one exact fraction, rounded once."""
    num, den = share.numerator, share.denominator
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col(source).isNull(), F.encode(F.col(source), "UTF-8")))
    turn = F.array(*[F.lit(int(w)) for w in weights])
    level = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    d = "decimal(38,0)"
    t = (sizes.withColumn("rank", rank).withColumn("weight", F.get(turn, (F.col("rank") - 1) % len(weights)))
         .withColumn("most", F.col("source_size") * limit).withColumn("full_at", F.col("most") / F.col("weight"))
         .withColumn("given", F.coalesce(F.sum("most").over(level), F.lit(0)))
         .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(level), F.lit(0)))
         .withColumn("rest", F.sum("source_size").over(every) * num - F.col("given") * den)
         .withColumn("open", F.col("most").cast(d) * F.col("left") * den > F.col("weight").cast(d) * F.col("rest")))
    first = F.min(F.when(F.col("open"), F.struct("full_at", "rank", "rest", "left"))).over(every)
    return (t.withColumn("first", first)
            .select(source, "source_size",
                    F.when(F.col("first").isNull() | (F.struct("full_at", "rank") < F.struct("first.full_at", "first.rank")), F.col("most").cast("double"))
                    .otherwise((F.col("weight") * F.col("first.rest")).cast("double") / (F.col("first.left") * den).cast("double")).alias("target")))


def random_key(seed: int, *columns: str):
    """60 random bits from the hash of the columns, the same in every run."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def cuts(df: DataFrame, id: str, source: str, size: str, seed: int = 1, **how) -> DataFrame:
    """Where the mix ends in each source: columns source, source_size, target, epochs (whole passes), and of the
    document in which the last pass ends cut_key, cut_id, cut_size and cut_words (its words before the end; repeated
    rows share them evenly). Equal rows are counted before anything is sorted; the rest is sorted within ranges of the
    random key, and ranges get their place from the sums of those before, so no task sees a whole source."""
    rows = written(df.select(F.col(source).alias("source"), F.col(id).alias("id"), F.col(size).cast("long").alias("size"))
                   .withColumn("key", random_key(seed, "id"))
                   .groupBy("source", "key", "id", "size").agg(F.count("*").alias("n")))
    rows = rows.withColumn("range", F.floor(F.col("key") / (2 ** 60 // RANGES)))
    by_range = rows.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    to_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = by_range.select("source", "range", F.coalesce(F.sum("words").over(to_range), F.lit(0)).alias("before"))
    wanted = written(targets(by_range.groupBy("source").agg(F.sum("words").alias("source_size")), "source", **how))
    wanted = (wanted.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
              .withColumn("rest", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")))
    within = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(within))
    b, w = before.alias("b"), wanted.alias("w")
    placed = (upto.alias("r").join(b, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.range") == F.col("b.range")))
              .select("r.*", (F.col("b.before") + F.col("r.upto")).alias("end")).alias("p"))
    cut = (placed.join(w.select(F.col("source").alias("s"), "rest"), F.col("p.source").eqNullSafe(F.col("s")))
           .where((F.col("rest") < F.col("end")) & (F.col("rest") >= F.col("end") - F.col("size") * F.col("n")))
           .select("s", F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), F.col("size").alias("cut_size"),
                   F.floor((F.col("rest") - F.col("end") + F.col("size") * F.col("n")) / F.col("n")).alias("cut_words")))
    return (w.join(cut, F.col("w.source").eqNullSafe(F.col("s")), "left")
            .select("w.source", "source_size", "target", "epochs", "cut_key", "cut_id", "cut_size", "cut_words"))


def mix(df: DataFrame, id: str, source: str, size: str, seed: int = 1, **how) -> DataFrame:
    """Adds source_size, target, epochs and taken, the words the mix takes of each row, repeats counted.

    Every source is put in a random order (by a hash of the id, ties by id and size) and read from its start as often
    as its target asks, ending within a document at the exact word, so the taken words of a source add up to its
    target rounded down (repeated rows at the end share what is left). Where the mix ends is worked out from four
    narrow columns; rows themselves aren't moved, they are compared with one row per source. Sizes: null counts 0.
    Null ids and sources are values like others; columns of the names added are replaced. An empty table stays empty.
    """
    added = ["source_size", "target", "epochs", "taken"]
    at = written(cuts(df.withColumn(size, F.coalesce(F.col(size), F.lit(0))), id, source, size, seed, **how))
    at = at.select(F.struct("*").alias("_cut"))
    c = lambda name: F.col(f"_cut.{name}")
    own = df.drop(*added).withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long")).withColumn("_key", random_key(seed, id))
    # order of (key, id, size) as in the sort above: nulls first
    nth = F.struct(F.col("_key"), F.col(id), F.col("_size"))
    end = F.struct(c("cut_key"), c("cut_id"), c("cut_size"))
    last = (F.when(c("cut_key").isNull(), F.lit(0)).when(nth < end, F.col("_size"))
            .when(nth.eqNullSafe(end), c("cut_words")).otherwise(F.lit(0)))
    return (own.join(at, F.col(source).eqNullSafe(c("source")))
            .withColumn("source_size", c("source_size")).withColumn("target", c("target")).withColumn("epochs", c("epochs").cast("int"))
            .withColumn("taken", (c("epochs") * F.col("_size") + last).cast("long")).drop("_cut", "_size", "_key"))
