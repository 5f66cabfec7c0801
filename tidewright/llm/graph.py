"""Connected components of link tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, written

#: Nodes that a task contracts at once, and edges that surely have no more.
NODES = 500_000
EDGES = NODES // 2


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b), a > b, that connect what the links (a, b) of a task connect: every node of its links with the smallest that
    they reach. A task holds a bounded number of nodes at once and begins anew beyond that. Tasks that make links in Python
    contract them as they come, in the same worker: a second one beside it would cost an executor its memory once more."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def edges() -> pa.RecordBatch:
        found = [(x, r) for x in list(up) if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
        if len(up) > NODES:
            yield edges()
            up.clear()
    yield edges()


def _contracted(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(contract, "a long, b long")


def components(links: DataFrame, contracted: bool = False) -> DataFrame:
    """Columns node and component (the smallest node reachable) for every node of links (a, b), both long and not null.

    Tasks contract their own links first (``contracted``: those that made them have), then what is left by larger node. Edges that one task holds at once (EDGES, four
    megabytes) are done with one more contraction. More go through union-find over the whole cluster by alternating large and
    small stars: every node hands its larger neighbours, then its smaller ones, to the smallest it knows, until all edges
    point to the smallest of their component or are so few. A node with
    very many links costs a partial minimum and rows of a join that Spark can split, never a gathered list. Each round
    is a written table that replaces the one before; only a count and a checksum come to the driver. Loops and repeated links do no harm; without
    links there are no rows."""
    few = links if contracted else _contracted(links.where("a <> b"))
    edges = written(_contracted(few.repartition("a")))
    before = _state(edges)
    while before[0] > EDGES:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = written(small.select("e.*").where("a <> b").distinct())
        dropped(edges)
        edges, now = after, _state(after)
        if now == before:
            break
        before = now
    if before[0] <= EDGES:
        few, edges = edges, written(_contracted(edges.coalesce(1)))
        dropped(few)
    own = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return own.unionByName(edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node"))
