"""Nearest vectors by a forest of hash prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Trees; bits of the hash string in each; index rows and queries that one task compares at most.
TREES, BITS, BLOCK = 20, 40, 32768


def wanted_candidates(n: int) -> int:
    """Candidates, counted over all trees, at which a search stops rising, by default: 12 n**0.75. On random vectors of 64
    dimensions, which have no near neighbours to speak of, this finds over nine tenths of the true ones."""
    return math.ceil(12 * n**0.75)


def _planes(dim: int, trees: int) -> np.ndarray:
    """Per tree BITS random directions, orthogonal in sets of as many as there are dimensions."""
    r = np.random.default_rng(11)
    per = math.ceil(BITS / dim)
    return np.stack([np.concatenate([np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(per)], axis=1)[:, :BITS] for _ in range(trees)])


def _codes(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings as numbers, first bit highest: one row per vector, one column per tree."""
    out = np.zeros((len(x), len(planes)), np.int64)
    for t, p in enumerate(planes):
        for bit in (x @ p > 0).T:
            out[:, t] = out[:, t] << 1 | bit
    return out


def _hashed(dim: int, dtype: str, radius: float, root: int, trees: int):
    """Each vector once per tree as an index row, and as a query row if it is asked for. Index vectors get one more
    component that lifts all of them to the same length, so that the largest product is the smallest angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(dim + 1, trees)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ids, asked, packed = (part.column(k).to_pylist() for k in range(3))
                if not ids:
                    continue
                x = np.array(packed, dtype="f8").reshape(len(ids), dim)
                packed = [v.tobytes() for v in x.astype(dtype)]
                lift = np.sqrt(np.maximum(0, radius**2 - (x * x).sum(axis=1)))[:, None]
                for query in (False, True):
                    use = np.flatnonzero(asked) if query else np.arange(len(ids))
                    if len(use):
                        c = _codes(np.concatenate([x[use], 0 * lift[use] if query else lift[use]], axis=1), planes)
                        for t in range(trees):
                            yield pa.RecordBatch.from_arrays([
                                pa.array(np.full(len(use), t, np.int32)), pa.array(c[:, t] >> (BITS - root) if root else np.zeros(len(use), np.int64)),
                                pa.array(np.full(len(use), query)), pa.array([ids[i] for i in use], pa.int64()), pa.array(c[:, t]),
                                pa.array([packed[i] for i in use], pa.binary())], ["tree", "block", "query", "class", "code", "vector"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of sorted batches by tree, block, part and query part; holds one block at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        keys = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
        edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if b.num_rows else []
        for i, s in enumerate(edges):
            own = tuple(keys[:, s])
            if held and own != key:
                yield pa.Table.from_batches(held)
                held = []
            key = own
            held.append(b.slice(s, (edges[i + 1] if i + 1 < len(edges) else b.num_rows) - s))
    if held:
        yield pa.Table.from_batches(held)


def _sides(t: pa.Table):
    query = t.column("query").to_numpy()
    ids, codes = t.column("class").to_numpy(), t.column("code").to_numpy()
    rows = np.flatnonzero(~query)
    return rows[np.argsort(codes[rows], kind="stable")], np.flatnonzero(query), ids, codes


def _levels(root: int):
    """How many index rows of a block share each prefix length, from the root's, with each query: a descent by binary
    search in the sorted array of hash strings, and the way back up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            rows, asks, ids, codes = _sides(t)
            if len(asks) and len(rows):
                sorted_codes, q = codes[rows], codes[asks]
                counts = []
                for level in range(root, BITS + 1):
                    low = q >> (BITS - level) << (BITS - level)
                    counts.append(np.searchsorted(sorted_codes, low + (1 << (BITS - level))) - np.searchsorted(sorted_codes, low))
                yield pa.RecordBatch.from_arrays([pa.array(ids[asks]), pa.array(np.stack(counts, axis=1).tolist(), pa.list_(pa.int64()))], ["class", "counts"])

    return run


def _search(dim: int, dtype: str, most: int):
    """The best ``most`` of the index rows that share a query's prefix, in each block. Queries of one prefix go together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            rows, asks, ids, codes = _sides(t)
            if not len(asks) or not len(rows):
                continue
            vectors = t.column("vector").to_pylist()
            x = np.frombuffer(b"".join(vectors[i] for i in rows), dtype).reshape(-1, dim).astype("f8")
            q = np.frombuffer(b"".join(vectors[i] for i in asks), dtype).reshape(-1, dim).astype("f8")
            level = t.column("level").to_numpy(zero_copy_only=False)[asks].astype(np.int64)
            low = codes[asks] >> (BITS - level) << (BITS - level)
            start = np.searchsorted(codes[rows], low)
            end = np.searchsorted(codes[rows], low + (np.int64(1) << (BITS - level)))
            found = ids[rows]
            out: list[list] = [[], [], []]
            for s, e in sorted(set(zip(start.tolist(), end.tolist(), strict=True))):
                same = np.flatnonzero((start == s) & (end == e))
                for part in np.array_split(same, math.ceil(len(same) / 128)) if e > s else []:
                    scores, k = q[part] @ x[s:e].T, min(most, e - s)
                    # ties at the last place: all rows that reach it, then by class, which is by smallest id
                    cut = np.partition(scores, e - s - k, axis=1)[:, e - s - k]
                    for i, row in enumerate(part):
                        near = np.flatnonzero(scores[i] >= cut[i] - 1e-12 * (abs(cut[i]) + 1))
                        exact = (q[row] * x[s + near]).sum(axis=1)
                        best = np.lexsort((found[s + near], -exact))[:k]
                        out[0].append(np.full(len(best), ids[asks[row]]))
                        out[1].append(found[s + near[best]])
                        out[2].append(exact[best])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_class", "class", "score"])

    return run


def _dealt(hashed: DataFrame) -> DataFrame:
    """Rows with the part of their block that they belong to: index rows by ``part`` and query rows by ``ask``, each in
    all parts of the other kind."""
    parts = hashed.groupBy("tree", "block").agg(F.greatest(F.lit(1), F.ceil(F.sum((~F.col("query")).cast("int")) / BLOCK)).alias("parts"),
                                                F.greatest(F.lit(1), F.ceil(F.sum(F.col("query").cast("int")) / BLOCK)).alias("asks"))
    all_of = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    own = lambda c: F.array(F.pmod(F.xxhash64("class"), F.col(c)))
    return (hashed.join(written(parts), ["tree", "block"])
            .withColumn("part", F.explode(F.when(F.col("query"), all_of("parts")).otherwise(own("parts"))))
            .withColumn("ask", F.explode(F.when(F.col("query"), own("asks")).otherwise(all_of("asks")))))


def _risen(hashed: DataFrame, level: DataFrame, root: int, goal: int) -> DataFrame:
    """``hashed`` with levels, where queries without one rise above the root's: to the longest shorter prefix that
    ``goal`` rows share over the trees, down to none. They go to every block of that prefix that holds index rows; with
    no prefix all rows are met in each tree, so the first is enough."""
    index = hashed.where("NOT query")
    above = (index.groupBy("tree", "block").agg(F.count("*").alias("n"))
             .withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(root - 1))))
             .withColumn("prefix", F.expr(f"shiftright(block, {root} - level)")))
    above = written(above)
    asks = hashed.where("query").join(level, ["class", "query"])
    low = asks.where("level IS NULL").drop("level")
    spans = above.groupBy("tree", "level", "prefix").agg(F.sum("n").alias("n"))
    at = low.select("class", "tree", "block").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(root - 1))))
    at = at.withColumn("prefix", F.expr(f"shiftright(block, {root} - level)"))
    met = at.join(spans, ["tree", "level", "prefix"]).groupBy("class", "level").agg(F.sum("n").alias("n"))
    to = met.groupBy("class").agg(F.coalesce(F.max(F.when(F.col("n") >= goal, F.col("level"))), F.lit(0)).alias("level"))
    low = low.join(to, "class").where("level > 0 OR tree = 0").withColumn("prefix", F.expr(f"shiftright(block, {root} - level)"))
    low = low.drop("block").join(above.drop("n"), ["tree", "level", "prefix"])
    columns = [*hashed.columns, "level"]
    return (index.withColumn("level", F.lit(None).cast("int")).select(columns)
            .unionByName(asks.where("level IS NOT NULL").select(columns)).unionByName(low.select(columns)))


def nearest(df: DataFrame, id: str, vector: str, is_query, k: int = 20, trees: int = TREES, candidates: int | None = None) -> DataFrame:
    """The ``k`` nearest rows found of each query row: query_id, rank (from 1), vec_id, score (their inner product in
    double precision), nearest first, ties to the smaller id; all there are, if fewer.

    Every tree sorts all vectors by a long string of hash bits (sides of random planes). A query descends in each to the
    longest prefix it shares with others, and rises in all trees at once, a bit at a time, until ``candidates`` rows
    share its prefix, counted over the trees (by default ``wanted_candidates`` of their number); those are compared
    exactly. The sorted arrays are kept in blocks by a first prefix; a query whose blocks hold too few rows goes on to all
    blocks of a shorter one, at last to all there are. A block of many rows or
    queries is dealt into parts, each compared with each, so no task holds more than a bounded number of both.

    Equal vectors are one class to the trees, known by its smallest ids, which are all that can be among the nearest.
    Vectors that are null, zero, hold null, NaN or infinite components, or aren't of the most frequent length take no
    part, neither do rows of null ids. A row of one id isn't found for itself; rows of equal id and vector count once.
    An empty table gives no rows; other columns aren't read.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[vector]
    dtype = "f4" if kind == "array<float>" else "f8"
    v = F.col(vector)
    good = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0) & F.col(id).isNotNull()
    rows = df.where(good).select(F.col(id).cast("long").alias("id"), F.transform(v, lambda e: e + F.lit(0).cast("float")).alias("v"), is_query.alias("asked"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    shape = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("radius")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = shape["dim"]
    rows = written(rows.where(F.size("v") == dim).groupBy("id", "v").agg(F.max("asked").alias("asked")))
    few = Window.partitionBy("v").orderBy("id")
    ids = rows.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= k + 1)
    first = ids.groupBy("v").agg(F.min("id").alias("class"), F.array_sort(F.collect_set("id")).alias("ids"))
    asked = rows.where("asked").groupBy("v").agg(F.lit(True).alias("asked"))
    classes = first.join(asked, "v", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    # a class's smallest id may belong to two vectors, so classes get numbers, in the order of these ids: of equal scores a
    # block keeps those of the smallest
    placed = classes.repartitionByRange("class").sortWithinPartitions("class", "v")
    classes = written(placed.withColumn("class", F.monotonically_increasing_id()).select("class", "asked", "v", "ids"))
    n = classes.count()
    # rows are counted once per tree, so with fewer a search could meet fewer than k + 1 classes
    goal = max(candidates or wanted_candidates(n), trees * (k + 1))
    root = max(0, min(24, int(math.log2(max(1, n * trees / (8 * goal))))))
    hashed = written(classes.select("class", "asked", "v").mapInArrow(
        _hashed(dim, dtype, shape["radius"], root, trees), "tree int, block long, query boolean, class long, code long, vector binary"))
    keys = ["tree", "block", "part", "ask"]
    dealt = _dealt(hashed)
    narrow = dealt.select(*keys, "query", "class", "code").repartition(*keys).sortWithinPartitions(*keys)
    counts = narrow.mapInArrow(_levels(root), "class long, counts array<long>")
    levels = range(BITS + 1 - root)
    total = counts.groupBy("class").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in levels])
    # no level for a query whose blocks hold too few rows, or none at all
    level = F.greatest(*[F.when(F.col(f"c{i}") >= goal, i + root) for i in levels], F.lit(None).cast("int"))
    total = classes.where("asked").select("class").join(total, "class", "left")
    level = written(total.select("class", level.cast("int").alias("level"), F.lit(True).alias("query")))
    if root == 0:
        dealt = dealt.join(level.fillna(0, ["level"]), ["class", "query"], "left")
    elif level.where("level IS NULL").head(1):
        dealt = _dealt(_risen(hashed, level, root, goal))
    else:
        dealt = dealt.join(level, ["class", "query"], "left")
    full = (dealt.select(*keys, "query", "class", "code", "vector", "level")
            .repartition(*keys).sortWithinPartitions(*keys))
    found = full.mapInArrow(_search(dim, dtype, k + 1), "query_class long, class long, score double").distinct()
    # classes that can be among the nearest: each has at least one id, and equal scores are kept together
    nth = F.rank().over(Window.partitionBy("query_class").orderBy(F.desc("score")))
    found = found.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    small = classes.select("class", "ids")
    wide = found.join(small, "class").select("query_class", "score", F.explode("ids").alias("vec_id"))
    by = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "vec_id"))
    best = wide.withColumn("nth", by("query_class")).where(F.col("nth") <= k + 1).drop("nth")
    asks = rows.where("asked").join(classes.select(F.col("class").alias("query_class"), "v"), "v").select(F.col("id").alias("query_id"), "query_class")
    out = asks.join(written(best), "query_class").where("query_id <> vec_id").withColumn("rank", by("query_id")).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
