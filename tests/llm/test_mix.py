"""Mixing against a plain version of its rule."""

import hashlib
import random
from fractions import Fraction

from pyspark.sql import functions as F

from tidewright.llm import mix


def fill(sizes, weights=(3, 1, 2)):
    """Targets by sharing again and again what is above the limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        left = {s: w[s] for s in order if s not in full}
        rest = total - sum(full.values())
        share = {s: rest * w[s] / sum(left.values()) for s in left}
        above = {s: Fraction(2 * sizes[s]) for s in left if share[s] > 2 * sizes[s] or not sizes[s]}
        if not above:
            return {**full, **share}
        full |= above


def brute(rows):
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    target, out = fill(sizes), {}
    for s in sizes:
        own = [(int(hashlib.md5(f"1\x1f{'-' if i is None else i}".encode()).hexdigest()[:15], 16), i, n or 0) for i, t, n in rows if t == s]
        epochs, rest = divmod(int(target[s]), sizes[s]) if sizes[s] else (0, 0)
        at = 0
        for _, i, n in sorted(own, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
            out[i, s] = epochs * n + max(0, min(n, rest - at))
            at += n
    return target, out


def test_against_brute_force(spark):
    r = random.Random(8)
    for case in range(3):
        names = ["b", "a", None, "é", "z", "Z", ""][: 3 + 2 * case]
        rows = [(i, r.choice(names + names[:1] * 5), r.choice([0, None, 1, 5, 30, 400])) for i in range(300)]
        target, taken = brute(rows)
        df = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, source string, size long, target double")
        got = mix.mix(df, "doc_id", "source", "size").collect()
        assert {(g["doc_id"], g["source"]): g["taken"] for g in got} == taken
        assert all(abs(g["target"] - float(target[g["source"]])) < 1e-6 and g["taken"] <= 2 * (g["size"] or 0) for g in got)


def test_odd_tables(spark):
    schema = "doc_id long, source string, size long"
    assert mix.mix(spark.createDataFrame([], schema), "doc_id", "source", "size").count() == 0
    got = mix.mix(spark.createDataFrame([(1, "a", 0), (None, None, None)], schema), "doc_id", "source", "size").collect()
    assert [g["taken"] for g in got] == [0, 0]
    twins = spark.createDataFrame([(1, "a", 7)] * 9 + [(2, "b", 1000)], schema)
    got = mix.mix(twins, "doc_id", "source", "size").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect()
    assert all(0 <= g["w"] - g["t"] < 9 for g in got)
