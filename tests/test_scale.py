"""Helpers that must stay exact under skew, checked by brute force, and results that must not depend on partitioning."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import quality as Q
from tidewright.operators import windows as WN
from tidewright.operators.forecast import base as B
from tidewright.operators.intervals import bootstrap_interval
from tidewright.operators.quantiles import exact_quantiles


def test_quantiles_by_rank(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.choice([1, 2, 2, 3, 50, rng.random() * 100]))) for _ in range(3000)] + [("cold", v) for v in (4.0, 1.0)] + [(None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q9": 0.9, "q1": 1.0}
    got = {r.k: [r[c] for c in probs] for r in exact_quantiles(df, ["k"], "v", probs, buckets=16).collect()}
    for k in ("hot", "cold", None):
        want = np.quantile([v for kk, v in rows if kk == k], list(probs.values()))
        assert got[k] == pytest.approx(list(want))
    whole = exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(float(np.median([v for _, v in rows])))


def test_equal_values_are_ranked_by_their_ties(spark):
    df = spark.createDataFrame([(f"s{i:04d}", 500.0) for i in range(3000)], "segment string, mape double").repartition(7)
    got = {r.segment: r["rank"] for r in WN.rank_segments(df).collect()}
    assert got == {f"s{i:04d}": i + 1 for i in range(3000)}


def test_global_rank(spark):
    rng = random.Random(5)
    rows = [(f"s{i:04d}", float(rng.choice([7, 7, 7, rng.randint(0, 500)]))) for i in range(2000)]
    df = spark.createDataFrame(rows, "segment string, mape double").repartition(7)
    got = {r.segment: r["rank"] for r in WN.rank_segments(df).collect()}
    want = {s: i + 1 for i, (s, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want


def test_fingerprint_is_order_free(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("s"))
    a = Q.fingerprint(df).first()["hash"]
    assert a == Q.fingerprint(df.repartition(13).select("s", "id")).first()["hash"]
    assert a != Q.fingerprint(df.where("id <> 5")).first()["hash"]
    assert Q.verify(df, a).first()["is_intact"]


def test_grid_sample_is_stable(spark):
    g = B.grid_table(spark, {"a": range(10), "b": range(5)})
    one = sorted(r.cand for r in B.limit_grid(g, 20, 42).collect())
    assert one == sorted(r.cand for r in B.limit_grid(g.repartition(9), 20, 42).collect()) and len(one) == 20
    assert one != sorted(r.cand for r in B.limit_grid(g, 20, 43).collect())


def test_bootstrap_is_stable_and_ordered(spark):
    fc = spark.createDataFrame([("a", h, 100.0 + h) for h in range(1, 7)], "series string, h int, yhat double")
    res = spark.createDataFrame([("a", float(i - 25)) for i in range(51)], "series string, res double")
    a = sorted(map(tuple, bootstrap_interval(fc, res, ["series"], 400).collect()))
    assert a == sorted(map(tuple, bootstrap_interval(fc.repartition(5), res.repartition(3), ["series"], 400).collect()))
    r = bootstrap_interval(fc, res, ["series"], 2000).first()
    assert r.lower_95 < r.lower_80 < r.lower_50 < r.yhat < r.upper_50 < r.upper_80 < r.upper_95
    assert r.upper_95 - r.yhat == pytest.approx(24, abs=2)


def test_bootstrap_draws_are_those_of_a_plain_loop(spark):
    import hashlib

    import numpy as np

    keys = ["a", "b"]
    fc = spark.createDataFrame([("x", None, 1, 5.0), ("x", None, 2, 6.0), ("y", 3, 1, 7.0), ("z", 1, 1, 8.0)], "a string, b int, h int, yhat double")
    fc = fc.withColumn("b", F.coalesce("b", F.lit(9)))
    res = spark.createDataFrame([("x", 9, v) for v in (3.0, -1.0, 2.0, None, 0.5)] + [("y", 3, 4.0)], "a string, b int, res double")
    got = {(r.a, r.h): (r.lower_80, r.upper_80) for r in bootstrap_interval(fc, res, keys, 50, (0.8,), seed=7).collect()}
    assert set(got) == {("x", 1), ("x", 2), ("y", 1)} and got["y", 1] == (11.0, 11.0)
    pool = sorted([3.0, -1.0, 2.0, 0.5])
    for h, yhat in ((1, 5.0), (2, 6.0)):
        draws = [pool[int(hashlib.md5(f"7|x|9|{h}|{i}".encode()).hexdigest()[:8], 16) % 4] for i in range(1, 51)]
        assert got["x", h] == pytest.approx([yhat + v for v in np.quantile(draws, [0.1, 0.9])])


def test_windows_without_keys(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "ds date, y double")
    assert WN.drop_incomplete_tail(df, []).count() == 30
    assert WN.split_series(df, [], 5).groupBy("split").count().count() >= 2
