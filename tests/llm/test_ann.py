"""Nearest vectors against all products."""

import numpy as np

from tidewright.llm import ann
from tidewright.llm.store import table


def brute(rows, k):
    good = [(i, np.array(v, "f8")) for i, v in rows if i is not None and v is not None and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            s = sorted(((-(v * w).sum(), j) for j, w in good if j != i))[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark):
    from pyspark.sql import functions as F

    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 20)
    got = result(ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0))
    assert set(got) == set(want)
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.9
    truth = {(q, j): s for q in want for j, s in want[q]}
    assert all(abs(s - truth[q, j]) < 1e-12 for q in got for j, s in got[q] if (q, j) in truth)


def test_odd_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ann, "BLOCK", 8)
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(4).astype("f4").tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.5, -1.0]) for i in range(50)] + [(200, None), (220, [0.0] * 4), (240, [1.0, None, 1.0, 1.0]), (260, [float("nan"), 1.0, 1.0, 1.0]),
                                                                    (280, [float("inf")] * 4), (None, [1.0] * 4), (300, [-0.0, 0.0, 1.0, 5.0]), (301, [0.0, -0.0, 1.0, 5.0])]
    df = spark.createDataFrame([(*x, 0, "a") for x in rows], "vec_id long, embedding array<float>, class int, score string")
    got = result(ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=7, candidates=10_000))
    want = brute(rows, 7)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    assert ann.nearest(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0).count() == 0
    assert result(ann.nearest(df.union(df), "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=7, candidates=10_000)) == got


def test_ties_of_distinct_vectors(spark):
    """Two hundred different vectors of one product with every query: the smallest ids are kept."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    rows = [(int(i), [1.0, 0.0, 0.0, 0.0] if i % 20 == 0 else [1.0, *r.integers(-9, 10, 3).astype(float).tolist()]) for i in r.permutation(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = result(ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=7, candidates=10_000))
    assert got == brute(rows, 7)


def test_one_very_long_vector(spark):
    """One vector's length puts all index rows in one block of each tree: queries of other blocks rise to those as well."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(6)
    rows = [(i, (x / np.linalg.norm(x) * (1000 if i == 7 else 1)).tolist()) for i, x in enumerate(r.standard_normal((600, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=5, trees=3, candidates=18))
    want = brute(rows, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 5 for q in want]) >= 0.9
