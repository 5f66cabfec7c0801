"""Repeated passages against all windows of all texts."""

import random
from collections import Counter

import pytest

from tidewright.llm import passages


def brute(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k:k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = {p for k in range(len(w) - window + 1) if seen[tuple(w[k:k + window])] > 1 for p in range(k, k + window)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "window", "seed"), [(512, 35, 8), (3, 35, 8), (4, 5, 2), (512, 3, 3)])
def test_random_texts(spark, monkeypatch, hot, window, seed):
    monkeypatch.setattr(passages, "HOT", hot)
    r = random.Random(window)
    word = lambda: f"w{r.randrange(60)}"
    shared = [[word() for _ in range(r.randint(20, 90))] for _ in range(5)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(r.randint(0, 80))]
        for s in r.sample(shared, r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = s[r.randint(0, 10):]
        rows.append((i, " ".join(w)))
    rows += [(100, "x " * 120), (101, "x y " * 60), (102, None), (103, ""), (None, "é " * 34), (104, rows[3][1]), (104, rows[3][1]), (105, "long " + "z" * 100_000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, start int")
    got = sorted((tuple(x) for x in passages.drop_repeated_passages(df, "doc_id", "text", window, seed).collect()), key=str)
    # a repeated row appears once per row
    assert got == brute(rows, window)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert passages.drop_repeated_passages(df, "doc_id", "text").count() == 0
