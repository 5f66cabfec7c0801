"""Repeatable writes: repeated, retried, interrupted and partial attempts."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidewright.sources import writers as WR

S = ["job"]


@pytest.fixture
def rows(spark):
    def make(value, jobs=("a", "b", None)):
        return spark.createDataFrame([(j, m, float(value)) for j in jobs for m in ("x", "y")], "job string, model string, v double")

    return make


def state(spark, path):
    return sorted(((r.job or "", r.model, r.v, r.attempt) for r in WR.published(spark, path, S).collect()))


def want(**jobs):
    return sorted((j if j != "none" else "", m, float(v), n) for j, (v, n) in jobs.items() for m in ("x", "y"))


def test_repeating_an_attempt_changes_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    for _ in range(2):
        WR.publish(rows(1), path, S, 1)
    assert state(spark, path) == want(a=(1, 1), b=(1, 1), none=(1, 1))


def test_later_attempts_win_only_their_own_scope(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    WR.publish(rows(1), path, S, 1)
    WR.publish(rows(3, ["b", None]), path, S, 3)
    WR.publish(rows(2, ["a", "b"]), path, S, 2)  # a late, earlier attempt
    assert state(spark, path) == want(a=(2, 2), b=(3, 3), none=(3, 3))
    # ten comes after three, as numbers do
    WR.publish(rows(10, ["b"]), path, S, 10)
    assert state(spark, path) == want(a=(2, 2), b=(10, 10), none=(3, 3))
    assert WR.prune(spark, path, S) == [1]
    assert WR.prune(spark, path, S) == []
    assert state(spark, path) == want(a=(2, 2), b=(10, 10), none=(3, 3))


def test_failing_attempt_leaves_the_earlier_rows(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    WR.publish(rows(1), path, S, 1)
    broken = rows(2).withColumn("v", F.when(F.col("model") == "y", F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        WR.publish(broken, path, S, 2)
    assert state(spark, path) == want(a=(1, 1), b=(1, 1), none=(1, 1))
    WR.publish(rows(2), path, S, 2)
    assert state(spark, path) == want(a=(2, 2), b=(2, 2), none=(2, 2))


def test_rows_without_a_complete_ledger_do_not_count(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    WR.publish(rows(1), path, S, 1)
    WR.publish(rows(2), path, S, 2)
    os.remove(os.path.join(path, "ledger", "attempt=2", "_SUCCESS"))  # stopped before the ledger was whole
    assert state(spark, path) == want(a=(1, 1), b=(1, 1), none=(1, 1))
    shutil.rmtree(os.path.join(path, "ledger", "attempt=2"))  # stopped before the ledger was begun
    assert state(spark, path) == want(a=(1, 1), b=(1, 1), none=(1, 1))
    WR.publish(rows(3), path, S, 3)
    assert WR.prune(spark, path, S) == [1, 2]


def test_rewriting_from_what_is_published(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    WR.publish(rows(1), path, S, 1)
    WR.publish(WR.published(spark, path, S).drop("attempt").withColumn("v", F.col("v") + 1), path, S, 2)
    assert state(spark, path) == want(a=(2, 2), b=(2, 2), none=(2, 2))


def test_edges(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        WR.published(spark, path, S)
    assert WR.prune(spark, path, S) == []
    WR.publish(rows(1).limit(0), path, S, 1)
    assert state(spark, path) == []
    with pytest.raises(ValueError):
        WR.publish(rows(1).withColumn("attempt", F.lit(1)), path, S, 2)
    with pytest.raises(ValueError):
        WR.publish(rows(1), path, [], 2)
