"""Set operations and orderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Keys, ordered
from .windows import global_rank


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; absent columns become NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def date_overlap(train: DataFrame, test: DataFrame, keys: Keys) -> DataFrame:
    """Dates both parts hold."""
    cols = [*keys, "ds"]
    return train.select(*cols).intersect(test.select(*cols))


def date_difference(spine: DataFrame, df: DataFrame, keys: Keys) -> DataFrame:
    """Dates of the spine that the series lacks."""
    cols = [*keys, "ds"]
    return spine.select(*cols).distinct().join(df.select(*cols).distinct(), cols, "left_anti")


def distinct_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def top_segments(m: DataFrame, n: int = 5, worst: bool = True, segment: str = "segment", mape: str = "mape") -> DataFrame:
    """The n worst or best segments; a top-n sort, not a full one."""
    valid = m.where(F.col(mape).isNotNull() & ~F.isnan(mape))
    return valid.orderBy(F.desc(mape) if worst else F.asc(mape), F.asc(segment)).limit(n)


def worst_periods(cmp: DataFrame, n: int = 5, error: str = "abs_pct_error", ties: Sequence[str] = ("ds",)) -> DataFrame:
    return cmp.orderBy(F.desc_nulls_last(error), *ties).limit(n)


def first_n(df: DataFrame, keys: Keys, n: int = 10, *order: Column | str) -> DataFrame:
    """First n rows of each series."""
    rn = F.row_number().over(ordered(keys, *order))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


# fixed order of job states, busiest first
_STATE = ("RUNNING", "QUEUED")


def state_rank(status: Column) -> Column:
    return F.when(status == _STATE[0], 1).when(status == _STATE[1], 2).otherwise(3)


def order_jobs(jobs: DataFrame, priority_rank: Column) -> DataFrame:
    """Running before queued before others, then higher priority (none last), then earlier."""
    return jobs.orderBy(state_rank(F.col("status")), priority_rank.asc_nulls_last(), "submitted_at", "job_id")


def place_jobs(jobs: DataFrame, priority_rank: Column, name: str = "place") -> DataFrame:
    """1-based place of each job in that order. Jobs are dealt by ranges of the order, so no task sees all of them; a job
    without a time comes before those of its state and priority that have one."""
    lead = jobs.withColumn("_state", state_rank(F.col("status"))).withColumn("_none", priority_rank.isNull()).withColumn("_priority", priority_rank)
    placed = global_rank(lead, F.unix_micros(F.col("submitted_at").cast("timestamp")), lead=["_state", "_none", "_priority"], ties=["job_id"], name=name)
    return placed.drop("_state", "_none", "_priority")


def recent_runs(jobs: DataFrame, user: str | int | None = None, n: int = 50, status: str | None = None, skip: int = 0) -> DataFrame:
    """Latest n runs of a user, optionally of one status."""
    if user is not None:
        jobs = jobs.where(F.col("user_id") == user)
    if status is not None:
        jobs = jobs.where(F.col("status") == status)
    out = jobs.orderBy(F.desc("submitted_at"), "job_id")
    return (out.offset(skip) if skip else out).limit(n)


def order_advice(df: DataFrame, score: str, ties: Sequence[str] = ()) -> DataFrame:
    """Highest score first."""
    return df.orderBy(F.desc_nulls_last(score), *ties)
