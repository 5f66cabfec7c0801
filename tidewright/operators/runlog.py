"""Queries over the run log: jobs, their results, the queue, uploads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .setops import state_rank

# fixed order of queue priorities, highest first
PRIORITIES = ("URGENT", "HIGH", "NORMAL", "LOW")
OPEN = ("PENDING", "QUEUED", "RUNNING")
ENDED = ("COMPLETED", "FAILED", "CANCELLED")


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def priority_rank(c: Column) -> Column:
    """1 for the highest; NULL for none."""
    return F.nullif(F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), c), F.lit(0))


def user_summary(jobs: DataFrame) -> DataFrame:
    """Jobs, outcomes, errors and compute time per user."""
    done = F.col("status") == "COMPLETED"
    return jobs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if(done).alias("completed_jobs"), F.count_if(F.col("status") == "FAILED").alias("failed_jobs"),
        F.avg(F.when(done, F.col("best_mape"))).alias("avg_mape"), F.min(F.when(done, F.col("best_mape"))).alias("best_mape"),
        F.sum(F.when(done, F.col("duration_seconds"))).alias("total_compute_seconds"), F.max("submitted_at").alias("last_job_at"))


def ranked_results(res: DataFrame) -> DataFrame:
    """Results with their rank by error inside the job and the best flag."""
    r = F.rank().over(W.partitionBy("job_id").orderBy(F.col("mape").asc_nulls_last()))
    return res.withColumn("rank_by_mape", F.when(F.col("mape").isNotNull(), r)).withColumn("is_best_model", F.coalesce(F.col("rank_by_mape") == 1, F.lit(False)))


def recent_results(jobs: DataFrame, res: DataFrame) -> DataFrame:
    """Results of completed jobs, latest job first, best model first."""
    done = jobs.where("status = 'COMPLETED'").select("job_id", "user_id", "submitted_at", "completed_at", "horizon", "frequency")
    return done.join(ranked_results(res), "job_id").orderBy(F.desc("completed_at"), F.col("rank_by_mape").asc_nulls_last(), "job_id", "model_name", "mape", "rmse")


def active_jobs(jobs: DataFrame, queue: DataFrame) -> DataFrame:
    """Open jobs with their queue entry: running, queued, then pending; by priority; oldest first."""
    q = queue.select("job_id", "priority", "enqueued_at")
    rows = jobs.where(F.col("status").isin(*OPEN)).join(q, "job_id", "left")
    return rows.orderBy(state_rank(F.col("status")), priority_rank(F.col("priority")).asc_nulls_last(), "submitted_at", "job_id")


def model_trend(jobs: DataFrame, res: DataFrame, user: str | int | None, model: str, n: int = 20) -> DataFrame:
    """Latest n completed results of one model of one user (all users when None)."""
    done = jobs.where("status = 'COMPLETED'")
    if user is not None:
        done = done.where(F.col("user_id") == user)
    rows = ranked_results(res).where(F.col("model_name") == model).join(done.select("job_id", "submitted_at"), "job_id")
    return rows.select("job_id", "submitted_at", "mape", "rmse", "is_best_model").orderBy(
        F.desc("submitted_at"), "job_id", F.col("mape").asc_nulls_last(), F.col("rmse").asc_nulls_last()).limit(n)


def compare_runs(jobs: DataFrame, res: DataFrame, ids: Sequence[object] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(best job among the given ones, scores of every model over them)``; ids as a short list or a table."""
    def chosen(df: DataFrame) -> DataFrame:
        return df.join(ids.select("job_id").distinct(), "job_id", "left_semi") if isinstance(ids, DataFrame) else df.where(F.col("job_id").isin(list(ids)))

    best = chosen(jobs).where(F.col("best_mape").isNotNull()).orderBy("best_mape", "job_id").limit(1).select("job_id", "best_model", "best_mape")
    per = chosen(res).join(chosen(jobs).select("job_id"), "job_id", "left_semi")
    scores = per.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_runs"), F.min("mape").alias("min_mape"), F.avg("mape").alias("avg_mape"), F.min_by("job_id", F.when(F.col("mape").isNotNull(), F.struct("mape", "job_id"))).alias("best_job"))
    return best, scores


def score_lists(res: DataFrame, ids: Sequence[object]) -> DataFrame:
    """For a few runs: the list of (job, mape, rmse) per model; bounded by the number of ids."""
    rows = res.where(F.col("job_id").isin(list(ids)))
    return rows.groupBy("model_name").agg(F.array_sort(F.collect_list(F.struct("job_id", "mape", "rmse"))).alias("scores"))


def queue_stats(queue: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Length of the queue by priority, waits, and the mean duration of the last day's completed jobs (300 s without any)."""
    live = F.col("is_active")
    wait = seconds_between(F.col("enqueued_at"), now)
    q = queue.agg(
        F.count_if(live).alias("queue_length"), *[F.count_if(live & (F.col("priority") == p)).alias(f"{p.lower()}_count") for p in PRIORITIES],
        F.avg(F.when(live, wait)).alias("avg_wait_seconds"), F.max(F.when(live, wait)).alias("max_wait_seconds"))
    recent = (F.col("status") == "COMPLETED") & (seconds_between(F.col("completed_at"), now) < 86400)
    d = jobs.agg(F.coalesce(F.avg(F.when(recent, F.col("duration_seconds"))), F.lit(300.0)).alias("mean_duration"))
    return q.crossJoin(F.broadcast(d)).withColumn("wait_estimate_seconds", F.floor((F.col("queue_length") + 1) * F.col("mean_duration")))


def platform_stats(sessions: DataFrame, jobs: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    """Six numbers of the platform: each table is read once and the one-row results are put side by side."""
    s = sessions.agg(F.count_if("is_active").alias("active_sessions"))
    day = seconds_between(F.col("submitted_at"), now) < 86400
    done = (F.col("status") == "COMPLETED") & (seconds_between(F.col("completed_at"), now) < 86400)
    j = jobs.agg(F.count_if(F.col("status") == "RUNNING").alias("running_jobs"), F.count_if(F.col("status") == "PENDING").alias("pending_jobs"),
                 F.count_if(day).alias("jobs_24h"), F.avg(F.when(done, F.col("duration_seconds"))).alias("avg_duration_24h"))
    q = queue.agg(F.count_if("is_active").alias("queued_jobs"))
    return s.crossJoin(F.broadcast(j)).crossJoin(F.broadcast(q))


def latest_upload(uploads: DataFrame, user: object | None = None, data_hash: str | None = None) -> DataFrame:
    """Latest upload not deleted per user and content hash, optionally of one of each."""
    rows = uploads.where(~F.col("is_deleted"))
    if user is not None:
        rows = rows.where(F.col("user_id") == user)
    if data_hash is not None:
        rows = rows.where(F.col("data_hash") == data_hash)
    rest = [c for c in uploads.columns if c not in ("user_id", "data_hash")]
    return rows.groupBy("user_id", "data_hash").agg(F.max_by(F.struct(*rest), F.struct("uploaded_at", "upload_id")).alias("u")).select("user_id", "data_hash", "u.*")


def finalize_runs(jobs: DataFrame, res: DataFrame) -> DataFrame:
    """Jobs with duration of ended ones, best model, its errors and the number of models tried."""
    best = res.groupBy("job_id").agg(
        F.min_by(F.struct("model_name", "mape", "rmse"), F.when(F.col("mape").isNotNull(), F.struct("mape", "model_name", "rmse"))).alias("b"), F.count(F.lit(1)).alias("models_trained"))
    ended = F.col("status").isin(*ENDED) & F.col("started_at").isNotNull()
    seconds = F.round(seconds_between(F.col("started_at"), F.col("completed_at"))).cast("bigint")
    drop = [c for c in ("best_model", "best_mape", "duration_seconds") if c in jobs.columns]
    old = F.col("duration_seconds") if "duration_seconds" in jobs.columns else F.lit(None)
    rows = jobs.withColumn("_d", F.when(ended, seconds).otherwise(old)).drop(*drop)
    return rows.join(best, "job_id", "left").select(
        *[c for c in rows.columns if c != "_d"], F.col("_d").alias("duration_seconds"), F.col("b.model_name").alias("best_model"), F.col("b.mape").alias("best_mape"),
        F.col("b.rmse").alias("best_rmse"), F.coalesce("models_trained", F.lit(0)).alias("models_trained"))


def reproduction_params(jobs: DataFrame, job_id: object | None = None) -> DataFrame:
    """What it takes to repeat a run (all runs when no id is given)."""
    rows = jobs if job_id is None else jobs.where(F.col("job_id") == job_id)
    want = ("request_params", "data_upload_id", "data_hash", "random_seed", "confidence_level", "horizon", "frequency", "submitted_at")
    return rows.select(F.col("job_id").alias("original_job_id"), *[c for c in want if c in jobs.columns])
