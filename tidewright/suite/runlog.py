"""Run-log queries."""

import os
import uuid

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import runlog as R
from ..operators import setops as S
from ..operators import windows as WN
from ..session import shared_folder
from ..sources import writers as WR
from .panels import ctes, panel, table
from .registry import query

NOW = "2001-07-30"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


PRIO = "CASE priority WHEN 'URGENT' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'NORMAL' THEN 3 WHEN 'LOW' THEN 4 END"
RANKED = "rr AS (SELECT *, CASE WHEN mape IS NOT NULL THEN rank() OVER (PARTITION BY job_id ORDER BY mape NULLS LAST) END AS rank_by_mape, coalesce(mape = min(mape) OVER (PARTITION BY job_id), false) AS is_best_model FROM results)"


@query("log1_user_summary", "user_id:i total_jobs:i completed_jobs:i failed_jobs:i avg_mape:f6 best_mape:f6 total_compute_seconds:i last_job_at:t", f"""
{ctes('jobs')} SELECT user_id, count(*) AS total_jobs, count(*) FILTER (status = 'COMPLETED') AS completed_jobs, count(*) FILTER (status = 'FAILED') AS failed_jobs, avg(best_mape) FILTER (status = 'COMPLETED') AS avg_mape,
min(best_mape) FILTER (status = 'COMPLETED') AS best_mape, sum(duration_seconds) FILTER (status = 'COMPLETED') AS total_compute_seconds, max(submitted_at) AS last_job_at FROM jobs GROUP BY user_id""")
def _(spark, d):
    return R.user_summary(panel(spark, d, "jobs"))


@query("log2_recent_results", "job_id:i user_id:i model_name:s mape:f6 rmse:f2 rank_by_mape:i is_best_model:b completed_at:t", f"""
{ctes('jobs', 'results')}, {RANKED} SELECT rr.*, user_id, completed_at FROM rr JOIN jobs USING (job_id) WHERE status = 'COMPLETED'""")
def _(spark, d):
    return R.recent_results(panel(spark, d, "jobs"), panel(spark, d, "results"))


@query("log3_active_jobs", "job_id:i user_id:i status:s priority:s enqueued_at:t submitted_at:t", f"""
{ctes('jobs', 'queue_gaps')} SELECT jobs.*, priority, enqueued_at FROM jobs LEFT JOIN queue_gaps USING (job_id) WHERE status IN ('PENDING', 'QUEUED', 'RUNNING')""")
def _(spark, d):
    return R.active_jobs(panel(spark, d, "jobs"), panel(spark, d, "queue_gaps"))


@query("log4_model_trend", "job_id:i submitted_at:t mape:f6 rmse:f2 is_best_model:b", f"""
{ctes('jobs', 'results')}, {RANKED} SELECT job_id, submitted_at, mape, rmse, is_best_model FROM rr JOIN jobs USING (job_id) WHERE status = 'COMPLETED' AND model_name = 'ets' ORDER BY submitted_at DESC, job_id, mape NULLS LAST, rmse NULLS LAST LIMIT 20""")
def _(spark, d):
    return R.model_trend(panel(spark, d, "jobs"), panel(spark, d, "results"), None, "ets", 20)


@query("log5_compare_runs", "model_name:s n_runs:i min_mape:f6 avg_mape:f6 best_job:i overall_job:i overall_mape:f6", f"""
{ctes('jobs', 'results')}, b AS (SELECT job_id AS overall_job, best_mape AS overall_mape FROM jobs WHERE frequency = 'weekly' AND best_mape IS NOT NULL ORDER BY best_mape, job_id LIMIT 1),
r AS (SELECT results.* FROM results JOIN jobs USING (job_id) WHERE frequency = 'weekly') SELECT model_name, count(*) AS n_runs, min(mape) AS min_mape, avg(mape) AS avg_mape,
(SELECT job_id FROM r r2 WHERE r2.model_name = r.model_name ORDER BY mape NULLS LAST, job_id LIMIT 1) AS best_job, any_value(overall_job) AS overall_job, any_value(overall_mape) AS overall_mape FROM r, b GROUP BY model_name""")
def _(spark, d):
    jobs, res = panel(spark, d, "jobs"), panel(spark, d, "results")
    best, scores = R.compare_runs(jobs, res, jobs.where("frequency = 'weekly'"))
    return scores.crossJoin(F.broadcast(best.select(F.col("job_id").alias("overall_job"), F.col("best_mape").alias("overall_mape"))))


@query("log6_queue_stats", "queue_length:i urgent_count:i high_count:i normal_count:i low_count:i avg_wait_seconds:f3 max_wait_seconds:f3 mean_duration:f4 wait_estimate_seconds:i", f"""
{ctes('jobs', 'queue')}, q AS (SELECT count(*) FILTER (is_active) AS queue_length, count(*) FILTER (is_active AND priority = 'URGENT') AS urgent_count, count(*) FILTER (is_active AND priority = 'HIGH') AS high_count, count(*) FILTER (is_active AND priority = 'NORMAL') AS normal_count,
count(*) FILTER (is_active AND priority = 'LOW') AS low_count, avg(epoch(TIMESTAMP '{NOW}' - enqueued_at)) FILTER (is_active) AS avg_wait_seconds, max(epoch(TIMESTAMP '{NOW}' - enqueued_at)) FILTER (is_active) AS max_wait_seconds FROM queue),
j AS (SELECT coalesce(avg(duration_seconds) FILTER (status = 'COMPLETED' AND completed_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR), 300) AS mean_duration FROM jobs) SELECT *, floor((queue_length + 1) * mean_duration) AS wait_estimate_seconds FROM q, j""")
def _(spark, d):
    return R.queue_stats(panel(spark, d, "queue"), panel(spark, d, "jobs"), now())


@query("log7_platform_stats", "active_sessions:i running_jobs:i pending_jobs:i queued_jobs:i jobs_24h:i avg_duration_24h:f4", f"""
{ctes('jobs', 'queue')} SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active_sessions, (SELECT count(*) FROM jobs WHERE status = 'RUNNING') AS running_jobs, (SELECT count(*) FROM jobs WHERE status = 'PENDING') AS pending_jobs,
(SELECT count(*) FROM queue WHERE is_active) AS queued_jobs, (SELECT count(*) FROM jobs WHERE submitted_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS jobs_24h,
(SELECT avg(duration_seconds) FROM jobs WHERE status = 'COMPLETED' AND completed_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS avg_duration_24h""")
def _(spark, d):
    sessions = table(spark, d, "customer").select((F.col("c_acctbal") > 0).alias("is_active"))
    return R.platform_stats(sessions, panel(spark, d, "jobs"), panel(spark, d, "queue"), now())


@query("log8_latest_upload", "user_id:i data_hash:s upload_id:i uploaded_at:t", f"""
{ctes('uploads')} SELECT user_id, data_hash, upload_id, uploaded_at FROM uploads WHERE NOT is_deleted QUALIFY row_number() OVER (PARTITION BY user_id, data_hash ORDER BY uploaded_at DESC, upload_id DESC) = 1""")
def _(spark, d):
    return R.latest_upload(panel(spark, d, "uploads"))


@query("log9_finalize_runs", "job_id:i status:s duration_seconds:i best_model:s best_mape:f6 best_rmse:f2 models_trained:i", f"""
{ctes('jobs', 'results')}, b AS (SELECT job_id, model_name, mape, rmse FROM results WHERE mape IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY mape, model_name, rmse) = 1), n AS (SELECT job_id, count(*) AS c FROM results GROUP BY job_id)
SELECT job_id, status, CASE WHEN status IN ('COMPLETED', 'FAILED', 'CANCELLED') AND started_at IS NOT NULL THEN epoch(completed_at - started_at) ELSE duration_seconds END AS duration_seconds, model_name AS best_model, mape AS best_mape, rmse AS best_rmse, coalesce(c, 0) AS models_trained
FROM jobs LEFT JOIN b USING (job_id) LEFT JOIN n USING (job_id)""")
def _(spark, d):
    return R.finalize_runs(panel(spark, d, "jobs"), panel(spark, d, "results"))


@query("log9_publish_final", "status:s n:i n_final:i seconds:i models:i", f"""
{ctes('jobs', 'results')}, n AS (SELECT job_id, count(*) AS models_trained FROM results GROUP BY job_id)
SELECT status, count(*) AS n, count(*) AS n_final, sum(CASE WHEN status IN ('COMPLETED', 'FAILED', 'CANCELLED') AND started_at IS NOT NULL THEN epoch(completed_at - started_at) ELSE duration_seconds END) AS seconds,
 coalesce(sum(models_trained), 0) AS models FROM jobs LEFT JOIN n USING (job_id) GROUP BY status""")
def _(spark, d):
    """Jobs are published open, then rewritten with their results; each is read once, from the final attempt."""
    path = os.path.join(shared_folder(spark), f"runs-{uuid.uuid4().hex}")
    jobs = panel(spark, d, "jobs")
    final = R.finalize_runs(jobs, panel(spark, d, "results"))
    WR.publish(final.limit(0).unionByName(jobs, allowMissingColumns=True).select(*final.columns), path, ["job_id"], 1)
    WR.publish(final, path, ["job_id"], 2)
    return WR.published(spark, path, ["job_id"]).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("attempt") == 2).alias("n_final"), F.sum("duration_seconds").alias("seconds"), F.sum("models_trained").alias("models"))


@query("log10_reproduction_params", "original_job_id:i request_params:s random_seed:i horizon:i frequency:s submitted_at:t", f"""
{ctes('jobs')} SELECT job_id AS original_job_id, request_params, random_seed, horizon, frequency, submitted_at FROM jobs""")
def _(spark, d):
    return R.reproduction_params(panel(spark, d, "jobs"))


@query("win17_queue_position", "job_id:i priority:s position:i", f"""
{ctes('queue')} SELECT job_id, priority, rank() OVER (ORDER BY {PRIO}, enqueued_at) AS position FROM queue WHERE is_active""")
def _(spark, d):
    return WN.queue_position(panel(spark, d, "queue"), R.priority_rank(F.col("priority")))


@query("jon14_join_runs", "job_id:i user_id:i status:s model_name:s mape:f6 priority:s", f"""
{ctes('jobs', 'results', 'queue_gaps')} SELECT jobs.job_id, user_id, status, model_name, mape, priority FROM jobs JOIN results USING (job_id) LEFT JOIN queue_gaps ON queue_gaps.job_id = jobs.job_id""")
def _(spark, d):
    return J.join_runs(J.join_runs(panel(spark, d, "jobs"), panel(spark, d, "results"), "inner"), panel(spark, d, "queue_gaps"), "left")


@query("srt4_order_jobs", "job_id:i status:s priority:s place:i", f"""
{ctes('jobs', 'queue')} SELECT job_id, status, priority, row_number() OVER (ORDER BY CASE status WHEN 'RUNNING' THEN 1 WHEN 'QUEUED' THEN 2 ELSE 3 END, {PRIO} NULLS LAST, submitted_at, job_id) AS place FROM jobs JOIN queue USING (job_id)""")
def _(spark, d):
    jobs = J.join_runs(panel(spark, d, "jobs"), panel(spark, d, "queue"), "inner")
    return S.place_jobs(jobs, R.priority_rank(F.col("priority")))


@query("srt5_recent_runs", "job_id:i user_id:i status:s submitted_at:t", f"""
{ctes('jobs')} SELECT job_id, user_id, status, submitted_at FROM jobs WHERE status = 'COMPLETED' ORDER BY submitted_at DESC, job_id LIMIT 50""")
def _(spark, d):
    return S.recent_runs(panel(spark, d, "jobs"), None, 50, "COMPLETED")
