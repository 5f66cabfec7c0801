"""Accuracy, overfitting, batch statistics, intervals."""

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import intervals as I
from ..operators import setops as S
from ..operators import windows as WN
from .forecast import metrics_sql
from .panels import ctes, panel, table
from .registry import query

K = ["series"]
KM = ["series", "model"]

# pairs with zeros, extremes and gaps
_ODD = """SELECT series, model, h, ds, CASE WHEN h % 5 = 0 AND series < 'AS' THEN 0 WHEN h % 9 = 0 AND series = 'EUROPE' THEN 0 WHEN series = 'MIDDLE EAST' THEN 0 ELSE y END AS y,
CASE WHEN h = 3 AND model = 'last' THEN yhat * 40 ELSE yhat END AS yhat FROM {models}"""


def odd(spark, d):
    return spark.sql(_ODD, models=panel(spark, d, "models"))


ODD = f"odd AS ({_ODD.replace('{models}', 'models')})"
_NZ = "abs(y) > 1e-10"
_SM = "avg(least(100, abs(y - yhat) / (abs(y) + abs(yhat) + 1e-10) * 100))"


@query("evl1_mape", "series:s model:s mape:f6", f"""
{ctes('models')}, {ODD} SELECT series, model, CASE WHEN count(*) FILTER ({_NZ}) = 0 OR (count(*) - count(*) FILTER ({_NZ})) / count(*) > 0.2 THEN {_SM}
ELSE avg(least(1000, abs((y - yhat) / y) * 100)) FILTER ({_NZ}) END AS mape FROM odd GROUP BY ALL""")
def _(spark, d):
    return E.mape(odd(spark, d), KM)


@query("evl2_smape_wape", "series:s model:s smape:f6 wape:f6", f"""
{ctes('models')}, {ODD} SELECT series, model, {_SM} AS smape, CASE WHEN sum(abs(y)) < 1e-10 THEN least(avg(abs(yhat)) * 100, 500) ELSE least(500, sum(abs(y - yhat)) / sum(abs(y)) * 100) END AS wape FROM odd GROUP BY ALL""")
def _(spark, d):
    return E.smape(odd(spark, d), KM).join(E.wape(odd(spark, d), KM), KM)


@query("evl3_metrics", "series:s model:s n:i rmse:f2 mape:f2 wape:f2 r2:f4", f"""
{ctes('models')} {metrics_sql('models', 'series, model')}""")
def _(spark, d):
    bad = panel(spark, d, "models").where("h <= 6").withColumn("y", F.when(F.col("h") % 2 == 0, float("nan")).otherwise(None))
    return E.metrics(panel(spark, d, "models").unionByName(bad), KM)


@query("evl4_holdout_mape", "series:s model:s n:i n_extreme:i holdout_mape:f6", f"""
{ctes('models')}, x AS (SELECT series, model, h, y, CASE WHEN h = 3 AND model = 'last' THEN yhat * 40 ELSE yhat END AS yhat FROM models), e AS (SELECT *, abs((y - yhat) / (y + 1e-10)) * 100 AS e FROM x)
SELECT series, model, count(*) AS n, count(*) FILTER (e > 500) AS n_extreme, CASE WHEN count(*) FILTER (e > 500) BETWEEN 1 AND count(*) - 1 THEN median(e) ELSE avg(e) END AS holdout_mape FROM e GROUP BY ALL""")
def _(spark, d):
    df = panel(spark, d, "models").withColumn("yhat", F.when((F.col("h") == 3) & (F.col("model") == "last"), F.col("yhat") * 40).otherwise(F.col("yhat")))
    return E.holdout_mape(df, KM)


@query("evl6_weighted_cv", "series:s model:s weighted_mean:f6 weighted_std:f6", f"""
{ctes('models')}, f AS (SELECT series, model, (h - 1) // 8 AS fold, avg(abs((y - yhat) / y) * 100) AS mape FROM models GROUP BY ALL),
w AS (SELECT *, 1 + (row_number() OVER (PARTITION BY series, model ORDER BY fold) - 1) / count(*) OVER (PARTITION BY series, model) * 0.5 AS w FROM f), m AS (SELECT *, sum(w * mape) OVER (PARTITION BY series, model) / sum(w) OVER (PARTITION BY series, model) AS m FROM w)
SELECT series, model, any_value(m) AS weighted_mean, sqrt(sum(w * (mape - m) ** 2) / sum(w)) AS weighted_std FROM m GROUP BY ALL""")
def _(spark, d):
    folds = panel(spark, d, "models").withColumn("fold", F.floor((F.col("h") - 1) / 8)).groupBy(*KM, "fold").agg(F.avg(F.abs((F.col("y") - F.col("yhat")) / F.col("y")) * 100).alias("mape"))
    return E.weighted_cv(folds, KM)


# train, eval and holdout errors of the simple models: first, middle and last eight weeks
_TRI = """SELECT series, model, avg(CASE WHEN h <= 8 THEN abs((y - yhat) / y) * 100 END) / CASE WHEN model = 'last' THEN 12 WHEN model = 'month' THEN 4 ELSE 1 END AS train_mape,
avg(CASE WHEN h > 8 AND h <= 16 THEN abs((y - yhat) / y) * 100 END) AS eval_mape, avg(CASE WHEN h > 16 THEN abs((y - yhat) / y) * 100 END) AS holdout_mape FROM {models} GROUP BY series, model"""
TRI = f"tri AS ({_TRI.replace('{models}', 'models')})"


def tri(spark, d):
    return spark.sql(_TRI, models=panel(spark, d, "models"))


SEV = "CASE WHEN eval_mape / train_mape >= 20 THEN 'severe' WHEN eval_mape / train_mape >= 10 THEN 'high' WHEN eval_mape / train_mape >= 5 THEN 'medium' WHEN eval_mape / train_mape >= 2 THEN 'low' ELSE 'none' END"


@query("evl7_overfit", "series:s model:s overfit_ratio:f6 severity:s is_overfitting:b is_overfit:b", f"""
{ctes('models')}, {TRI} SELECT series, model, eval_mape / train_mape AS overfit_ratio, {SEV} AS severity, eval_mape / train_mape >= 2 AS is_overfitting, eval_mape / train_mape > 3 AS is_overfit FROM tri""")
def _(spark, d):
    return E.overfit(tri(spark, d))


@query("evl8_compare_models", "series:s model:s eval_mape:f6 holdout_mape:f6 mape_difference:f2 overfit_warning:b place:i is_best:b", f"""
{ctes('models')}, {TRI} SELECT series, model, eval_mape, holdout_mape, round(holdout_mape - eval_mape, 2) AS mape_difference, holdout_mape > eval_mape * 1.5 AS overfit_warning,
row_number() OVER (PARTITION BY series ORDER BY holdout_mape, model) AS place, row_number() OVER (PARTITION BY series ORDER BY holdout_mape, model) = 1 AS is_best FROM tri""")
def _(spark, d):
    return E.compare_models(tri(spark, d), K)


@query("win12_rank_models", "series:s model:s mape:f6 rank:i is_best:b", f"""
{ctes('models')}, {TRI}, m AS (SELECT series, model, CASE WHEN model = 'year' AND series < 'B' THEN NULL ELSE holdout_mape END AS mape FROM tri)
SELECT *, CASE WHEN mape IS NOT NULL THEN rank() OVER (PARTITION BY series ORDER BY mape NULLS LAST) END AS rank, coalesce(mape = min(mape) OVER (PARTITION BY series), false) AS is_best FROM m""")
def _(spark, d):
    m = tri(spark, d).withColumn("mape", F.when((F.col("model") == "year") & (F.col("series") < "B"), None).otherwise(F.col("holdout_mape")))
    return WN.rank_models(m, K)


# error of each customer's segment: many rows for the rankings
_SEG = """SELECT CAST(l_partkey AS VARCHAR(20)) AS segment, CAST(sum(CAST(round(l_discount * 1000) AS BIGINT)) AS DOUBLE) / count(*) / 3 AS mape, count(*) AS n FROM {lineitem} GROUP BY l_partkey"""
SEG = f"seg AS ({_SEG.replace('{lineitem}', 'lineitem')})"


def seg(spark, d):
    return spark.sql(_SEG, lineitem=table(spark, d, "lineitem"))


@query("win16_rank_segments", "segment:s mape:f6 rank:i quality:s", f"""
WITH {SEG} SELECT segment, mape, row_number() OVER (ORDER BY mape DESC, segment) AS rank, CASE WHEN mape <= 10 THEN 'good' WHEN mape <= 20 THEN 'acceptable' ELSE 'poor' END AS quality FROM seg""")
def _(spark, d):
    return WN.rank_segments(seg(spark, d))


@query("srt1_top_segments", "segment:s mape:f6 side:s", f"""
WITH {SEG} SELECT * FROM (SELECT segment, mape, 'worst' AS side FROM seg ORDER BY mape DESC, segment LIMIT 5) UNION ALL SELECT * FROM (SELECT segment, mape, 'best' AS side FROM seg ORDER BY mape, segment LIMIT 5)""")
def _(spark, d):
    df = seg(spark, d)
    return S.top_segments(df, 5).withColumn("side", F.lit("worst")).unionByName(S.top_segments(df, 5, worst=False).withColumn("side", F.lit("best")))


@query("evl9_batch_stats", "total:i successful:i failed:i min_mape:f6 max_mape:f6 mean_mape:f6 median_mape:f6", f"""
WITH {SEG}, s AS (SELECT *, CASE WHEN CAST(segment AS BIGINT) % 7 = 0 THEN 'error' ELSE 'success' END AS status FROM seg), g AS (SELECT list(mape ORDER BY mape) AS l, count(*) AS c FROM s WHERE status = 'success')
SELECT (SELECT count(*) FROM s) AS total, c AS successful, (SELECT count(*) FROM s) - c AS failed, l[1] AS min_mape, l[-1] AS max_mape, list_avg(l) AS mean_mape, l[c // 2 + 1] AS median_mape FROM g""")
def _(spark, d):
    return E.batch_stats(seg(spark, d).withColumn("status", F.when(F.col("segment").cast("bigint") % 7 == 0, "error").otherwise("success")))


@query("evl10_segment_summary", "total_segments:i mean_mape:f2 median_mape:f2 std_mape:f2 min_mape:f2 max_mape:f2 good:i acceptable:i poor:i", f"""
WITH {SEG} SELECT count(*) AS total_segments, avg(mape) AS mean_mape, median(mape) AS median_mape, stddev_pop(mape) AS std_mape, min(mape) AS min_mape, max(mape) AS max_mape,
count(*) FILTER (mape <= 10) AS good, count(*) FILTER (mape > 10 AND mape <= 20) AS acceptable, count(*) FILTER (mape > 20) AS poor FROM seg""")
def _(spark, d):
    return E.segment_summary(seg(spark, d))


# ---- intervals ---------------------------------------------------------------------------

_IV = "series:s h:i yhat:f6 yhat_lower:f5 yhat_upper:f5"


@query("int1_residual_interval", _IV, f"""
{ctes('fc', 'resid')}, s AS (SELECT series, count(res) AS n, stddev_pop(res) AS sd FROM resid GROUP BY series), p AS (SELECT series, min(yhat) > 0 AS pos FROM fc GROUP BY series)
SELECT series, h, yhat, CASE WHEN pos THEN greatest(yhat - 1.959963984540054 * sd * sqrt(1 + h / n), yhat * 0.1) ELSE yhat - 1.959963984540054 * sd * sqrt(1 + h / n) END AS yhat_lower, yhat + 1.959963984540054 * sd * sqrt(1 + h / n) AS yhat_upper FROM fc JOIN s USING (series) JOIN p USING (series)""")
def _(spark, d):
    return I.residual_interval(panel(spark, d, "fc").drop("yhat_lower", "yhat_upper"), panel(spark, d, "resid"), K)


_QS = "qs AS (SELECT series, count(*) AS n, list(abs(res) ORDER BY abs(res)) AS a, quantile_cont(res, 0.05) AS ql, quantile_cont(res, 0.95) AS qh, stddev_pop(res) AS sd FROM resid GROUP BY series)"


def _aq(q):
    return f"(a[CAST(floor(({q}) * (n - 1)) AS BIGINT) + 1] + (({q}) * (n - 1) - floor(({q}) * (n - 1))) * (a[CAST(ceil(({q}) * (n - 1)) AS BIGINT) + 1] - a[CAST(floor(({q}) * (n - 1)) AS BIGINT) + 1]))"


_LV = "1 - least(1.0, (1 - CAST(0.9 AS DOUBLE)) * (n + 1) / n)"


@query("int2_conformal", _IV, f"""
{ctes('fc', 'resid')}, {_QS} SELECT series, h, yhat, greatest(0, yhat - {_aq(_LV)}) AS yhat_lower, greatest(yhat, yhat + {_aq(_LV)}) AS yhat_upper FROM fc JOIN qs USING (series)""")
def _(spark, d):
    return I.conformal(panel(spark, d, "fc"), panel(spark, d, "resid"), K)


@query("int2_conformal_asymmetric", _IV, f"""
{ctes('fc', 'resid')}, {_QS} SELECT series, h, yhat, greatest(0, yhat + ql) AS yhat_lower, greatest(yhat, yhat + qh) AS yhat_upper FROM fc JOIN qs USING (series)""")
def _(spark, d):
    return I.conformal(panel(spark, d, "fc"), panel(spark, d, "resid"), K, method="asymmetric")


@query("int2_conformal_growing", _IV, f"""
{ctes('fc', 'resid')}, {_QS} SELECT series, h, yhat, greatest(0, yhat - {_aq(_LV)} * (1 + 0.02 * (h - 1))) AS yhat_lower, greatest(yhat, yhat + {_aq(_LV)} * (1 + 0.02 * (h - 1))) AS yhat_upper FROM fc JOIN qs USING (series)""")
def _(spark, d):
    return I.conformal(panel(spark, d, "fc"), panel(spark, d, "resid"), K, method="growing")


_L3 = "least(1.0, (1 + 1.0 / n) * CAST(0.9 AS DOUBLE))"


@query("int3_conformal_split", _IV, f"""
{ctes('fc', 'resid')}, {_QS} SELECT series, h, yhat, least(yhat, yhat - {_aq(_L3)}) AS yhat_lower, greatest(yhat, yhat + {_aq(_L3)}) AS yhat_upper FROM fc JOIN qs USING (series)""")
def _(spark, d):
    return I.conformal_split(panel(spark, d, "fc"), panel(spark, d, "resid"), K)


_PAIRS = "SELECT series, model, h, ds, y, yhat, yhat * 0.8 AS yhat_lower, yhat * 1.15 AS yhat_upper FROM {models}"
PAIRS = f"prs AS ({_PAIRS.replace('{models}', 'models')})"


def pairs(spark, d):
    return spark.sql(_PAIRS, models=panel(spark, d, "models"))


@query("int4_coverage", "series:s model:s n_samples:i n_within:i actual_coverage:f6 coverage_gap:f6 mean_width:f5 mean_width_pct:f5 is_calibrated:b", f"""
{ctes('models')}, {PAIRS}, a AS (SELECT series, model, count(*) AS n_samples, count(*) FILTER (y BETWEEN yhat_lower AND yhat_upper) AS n_within, avg(yhat_upper - yhat_lower) AS mean_width, avg((yhat_upper - yhat_lower) / greatest(y, 0.01)) * 100 AS mean_width_pct FROM prs GROUP BY ALL)
SELECT *, n_within / n_samples AS actual_coverage, n_within / n_samples - 0.9 AS coverage_gap, abs(n_within / n_samples - 0.9) < 0.05 AS is_calibrated FROM a""")
def _(spark, d):
    return I.coverage(pairs(spark, d), KM)


CALIB = """cal(series, model, i, scale, done) AS (SELECT DISTINCT series, model, 0, CAST(1 AS DOUBLE), false FROM prs
 UNION ALL SELECT c.series, c.model, c.i + 1, CASE WHEN c.done OR abs(s.sh - 0.9) < 0.01 THEN c.scale WHEN s.sh < 0.9 THEN c.scale * 1.1 ELSE c.scale * 0.95 END, c.done OR abs(s.sh - 0.9) < 0.01
 FROM cal c, LATERAL (SELECT count(*) FILTER (CASE WHEN c.i = 0 THEN y BETWEEN yhat_lower AND yhat_upper ELSE abs(y - yhat) <= (yhat_upper - yhat_lower) / 2 * c.scale END) / count(*) AS sh FROM prs WHERE prs.series = c.series AND prs.model = c.model) s WHERE c.i < 10)"""


@query("int5_calibrate", "series:s model:s scale:f6", f"""
{ctes('models').replace('WITH ', 'WITH RECURSIVE ')}, {PAIRS}, {CALIB} SELECT series, model, scale FROM cal WHERE i = 10""")
def _(spark, d):
    return I.calibrate(pairs(spark, d), [*K, "model"])


@query("int6_conformal_fitted", _IV + " model:s", f"""
{ctes('models', 'fc').replace('WITH ', 'WITH RECURSIVE ')}, {PAIRS}, {CALIB}, qs AS (SELECT series, model, count(*) AS n, list(abs(y - yhat) ORDER BY abs(y - yhat)) AS a FROM prs GROUP BY series, model), sc AS (SELECT series, model, scale FROM cal WHERE i = 10)
SELECT series, model, h, yhat, greatest(0, yhat - {_aq(_LV)} * scale) AS yhat_lower, greatest(yhat, yhat + {_aq(_LV)} * scale) AS yhat_upper FROM fc JOIN qs USING (series) JOIN sc USING (series, model)""")
def _(spark, d):
    past = pairs(spark, d)
    ahead = panel(spark, d, "fc").join(past.select(*K, "model").distinct(), K)
    return I.ConformalIntervals([*K, "model"]).fit(past).transform(ahead)


@query("int7_bootstrap_interval", "series:s h:i yhat:f6 lower_50:f4 upper_50:f4 lower_95:f4 upper_95:f4", f"""
{ctes('fc', 'resid')}, pl AS (SELECT series, list(res ORDER BY res) AS r FROM resid WHERE res IS NOT NULL GROUP BY series),
ix AS (SELECT series, h, yhat, r, CAST('0x' || substr(md5('42|' || series || '|' || h || '|' || i), 1, 8) AS BIGINT) % len(r) + 1 AS j FROM fc JOIN pl USING (series), (SELECT unnest(generate_series(1, 1000)) AS i)),
dr AS (SELECT series, h, yhat, r[j] AS e FROM ix)
SELECT series, h, yhat, yhat + quantile_cont(e, 0.25) AS lower_50, yhat + quantile_cont(e, 0.75) AS upper_50, yhat + quantile_cont(e, 0.025) AS lower_95, yhat + quantile_cont(e, 0.975) AS upper_95 FROM dr GROUP BY series, h, yhat""")
def _(spark, d):
    return I.bootstrap_interval(panel(spark, d, "fc"), panel(spark, d, "resid"), K)
