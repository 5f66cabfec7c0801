"""Ensembles and forecast checks."""

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import checks as CK
from ..operators import ensemble as EN
from .evaluation import TRI, tri
from .forecast import metrics_sql
from .panels import ctes, panel
from .registry import query

K = ["series"]
KM = ["series", "model"]
NOTNULL = "lambda x: x IS NOT NULL"

# forecasts of the simple models with bounds, some of them broken by rule; history before them
_BAD = """SELECT series, model, h, ds, y, yhat * f AS yhat, yhat * f * 0.8 AS yhat_lower, yhat * f * 1.2 AS yhat_upper FROM (SELECT *, CASE WHEN series = 'ASIA' AND model = 'last' THEN 7 WHEN series = 'EUROPE' AND model = 'month' THEN -1
 WHEN series = 'AFRICA' AND model = 'year' THEN 0 WHEN series = 'AMERICA' AND model = 'mean7' AND h > 20 THEN 4 WHEN series = 'AMERICA' AND model = 'last' THEN 1.9 ELSE 1 END AS f FROM {models}) AS q"""
_PAST = "SELECT series, ds, y FROM {lagged} WHERE back > 24"


def bad(spark, d):
    return spark.sql(_BAD, models=panel(spark, d, "models"))


def past(spark, d):
    return spark.sql(_PAST, lagged=panel(spark, d, "lagged"))


BAD = f"bad AS ({_BAD.replace('{models}', 'models')}), past AS ({_PAST.replace('{lagged}', 'lagged')})"
HSTAT = """hs0 AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS b, y - lag(y) OVER (PARTITION BY series ORDER BY ds) AS dd FROM past),
hs AS (SELECT series, avg(y) AS hist_mean, stddev_pop(y) AS hist_std, min(y) AS hist_min, max(y) AS hist_max, max(ds) AS hist_end, max(y) FILTER (b = 1) AS last_y, stddev_pop(dd) AS hist_vol, (max(y) FILTER (b = 1) - max(y) FILTER (b = 6)) / 6 AS rt FROM hs0 GROUP BY series)"""


def valid_sql(ratio):
    return f"""vs AS (SELECT series, model, count(*) AS n, avg(yhat) AS pm, stddev_pop(yhat) AS ps, bool_and(yhat = 0) AS z, count(*) FILTER (yhat < 0) AS neg FROM bad GROUP BY ALL),
va AS (SELECT series, model, pm / hist_mean AS mean_ratio, ps AS pred_std, list_filter([CASE WHEN pm / hist_mean > {ratio} THEN 'too_high' END, CASE WHEN pm / hist_mean < 1.0 / {ratio} THEN 'too_low' END, CASE WHEN ps < 1e-6 THEN 'flat' END, CASE WHEN z THEN 'all_zero' END,
 CASE WHEN neg > n * 0.5 THEN 'mostly_negative' END], {NOTNULL}) AS issues, list_filter([CASE WHEN pm / hist_mean BETWEEN 1.0 / {ratio} AND {ratio} AND (pm / hist_mean > 3 OR pm / hist_mean < 0.33) THEN 'unusual_level' END, CASE WHEN ps >= 1e-6 AND ps < hist_std * 0.01 THEN 'low_variance' END,
 CASE WHEN neg > 0 AND neg <= n * 0.5 THEN 'some_negative' END], {NOTNULL}) AS warnings FROM vs JOIN hs USING (series))"""


@query("chk1_validate_forecast", "series:s model:s is_valid:b mean_ratio:f6 pred_std:f4 issues:a warnings:a", f"""
{ctes('models')}, {BAD}, {HSTAT}, {valid_sql(10.0)} SELECT *, len(issues) = 0 AS is_valid FROM va""")
def _(spark, d):
    return CK.validate_forecast(bad(spark, d), past(spark, d), KM, K)


@query("chk2_validate_intervals", "series:s model:s is_valid:b issues:a", f"""
{ctes('models')}, {BAD}, b2 AS (SELECT series, model, yhat, yhat_lower AS lo, CASE WHEN h = 5 AND model = 'month' THEN yhat * 20 ELSE yhat_upper END AS hi FROM bad), s AS (SELECT series, model, count(*) FILTER (lo > yhat) AS a, count(*) FILTER (hi < yhat) AS b, count(*) FILTER (lo > hi) AS c,
 count(*) FILTER ((hi - lo) / abs(yhat + 1e-10) > 10) AS w FROM b2 GROUP BY ALL), i AS (SELECT series, model, list_filter([CASE WHEN a > 0 THEN 'low_above' END, CASE WHEN b > 0 THEN 'high_below' END, CASE WHEN c > 0 THEN 'crossed' END, CASE WHEN w > 0 THEN 'wide' END], {NOTNULL}) AS issues FROM s)
SELECT *, len(issues) = 0 AS is_valid FROM i""")
def _(spark, d):
    df = bad(spark, d).withColumn("yhat_upper", F.when((F.col("h") == 5) & (F.col("model") == "month"), F.col("yhat") * 20).otherwise(F.col("yhat_upper")))
    return CK.validate_intervals(df, KM)


@query("chk3_validate_output", "series:s model:s horizon:i min_yhat:f5 max_yhat:f5 mean_yhat:f5 is_valid:b issues:a warnings:a", f"""
{ctes('models')}, {BAD}, b2 AS (SELECT * FROM bad WHERE NOT (model = 'year' AND h = 24)), s AS (SELECT series, model, count(*) AS horizon, min(ds) AS st, count(*) FILTER (yhat < 0) AS neg, count(*) FILTER (yhat_lower > yhat) AS a, count(*) FILTER (yhat_upper < yhat) AS b, avg(yhat_upper - yhat_lower) AS w,
 min(yhat) AS min_yhat, max(yhat) AS max_yhat, avg(yhat) AS mean_yhat FROM b2 GROUP BY ALL), e AS (SELECT series, CASE WHEN series = 'EUROPE' THEN max(ds) + 20 ELSE max(ds) END AS he FROM past GROUP BY series)
SELECT series, model, horizon, min_yhat, max_yhat, mean_yhat, st > he AS is_valid, list_filter([CASE WHEN st <= he THEN 'starts_in_history' END], {NOTNULL}) AS issues,
list_filter([CASE WHEN horizon <> 24 THEN 'wrong_length' END, CASE WHEN neg > 0 THEN 'negative' END, CASE WHEN a > 0 THEN 'low_above' END, CASE WHEN b > 0 THEN 'high_below' END, CASE WHEN w <= 0 THEN 'no_width' END], {NOTNULL}) AS warnings FROM s JOIN e USING (series)""")
def _(spark, d):
    hist = past(spark, d).withColumn("ds", F.when(F.col("series") == "EUROPE", F.date_add("ds", 20)).otherwise(F.col("ds")))
    return CK.validate_output(bad(spark, d).where("NOT (model = 'year' AND h = 24)"), hist, KM, K, 24)


_ENDS = "en AS (SELECT series, model, count(*) AS n, avg(yhat) AS fm, stddev_pop(yhat) AS fs, var_pop(yhat) AS fv, min(yhat) AS lo, max(yhat) AS hi, arg_min(yhat, h) AS f1, arg_max(yhat, h) AS fl, count(DISTINCT round(yhat, 4)) AS u FROM bad GROUP BY ALL)"


@query("chk4_reasonableness", "series:s model:s change_ratio:f6 boundary_jump:f6 std_ratio:f6 is_reasonable:b concerns:a", f"""
{ctes('models')}, {BAD}, {HSTAT}, {_ENDS}, r AS (SELECT series, model, fm / hist_mean AS change_ratio, abs(f1 - last_y) / abs(last_y) AS boundary_jump, fs / hist_std AS std_ratio FROM en JOIN hs USING (series))
SELECT *, NOT (change_ratio > 5 OR change_ratio < 0.2) AS is_reasonable, list_filter([CASE WHEN change_ratio > 5 OR change_ratio < 0.2 THEN 'mean_level' END, CASE WHEN boundary_jump > 0.5 THEN 'boundary_jump' END, CASE WHEN std_ratio > 3 OR std_ratio < 0.1 THEN 'variability' END], {NOTNULL}) AS concerns FROM r""")
def _(spark, d):
    return CK.reasonableness(bad(spark, d), past(spark, d), KM, K)


@query("chk5_flat_forecast", "series:s model:s forecast_variance:f3 variance_ratio:f6 unique_values:i flat_reason:s is_flat:b", f"""
{ctes('models')}, {BAD}, {HSTAT}, {_ENDS}, r AS (SELECT series, model, fv AS forecast_variance, fv / (hist_std * hist_std) AS variance_ratio, u AS unique_values, CASE WHEN fv < 1e-6 THEN 'zero_variance' WHEN fv / (hist_std * hist_std) < 0.01 THEN 'low_variance_ratio' WHEN u = 1 THEN 'identical' WHEN u <= 2 THEN 'few_values' END AS flat_reason FROM en JOIN hs USING (series))
SELECT *, flat_reason IS NOT NULL AS is_flat FROM r""")
def _(spark, d):
    return CK.flat_forecast(bad(spark, d), past(spark, d), KM, K)


@query("chk6_forecast_anomalies", "series:s model:s type:s severity:s n_periods:i", f"""
{ctes('models')}, {BAD}, {HSTAT}, {_ENDS}, dv AS (SELECT series, model, stddev_pop(dd) AS fvol FROM (SELECT series, model, yhat - lag(yhat) OVER (PARTITION BY series, model ORDER BY h) AS dd FROM bad) GROUP BY ALL),
mk AS (SELECT b.series, b.model, count(*) FILTER (yhat > hist_max + 2 * hist_std) AS nh, count(*) FILTER (yhat < hist_min - 2 * hist_std) AS nl, count(*) FILTER (yhat < 0) AS nn FROM bad b JOIN hs USING (series) GROUP BY ALL),
j AS (SELECT en.*, hs.* EXCLUDE (series), fvol, nh, nl, nn, abs(f1 - last_y) / abs(last_y) * 100 AS jump, (fl - f1) / n AS ft FROM en JOIN hs USING (series) JOIN dv USING (series, model) JOIN mk USING (series, model))
SELECT series, model, 'out_of_range_high' AS type, 'warning' AS severity, nh AS n_periods FROM j WHERE nh > 0 UNION ALL SELECT series, model, 'negative_values', 'critical', nn FROM j WHERE nl > 0 AND nn > 0 UNION ALL SELECT series, model, 'out_of_range_low', 'warning', nl FROM j WHERE nl > 0 AND nn = 0
UNION ALL SELECT series, model, 'sudden_jump', CASE WHEN jump < 50 THEN 'warning' ELSE 'critical' END, 1 FROM j WHERE jump > 30 UNION ALL SELECT series, model, 'high_volatility', 'info', n FROM j WHERE fvol > hist_vol * 2
UNION ALL SELECT series, model, 'trend_reversal', 'info', n FROM j WHERE ((rt > 0 AND ft < -abs(rt) * 0.5) OR (rt < 0 AND ft > abs(rt) * 0.5)) AND abs(rt) > hist_std * 0.1 UNION ALL SELECT series, model, 'flat_forecast', 'info', n FROM j WHERE hi - lo < hist_std * 0.1""")
def _(spark, d):
    return CK.forecast_anomalies(bad(spark, d), past(spark, d), KM, K)


@query("chk7_clip_forecast", "series:s model:s h:i yhat:f6 yhat_lower:f5 yhat_upper:f5", f"""
{ctes('models')}, {BAD} SELECT series, model, h, greatest(yhat, 0) AS yhat, greatest(yhat_lower, 0) AS yhat_lower, greatest(yhat_upper, greatest(yhat, 0)) AS yhat_upper FROM bad""")
def _(spark, d):
    return CK.clip_forecast(bad(spark, d))


@query("chk7_sanitize_forecast", "series:s model:s ds:d yhat:f6", f"""
{ctes('models')}, m AS (SELECT series, model, ds, CASE WHEN day(ds) % 4 = 0 THEN NULL ELSE yhat END AS yhat FROM models)
SELECT series, model, ds, coalesce(last_value(yhat IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(yhat IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS yhat FROM m WINDOW w AS (PARTITION BY series, model ORDER BY ds)""")
def _(spark, d):
    day = F.dayofmonth("ds")
    df = panel(spark, d, "models").withColumn("yhat", F.when(day % 8 == 0, float("nan")).when(day % 4 == 0, float("inf")).otherwise(F.col("yhat")))
    return CK.sanitize_forecast(df.select(*KM, "ds", "yhat"), KM)


SEVM = "CASE WHEN mape / train_mape >= 20 THEN 'severe' WHEN mape / train_mape >= 10 THEN 'high' WHEN mape / train_mape >= 5 THEN 'medium' WHEN mape / train_mape >= 2 THEN 'low' ELSE 'none' END"


@query("chk8_acceptance", "series:s model:s accepted:b predictions_valid:b mape_reasonable:b no_severe_overfitting:b has_run_id:b reasons:a", f"""
{ctes('models')}, {BAD}, {HSTAT}, {valid_sql(10.0)}, {TRI}, t2 AS (SELECT series, model, eval_mape AS mape, train_mape FROM tri), j AS (SELECT t2.*, len(issues) = 0 AS a, mape < 30 AS b, {SEVM} <> 'severe' AS c, model <> 'month' AS d FROM t2 JOIN va USING (series, model))
SELECT series, model, a AND b AND c AND d AS accepted, a AS predictions_valid, b AS mape_reasonable, c AS no_severe_overfitting, d AS has_run_id, list_filter([CASE WHEN NOT a THEN 'predictions_valid' END, CASE WHEN NOT b THEN 'mape_reasonable' END, CASE WHEN NOT c THEN 'no_severe_overfitting' END, CASE WHEN NOT d THEN 'has_run_id' END], {NOTNULL}) AS reasons FROM j""")
def _(spark, d):
    from ..operators.evaluate import overfit

    m = overfit(tri(spark, d)).select(*KM, F.col("eval_mape").alias("mape"), "severity", F.when(F.col("model") != "month", F.concat_ws("-", *KM)).alias("run_id"))
    return CK.acceptance(m.join(CK.validate_forecast(bad(spark, d), past(spark, d), KM, K), KM), max_mape=30.0)


# ---- ensembles ---------------------------------------------------------------------------

_EM = "em AS (SELECT series, model, eval_mape AS mape, train_mape FROM tri)"


@query("ens1_select_members", "series:s model:s included:b reason:s", f"""
{ctes('models')}, {BAD}, {HSTAT}, {valid_sql(6.0)}, {TRI}, {_EM}, fm AS (SELECT series, model, avg(yhat) AS fmean, bool_and(yhat = 0) AS z FROM bad GROUP BY ALL),
a AS (SELECT em.*, fmean, CASE WHEN len(issues) > 0 OR z THEN 'invalid_forecast' WHEN {SEVM} = 'severe' THEN 'severe_overfit' END AS r FROM em JOIN va USING (series, model) JOIN fm USING (series, model)),
b AS (SELECT *, coalesce(r, CASE WHEN mape > 3 * min(mape) FILTER (r IS NULL) OVER (PARTITION BY series) THEN 'far_from_best' END) AS r2 FROM a),
c AS (SELECT *, count(*) FILTER (r2 IS NULL) OVER (PARTITION BY series) AS k FROM b), md AS (SELECT series, median(fmean) FILTER (r2 IS NULL) AS med FROM b GROUP BY series),
d AS (SELECT c.*, r2 IS NULL AND k >= 3 AND NOT (fmean / med BETWEEN 0.5 AND 1.5) AS off FROM c JOIN md USING (series)), e AS (SELECT *, coalesce(r2, CASE WHEN off AND k - count(*) FILTER (off) OVER (PARTITION BY series) >= 2 THEN 'diverges' END) AS reason FROM d)
SELECT series, model, reason IS NULL AS included, reason FROM e""")
def _(spark, d):
    m = tri(spark, d).withColumnRenamed("eval_mape", "mape")
    return EN.select_members(bad(spark, d), m, past(spark, d), K)


@query("ens1_select_top", "series:s model:s included:b reason:s", f"""
{ctes('models')}, {BAD}, {HSTAT}, {valid_sql(10.0)}, {TRI}, {_EM}, a AS (SELECT em.*, CASE WHEN len(issues) > 0 THEN 'invalid_forecast' END AS r FROM em JOIN va USING (series, model)),
b AS (SELECT *, coalesce(r, CASE WHEN mape > 3 * min(mape) FILTER (r IS NULL) OVER (PARTITION BY series) THEN 'far_from_best' END) AS r2 FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY r2 IS NOT NULL, mape, model) AS p FROM b)
SELECT series, model, r2 IS NULL AND p <= 2 AS included, coalesce(r2, CASE WHEN p > 2 THEN 'beyond_limit' END) AS reason FROM c""")
def _(spark, d):
    return EN.select_members(bad(spark, d), tri(spark, d).withColumnRenamed("eval_mape", "mape"), past(spark, d), K, form="top", max_models=2)


def cap_sql(raw):
    """CTE ``wt`` by repeated capping, ten rounds."""
    steps = [f"w0 AS (SELECT series, model, w / sum(w) OVER (PARTITION BY series) AS w FROM (SELECT series, model, greatest({raw}, 0.05) AS w FROM em))"]
    for i in range(1, 11):
        steps.append(f"w{i} AS (SELECT series, model, CASE WHEN max(w) OVER (PARTITION BY series) > 0.4 AND count(*) OVER (PARTITION BY series) > 1 THEN least(w, 0.4) / sum(least(w, 0.4)) OVER (PARTITION BY series) ELSE w END AS w FROM w{i - 1})")
    return ", ".join(steps) + ", wt AS (SELECT series, model, w AS weight FROM w10)"


@query("ens2_ensemble_weights", "series:s model:s weight:f6", f"""
{ctes('models')}, {TRI}, {_EM}, {cap_sql('1 / (mape + 1e-10) ** 2 * 0 + exp(-mape / avg(mape) OVER (PARTITION BY series))')} SELECT * FROM wt""")
def _(spark, d):
    return EN.ensemble_weights(tri(spark, d).withColumnRenamed("eval_mape", "mape"), K, "softmax")


@query("ens2_weights_by_method", "series:s model:s method:s weight:f6", f"""
{ctes('models')}, {TRI}, {_EM}, x AS (WITH {cap_sql('1 / (mape + 1e-10)')} SELECT *, 'inverse_mape' AS method FROM wt), z AS (WITH {cap_sql('CAST(count(*) OVER (PARTITION BY series) - row_number() OVER (PARTITION BY series ORDER BY mape, model) + 1 AS DOUBLE)')} SELECT *, 'rank' AS method FROM wt),
e AS (SELECT series, model, 1.0 / count(*) OVER (PARTITION BY series) AS weight, 'equal' AS method FROM em), s0 AS (SELECT series, model, greatest(0.05, (1 / greatest(mape, 0.001)) / sum(1 / greatest(mape, 0.001)) OVER (PARTITION BY series)) AS i FROM em), s AS (SELECT series, model, i / sum(i) OVER (PARTITION BY series) AS weight, 'simple' AS method FROM s0)
SELECT * FROM x UNION ALL SELECT * FROM z UNION ALL SELECT * FROM e UNION ALL SELECT * FROM s""")
def _(spark, d):
    m = tri(spark, d).withColumnRenamed("eval_mape", "mape")
    out = EN.simple_weights(m, K).withColumn("method", F.lit("simple"))
    for k in ("inverse_mape", "rank", "equal"):
        out = out.unionByName(EN.ensemble_weights(m, K, k).withColumn("method", F.lit(k)))
    return out


_BLEND = """bl AS (SELECT series, h, ds, greatest(0, sum(weight * yhat)) AS yhat, greatest(0, sum(weight * yhat_lower)) AS yhat_lower, greatest(greatest(0, sum(weight * yhat)), sum(weight * yhat_upper)) AS yhat_upper, max(y) AS y, count(*) AS n_members FROM bad JOIN wt USING (series, model) GROUP BY ALL)"""


@query("ens3_ensemble", "series:s h:i ds:d yhat:f4 yhat_lower:f4 yhat_upper:f4 n_members:i", f"""
{ctes('models')}, {BAD}, {TRI}, {_EM}, {cap_sql('1 / (mape + 1e-10)')}, {_BLEND} SELECT * FROM bl""")
def _(spark, d):
    return EN.ensemble(bad(spark, d), EN.ensemble_weights(tri(spark, d).withColumnRenamed("eval_mape", "mape"), K), K)


@query("ens3_ensemble_metrics", "series:s n:i rmse:f1 mape:f1 r2:f3", f"""
{ctes('models')}, {BAD}, {TRI}, {_EM}, {cap_sql('1 / (mape + 1e-10)')}, {_BLEND} {metrics_sql('bl', 'series')}""")
def _(spark, d):
    return EN.ensemble_metrics(bad(spark, d), EN.ensemble_weights(tri(spark, d).withColumnRenamed("eval_mape", "mape"), K), K)


@query("agg12_total_forecast", "h:i ds:d yhat:f5 yhat_lower:f5 yhat_upper:f5 holdout_mape:f6 n_series:i", f"""
{ctes('fc')}, s AS (SELECT series, CASE series WHEN 'ASIA' THEN NULL ELSE CAST(len(series) AS DOUBLE) END AS m FROM (SELECT DISTINCT series FROM fc))
SELECT h, min(ds) AS ds, sum(yhat) AS yhat, sum(yhat_lower) AS yhat_lower, sum(yhat_upper) AS yhat_upper, (SELECT avg(coalesce(m, 100)) FROM s) AS holdout_mape, (SELECT count(*) FROM s) AS n_series FROM fc GROUP BY h""")
def _(spark, d):
    fc = panel(spark, d, "fc").withColumn("holdout_mape", F.when(F.col("series") == "ASIA", None).otherwise(F.length("series").cast("double")))
    return A.total_forecast(fc, K)
