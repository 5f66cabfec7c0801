"""Audit against actuals and explanation."""

from pyspark.sql import functions as F

from ..operators import audit as AU
from ..operators import explain as EX
from ..operators import windows as WN
from ..operators.base import join_on_keys
from ..plans.profile import profile
from .calendar import HOL
from .evaluation import TRI, tri
from .panels import ctes, panel, table
from .quality import PROFILE_CTES, rows_of_profile
from .registry import query

K = ["series"]
D = ["region", "segment"]
NOTNULL = "lambda x: x IS NOT NULL"

# actuals in two rows per date; some dates zero
_ACT = """SELECT series, ds, CASE WHEN day(ds) % 9 = 0 THEN 0 ELSE y * part END AS y FROM {act} CROSS JOIN (SELECT 0.25 AS part UNION ALL SELECT 0.75) AS p"""
_CTX = """SELECT series, ds, CASE WHEN day(ds) % 2 = 0 THEN 1 ELSE 0 END AS promo, CASE WHEN day(ds) % 3 = 0 THEN 'Yes' ELSE 'no' END AS event, y FROM {act}"""
ACT2 = f"act2 AS ({_ACT.replace('{act}', 'act')}), ctx AS ({_CTX.replace('{act}', 'act')})"


BEST = "best AS (SELECT series, min(holdout_mape) AS mape FROM tri GROUP BY series)"


def ranked_best(spark, d):
    """The error of the best ranked model of each series."""
    return WN.rank_models(tri(spark, d).withColumnRenamed("holdout_mape", "mape"), K).where("is_best").groupBy(*K).agg(F.max("mape").alias("mape"))


def act2(spark, d):
    return spark.sql(_ACT, act=panel(spark, d, "act")).withColumn("y", F.col("y").cast("double"))


def ctx(spark, d):
    return spark.sql(_CTX, act=panel(spark, d, "act"))


_BAND = "CASE WHEN {m} <= 5 THEN 'excellent' WHEN {m} <= 10 THEN 'good' WHEN {m} <= 15 THEN 'acceptable' WHEN {m} <= 25 THEN 'review' ELSE 'significant_deviation' END"
CMP = f"""att AS (SELECT series, ds, sum(CAST(y AS DOUBLE)) AS actual FROM act2 GROUP BY ALL),
cm0 AS (SELECT fc.series, fc.ds, yhat AS predicted, actual, actual - yhat AS error, abs(actual - yhat) AS abs_error, CASE WHEN actual <> 0 THEN (actual - yhat) / actual * 100 WHEN yhat <> 0 THEN 100 ELSE 0 END AS pct_error FROM fc JOIN att USING (series, ds)),
cm AS (SELECT *, abs(pct_error) AS mape, {_BAND.format(m='abs(pct_error)')} AS status, isodow(ds) > 5 AS is_weekend, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(ds)] AS weekday FROM cm0)"""


@query("aud1_audit_periods", "series:s ds:d predicted:f6 actual:f6 error:f6 pct_error:f6 mape:f6 status:s is_weekend:b weekday:s flags:a", f"""
{ctes('fc', 'act')}, {ACT2}, {CMP} SELECT cm.*, list_filter([CASE WHEN promo = 1 THEN 'promo' END, CASE WHEN event = 'Yes' THEN 'event' END], {NOTNULL}) AS flags FROM cm LEFT JOIN ctx USING (series, ds)""")
def _(spark, d):
    return AU.audit_periods(panel(spark, d, "fc"), act2(spark, d), K, ctx(spark, d), ["promo", "event"])


@query("jon15_compare_periods", "series:s ds:d error:f6 flags:a", f"""
{ctes('fc', 'act')}, {ACT2}, {CMP} SELECT cm.series, ds, error, list_filter([CASE WHEN promo = 1 THEN 'promo' END], {NOTNULL}) AS flags FROM cm LEFT JOIN ctx USING (series, ds)""")
def _(spark, d):
    return AU.audit_periods(panel(spark, d, "fc"), act2(spark, d), K, ctx(spark, d), ["promo"])


_SUM = """sm AS (SELECT series, count(*) AS n_periods, CASE WHEN sum(abs(actual)) > 0 THEN sum(abs_error) / sum(abs(actual)) * 100 ELSE 0 END AS overall_mape, sqrt(avg(error * error)) AS overall_rmse, avg(error) AS overall_bias, count(*) FILTER (status = 'excellent') AS n_excellent,
 count(*) FILTER (status = 'good') AS n_good, count(*) FILTER (status = 'acceptable') AS n_acceptable, count(*) FILTER (status = 'review') AS n_review, count(*) FILTER (status = 'significant_deviation') AS n_significant_deviation FROM cm GROUP BY series)"""


@query("aud2_audit_summary", "series:s n_periods:i overall_mape:f6 overall_rmse:f5 overall_bias:f5 n_excellent:i n_good:i n_acceptable:i n_review:i n_significant_deviation:i", f"""
{ctes('fc', 'act')}, {ACT2}, {CMP}, {_SUM} SELECT * FROM sm""")
def _(spark, d):
    return AU.audit_summary(AU.audit_periods(panel(spark, d, "fc"), act2(spark, d), K), K)


@query("aud3_audit_cli", "n_periods:i mape:f6 rmse:f5 bias:f5", f"""
{ctes('fc', 'act')} SELECT count(*) AS n_periods, avg(abs((y - yhat) / y) * 100) AS mape, sqrt(avg((y - yhat) ** 2)) AS rmse, avg(y - yhat) AS bias FROM fc JOIN act USING (series, ds)""")
def _(spark, d):
    return AU.audit_cli(panel(spark, d, "fc"), panel(spark, d, "act"), K)[0]


@query("srt2_worst_periods", "series:s ds:d error:f6 mape:f6", f"""
{ctes('fc', 'act')} SELECT series, ds, y - yhat AS error, abs((y - yhat) / y) * 100 AS mape FROM fc JOIN act USING (series, ds) ORDER BY mape DESC, series, ds LIMIT 5""")
def _(spark, d):
    return AU.audit_cli(panel(spark, d, "fc"), panel(spark, d, "act"), K)[1]


# segments: forecast of the last eight weeks by the value four weeks before; some without overlap
_SF = "SELECT region, segment, ds, CASE WHEN region = 'ASIA' AND segment = 'BUILDING' THEN CAST(ds + INTERVAL 700 DAY AS DATE) ELSE ds END AS fds, y, lag(y, 4) OVER (PARTITION BY region, segment ORDER BY ds) AS yhat, row_number() OVER (PARTITION BY region, segment ORDER BY ds DESC) AS back FROM {slices}"
_SFC = "SELECT region, segment, fds AS ds, yhat FROM {sf} WHERE back <= 8"
_SACT = "SELECT region, segment, ds, CASE WHEN back = 3 THEN 0 ELSE y / 2 END AS y FROM {sf} CROSS JOIN (SELECT 1 AS a UNION ALL SELECT 2) AS two WHERE back <= 8 AND NOT (region = 'AFRICA' AND segment = 'FURNITURE')"
_STR = "SELECT region, segment, 20.0 + length(region) AS mape, 500.0 AS rmse FROM {sf} GROUP BY region, segment"
SEGS = f"sf AS ({_SF.replace('{slices}', 'slices')}), sfc AS ({_SFC.replace('{sf}', 'sf')}), sact AS ({_SACT.replace('{sf}', 'sf')}), strn AS ({_STR.replace('{sf}', 'sf')})"


def segs(spark, d):
    sf = spark.sql(_SF, slices=panel(spark, d, "slices"))
    tr = spark.sql(_STR, sf=sf).withColumns({"mape": F.col("mape").cast("double"), "rmse": F.col("rmse").cast("double")})
    return spark.sql(_SFC, sf=sf), spark.sql(_SACT, sf=sf), tr


SCORE = f"""sa AS (SELECT region, segment, ds, sum(y) AS actual FROM sact GROUP BY ALL), sj AS (SELECT sa.*, yhat FROM sa LEFT JOIN sfc USING (region, segment, ds)),
sg AS (SELECT region, segment, count(*) FILTER (yhat IS NOT NULL AND actual <> 0) AS periods, avg(abs((actual - yhat) / actual) * 100) FILTER (yhat IS NOT NULL AND actual <> 0) AS m, avg(actual - yhat) FILTER (yhat IS NOT NULL AND actual <> 0) AS b, sqrt(avg((actual - yhat) ** 2) FILTER (yhat IS NOT NULL AND actual <> 0)) AS r FROM sj GROUP BY ALL),
sc AS (SELECT region, segment, CAST(mape AS DOUBLE) AS train_mape, coalesce(m, CAST(mape AS DOUBLE)) AS actual_mape, coalesce(r, CAST(rmse AS DOUBLE)) AS actual_rmse, coalesce(b, 0) AS actual_bias, periods FROM sg JOIN strn USING (region, segment)),
score AS (SELECT *, {_BAND.format(m='actual_mape')} AS status FROM sc)"""


@query("jon16_match_segments", "region:s segment:s ds:d actual:f6 yhat:f6", f"""
{ctes('slices')}, {SEGS}, {SCORE} SELECT * FROM sj""")
def _(spark, d):
    fc, act, _tr = segs(spark, d)
    return AU.match_segments(fc, act, D)


@query("aud4_scorecard", "region:s segment:s train_mape:f4 actual_mape:f6 actual_rmse:f5 actual_bias:f5 periods:i status:s", f"""
{ctes('slices')}, {SEGS}, {SCORE} SELECT * FROM score""")
def _(spark, d):
    return AU.scorecard(*segs(spark, d), D)


@query("aud4_scorecard_total", "total_segments:i overall_mape:f6 n_excellent:i n_good:i n_acceptable:i n_review:i n_significant_deviation:i", f"""
{ctes('slices')}, {SEGS}, {SCORE} SELECT count(*) AS total_segments, sum(actual_mape * periods) / sum(periods) AS overall_mape, count(*) FILTER (status = 'excellent') AS n_excellent, count(*) FILTER (status = 'good') AS n_good, count(*) FILTER (status = 'acceptable') AS n_acceptable,
count(*) FILTER (status = 'review') AS n_review, count(*) FILTER (status = 'significant_deviation') AS n_significant_deviation FROM score""")
def _(spark, d):
    return AU.scorecard_total(AU.scorecard(*segs(spark, d), D))


@query("aud5_diagnose", "n:i overall_mape:f6 avg_bias:f5 bias_std:f5 bias_ratio:f6 mape_std:f6 avg_drift:f6 n_high:i n_no_match:i n_matched:i findings:a", f"""
{ctes('slices')}, {SEGS}, {SCORE}, o AS (SELECT sum(actual_mape * periods) / sum(periods) AS ov FROM score), s AS (SELECT count(*) AS n, any_value(ov) AS overall_mape, avg(actual_bias) AS avg_bias, stddev_pop(actual_bias) AS bias_std, count(*) FILTER (actual_bias > 0) AS pos, count(*) FILTER (actual_bias < 0) AS neg,
sqrt(avg((actual_mape - ov) ** 2)) AS mape_std, avg(actual_mape - train_mape) AS avg_drift, count(*) FILTER (actual_mape > 20) AS n_high, count(*) FILTER (actual_mape > 30) AS o30, count(*) FILTER (actual_mape > 15 AND actual_mape <= 30) AS mid, count(*) FILTER (abs(actual_mape - train_mape) > 10) AS dr,
count(*) FILTER (periods = 0) AS n_no_match, count(*) FILTER (periods > 0) AS n_matched, count(*) FILTER (status IN ('review', 'significant_deviation')) AS pr, count(*) FILTER (periods > 0 AND actual_rmse > 0 AND abs(actual_bias) > actual_rmse * 0.7) AS bd FROM score, o),
q AS (SELECT *, CASE WHEN pos + neg > 0 THEN pos / (pos + neg) ELSE 0.5 END AS bias_ratio FROM s), f AS (SELECT *, list_filter([CASE WHEN (pr > 0 OR n_no_match > 0) AND pr > n * 0.3 THEN 'error:summary' END, CASE WHEN (pr > 0 OR n_no_match > 0) AND pr <= n * 0.3 THEN 'warning:summary' END, CASE WHEN n_no_match > 0 THEN 'error:no_overlap' END,
CASE WHEN bias_ratio > 0.65 AND pos + neg >= 3 THEN 'warning:under_forecasting' END, CASE WHEN bias_ratio < 0.35 AND pos + neg >= 3 THEN 'warning:over_forecasting' END, CASE WHEN mape_std > 12 AND n >= 3 THEN 'warning:inconsistent' END, CASE WHEN o30 > 0 THEN 'error:major_deviations' END,
CASE WHEN o30 = 0 AND mid > n * 0.3 THEN 'warning:moderate_deviations' END, CASE WHEN avg_drift > 8 AND dr > 0 THEN 'warning:worse_than_training' END, CASE WHEN avg_drift < -8 THEN 'info:better_than_training' END, CASE WHEN bd > n_matched * 0.3 AND bd >= 2 THEN 'info:systematic_errors' END], {NOTNULL}) AS l FROM q)
SELECT *, CASE WHEN len(l) = 0 THEN ['info:strong'] ELSE l END AS findings FROM f""")
def _(spark, d):
    return AU.diagnose(AU.scorecard(*segs(spark, d), D))


@query("aud6_accuracy", "series:s model:s accuracy:f1", f"""
{ctes('models')} SELECT series, model, round(100 - avg(abs((y - yhat) / y) * 100), 1) AS accuracy FROM models WHERE y > 0 AND yhat > 0 GROUP BY ALL""")
def _(spark, d):
    return AU.accuracy(panel(spark, d, "models"), ["series", "model"])


@query("aud7_performance_report", "series:s n_periods:i success_rate:f6 failure_rate:f6 bias_direction:s worst_periods:a model_mape:f6 quality:s risk:s", f"""
{ctes('fc', 'act', 'models')}, {ACT2}, {CMP}, {_SUM}, {TRI}, {BEST}, w AS (SELECT series, list(CAST(ds AS VARCHAR) ORDER BY mape DESC, ds)[1:5] AS worst_periods FROM cm GROUP BY series), b AS (SELECT series, mape AS model_mape FROM best)
SELECT series, n_periods, (n_excellent + n_good + n_acceptable) / n_periods * 100 AS success_rate, (n_review + n_significant_deviation) / n_periods * 100 AS failure_rate, CASE WHEN overall_bias > 0 THEN 'under_forecasting' ELSE 'over_forecasting' END AS bias_direction, worst_periods, model_mape,
CASE WHEN model_mape <= 5 THEN 'excellent' WHEN model_mape <= 10 THEN 'good' WHEN model_mape <= 15 THEN 'acceptable_with_caution' WHEN model_mape <= 25 THEN 'needs_improvement' ELSE 'critical' END AS quality,
CASE WHEN model_mape <= 5 THEN 'low' WHEN model_mape <= 10 THEN 'low_medium' WHEN model_mape <= 15 THEN 'medium' WHEN model_mape <= 25 THEN 'high' ELSE 'very_high' END AS risk FROM sm JOIN w USING (series) JOIN b USING (series)""")
def _(spark, d):
    cmp = AU.audit_periods(panel(spark, d, "fc"), act2(spark, d), K)
    return AU.performance_report(cmp, ranked_best(spark, d), K)


# ---- explanation -------------------------------------------------------------------------

_IMP = "SELECT series, c AS covariate, CASE c WHEN 'is_christmas_week' THEN avg(y) / 50 WHEN 'days_to_easter' THEN -avg(y) / 90 ELSE avg(y) / 7 END AS mean_impact FROM {hist} CROSS JOIN (SELECT 'is_christmas_week' AS c UNION ALL SELECT 'days_to_easter' UNION ALL SELECT 'price') AS n GROUP BY series, c"
IMP = f"imp AS ({_IMP.replace('{hist}', 'hist')}), he AS (SELECT series, sum(abs(mean_impact)) AS holiday_total FROM imp WHERE covariate <> 'price' GROUP BY series)"


def effect(spark, d):
    return EX.holiday_effect(spark.sql(_IMP, hist=panel(spark, d, "hist")), K)


PARTS = """pa AS (SELECT fc.*, row_number() OVER (PARTITION BY series ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY series) AS n, avg(yhat) OVER (PARTITION BY series) AS base FROM fc),
sl AS (SELECT series, regr_slope(yhat, i) AS slope FROM pa GROUP BY series), pt AS (SELECT pa.*, slope * i AS trend, yhat - base - slope * i AS seasonal, holiday_total / n AS holiday FROM pa JOIN sl USING (series) JOIN he USING (series))"""


@query("exp1_decompose_forecast", "series:s h:i base:f6 trend:f6 seasonal:f6 holiday:f6", f"""
{ctes('fc', 'hist')}, {IMP}, {PARTS} SELECT * FROM pt""")
def _(spark, d):
    return EX.decompose_forecast(panel(spark, d, "fc"), K, effect(spark, d))


@query("exp1_component_totals", "series:s total_base:f2 total_trend:f2 total_holiday:f2", f"""
{ctes('fc', 'hist')}, {IMP}, {PARTS} SELECT series, sum(base) AS total_base, sum(trend) AS total_trend, sum(holiday) AS total_holiday FROM pt GROUP BY series""")
def _(spark, d):
    return EX.component_totals(EX.decompose_forecast(panel(spark, d, "fc"), K, effect(spark, d)), K)


@query("exp2_holiday_effect", "series:s holiday_total:f5", f"""
{ctes('hist')}, {IMP} SELECT * FROM he""")
def _(spark, d):
    return effect(spark, d)


def _profile_mape(spark, d):
    best = WN.rank_models(spark.sql(_MONTHS, monthly=panel(spark, d, "monthly")), K).where("is_best").groupBy(*K).agg(F.max("mape").alias("mape"))
    return join_on_keys(profile(rows_of_profile(spark, d), K, "monthly"), best, K)


# errors of two simple models over the last year of each monthly series
_MONTHS = """SELECT series, model, avg(abs((y - CASE model WHEN 'last' THEN last_y ELSE year_y END) / y) * 100) AS mape
FROM (SELECT series, y, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS back, lag(y, 1) OVER (PARTITION BY series ORDER BY ds) AS last_y, lag(y, 12) OVER (PARTITION BY series ORDER BY ds) AS year_y FROM {monthly}) AS m
CROSS JOIN (SELECT 'last' AS model UNION ALL SELECT 'year') AS n WHERE back <= 12 GROUP BY series, model"""
_PM = f"mm AS (SELECT series, min(mape) AS mape FROM ({_MONTHS.replace('{monthly}', 'monthly')}) GROUP BY series), pm AS (SELECT pf.*, mape FROM pf JOIN mm USING (series))"


@query("exp3_confidence", "series:s accuracy_score:f1 history_score:f1 confidence_score:f1 confidence_level:s", f"""
{ctes('sales', 'monthly')}, {HOL}, {PROFILE_CTES}, {_PM}, cf AS (SELECT *, CASE WHEN mape <= 1 THEN 100 WHEN mape <= 3 THEN 90 WHEN mape <= 5 THEN 75 WHEN mape <= 10 THEN 50 ELSE 25 END AS accuracy_score, CASE WHEN history_months >= 36 THEN 100 WHEN history_months >= 24 THEN 80 WHEN history_months >= 12 THEN 60 ELSE 30 END AS history_score FROM pm),
sf AS (SELECT *, round(accuracy_score * 0.4 + history_score * 0.3 + data_quality_score * 0.2 + round(holiday_coverage, 1) * 0.1, 9) AS sc FROM cf) SELECT *, round(sc, 1) AS confidence_score, CASE WHEN sc >= 80 THEN 'high' WHEN sc >= 60 THEN 'medium' ELSE 'low' END AS confidence_level FROM sf""")
def _(spark, d):
    return EX.confidence(_profile_mape(spark, d))


@query("exp4_forecast_summary", "series:s horizon:i total:f5 trend_pct:f6 direction:s confidence:s", f"""
{ctes('fc', 'models')}, {TRI}, {BEST}, p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM fc), s AS (SELECT series, any_value(n) AS horizon, sum(yhat) AS total, avg(yhat) FILTER (i < n // 2) AS a, avg(yhat) FILTER (i >= n // 2) AS b FROM p GROUP BY series),
t AS (SELECT s.*, (b - a) / a * 100 AS trend_pct, mape AS m FROM s JOIN best USING (series)) SELECT *, CASE WHEN trend_pct > 1 THEN 'increasing' WHEN trend_pct < -1 THEN 'decreasing' ELSE 'stable' END AS direction, CASE WHEN m <= 5 THEN 'high' WHEN m <= 10 THEN 'medium' ELSE 'low' END AS confidence FROM t""")
def _(spark, d):
    return EX.forecast_summary(panel(spark, d, "fc"), ranked_best(spark, d), K)


@query("exp5_caveats", "series:s caveats:a", f"""
{ctes('sales', 'monthly')}, {HOL}, {PROFILE_CTES}, {_PM} SELECT series, list_filter([CASE WHEN history_months < 24 THEN 'short_history' END, CASE WHEN round(holiday_coverage, 1) < 70 THEN 'holiday_coverage' END, CASE WHEN mape > 4 + 6 THEN 'accuracy' END, 'patterns_continue'], {NOTNULL}) AS caveats FROM pm""")
def _(spark, d):
    return EX.caveats(_profile_mape(spark, d))


@query("exp6_audit_row", "n_rows:i data_hash:s config_hash:s random_seed:i model_version:s token:s", """
WITH h AS (SELECT CAST('0x' || left(sha256(concat_ws(chr(31), n_name, n_nationkey, n_regionkey)), 15) AS BIGINT) AS h FROM (SELECT n_name, n_nationkey, n_regionkey FROM nation, (SELECT c_nationkey FROM customer) WHERE n_nationkey = c_nationkey)),
a AS (SELECT count(*) AS n, sum(CAST(h AS DECIMAL(38,0))) AS s, bit_xor(h) AS x FROM h), t AS (SELECT n AS n_rows, left(sha256(n || ':' || s || ':' || x), 16) AS data_hash, left(sha256('horizon=12:models=arima,ets'), 16) AS config_hash FROM a)
SELECT *, 42 AS random_seed, '1.0' AS model_version, data_hash || ':' || config_hash || ':1.0' AS token FROM t""")
def _(spark, d):
    df = table(spark, d, "nation").join(table(spark, d, "customer").select("c_nationkey"), F.col("n_nationkey") == F.col("c_nationkey")).drop("c_nationkey")
    return EX.audit_row(df, {"models": ["ets", "arima"], "horizon": 12})


@query("exp7_selection_findings", "series:s best_model:s runner_up:s best_holdout:f6 runner_up_mape:f6 gap:f6 gap_note:s overfit_models:a top3:a n_models:i", f"""
{ctes('models')}, {TRI}, p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY holdout_mape, model) AS p, holdout_mape > eval_mape * 1.5 AS o FROM tri), s AS (SELECT series, max(model) FILTER (p = 1) AS best_model, max(model) FILTER (p = 2) AS runner_up, max(holdout_mape) FILTER (p = 1) AS best_holdout, max(holdout_mape) FILTER (p = 2) AS runner_up_mape,
max(holdout_mape) FILTER (p = 1) - max(eval_mape) FILTER (p = 1) AS gap, coalesce(list(model ORDER BY model) FILTER (o), []) AS ol, list(model ORDER BY p)[1:3] AS top3, count(*) AS n_models FROM p GROUP BY series)
SELECT *, CASE WHEN gap > 5 THEN 'overfit_to_eval' WHEN gap < -2 THEN 'generalises' END AS gap_note, CASE WHEN list_contains(ol, best_model) THEN [] ELSE ol END AS overfit_models FROM s""")
def _(spark, d):
    return EX.selection_findings(tri(spark, d), K)


