"""Forecasters, selection, level guard."""

from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import joins as J
from ..operators.evaluate import cross_validate, metrics
from ..operators.forecast import arima as AR
from ..operators.forecast import auto as AU
from ..operators.forecast import base as B
from ..operators.forecast import boosted as BO
from ..operators.forecast import frontier as FR
from ..operators.forecast import ladder as LA
from ..operators.forecast import naive as NV
from ..operators.forecast import select as SE
from ..operators.forecast import smooth as SM
from ..operators.forecast import structural as ST
from ..plans.train import train_models, weekly_naive_ranking
from .core import TAIL_SQL, split_sql
from .panels import ctes, panel
from .registry import query
from .signals import num

K = ["series"]
H = 12


def metrics_sql(src, keys):
    """One metrics row per group of ``src`` (columns y, yhat)."""
    nz = "abs(y) > 1e-10"
    return f"""SELECT {keys}, count(*) AS n, round(sqrt(avg((y - yhat) ** 2)), 2) AS rmse,
 least(500, round(CASE WHEN count(*) FILTER ({nz}) = 0 OR (count(*) - count(*) FILTER ({nz})) / count(*) > 0.2 THEN avg(least(100, abs(y - yhat) / (abs(y) + abs(yhat) + 1e-10) * 100)) ELSE avg(least(1000, abs((y - yhat) / y) * 100)) FILTER ({nz}) END, 2)) AS mape,
 round(least(500, sum(abs(y - yhat)) / sum(abs(y)) * 100), 2) AS wape, round(CASE WHEN var_pop(y) > 0 THEN greatest(-1, least(1, 1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)))) ELSE 0 END, 4) AS r2 FROM {src} GROUP BY {keys}"""


def naive_sql(h, src="nm"):
    """CTE ``sn`` from numbered rows."""
    return f"""d AS (SELECT *, y - lag(y) OVER (PARTITION BY series ORDER BY t) AS dd, CASE WHEN n >= 52 THEN 52 WHEN n >= 12 THEN 12 ELSE n END AS s FROM {src}),
sdev AS (SELECT series, stddev_pop(dd) AS sd FROM d GROUP BY series), stp AS (SELECT unnest(generate_series(1, {h})) AS h),
sn AS (SELECT d.series, h, y AS yhat, y - 1.959963984540054 * sd * sqrt(h) AS yhat_lower, y + 1.959963984540054 * sd * sqrt(h) AS yhat_upper FROM d JOIN stp ON t = n - s + (h - 1) % s JOIN sdev USING (series))"""


@query("fc1_seasonal_naive", "series:s h:i ds:d yhat:f5 yhat_lower:f5 yhat_upper:f5", f"""
{ctes('weekly')}, {num()}, {naive_sql(60)}, l AS (SELECT series, max(ds) AS last_ds FROM weekly GROUP BY series)
SELECT sn.*, last_ds + 7 * CAST(h AS INTEGER) AS ds FROM sn JOIN l USING (series)""")
def _(spark, d):
    df = panel(spark, d, "weekly")
    return NV.with_dates(NV.seasonal_naive(df, K, 60), df, K, 60, "weekly")


@query("fc1_many_series", "series:s h:i ds:d yhat:f5 yhat_lower:f5 yhat_upper:f5", f"""
{ctes('brands')}, {num('brands')}, {naive_sql(12)}, l AS (SELECT series, max(ds) AS last_ds FROM brands GROUP BY series)
SELECT sn.*, last_ds + 7 * CAST(h AS INTEGER) AS ds FROM sn JOIN l USING (series)""")
def _(spark, d):
    df = panel(spark, d, "brands")
    return NV.with_dates(NV.seasonal_naive(df, K, 12), df, K, 12, "weekly")


MEAN_DRIFT = """md0 AS (SELECT series, any_value(n) AS n, avg(y) FILTER (t >= n - 12) AS m, stddev_pop(y) FILTER (t >= n - 12) AS sd, (max(y) FILTER (t = n - 1) - max(y) FILTER (t = 0)) / any_value(n) AS tr FROM {src} GROUP BY series),
md AS (SELECT series, h, m + tr * h AS yhat, m + tr * h - 1.96 * sd AS yhat_lower, m + tr * h + 1.96 * sd AS yhat_upper FROM md0, (SELECT unnest(generate_series(1, {h})) AS h))"""


@query("fc2_mean_drift", "series:s h:i yhat:f6 yhat_lower:f5 yhat_upper:f5", f"""
{ctes('monthly')}, {num('monthly')}, {MEAN_DRIFT.format(src='nm', h=6)} SELECT * FROM md""")
def _(spark, d):
    return NV.mean_drift(panel(spark, d, "monthly"), K, 6)


@query("flagship_weekly_revenue_forecast", "series:s model:s n:i rmse:f2 mape:f2 wape:f2 r2:f4 rank:i is_best:b", f"""
{ctes('weekly')}, {TAIL_SQL.format(src='weekly')}, cl AS (SELECT series, ds, y FROM tail WHERE NOT is_tail), {split_sql('cl', 'series', H)},
nm AS (SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY series) AS n FROM split WHERE split <> 'holdout'), {naive_sql(H)}, {MEAN_DRIFT.format(src='nm', h=H)},
ho AS (SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY ds) AS h FROM split WHERE split = 'holdout'),
pr AS (SELECT series, 'seasonal_naive' AS model, y, yhat FROM sn JOIN ho USING (series, h) UNION ALL SELECT series, 'mean_drift', y, yhat FROM md JOIN ho USING (series, h)), me AS ({metrics_sql('pr', 'series, model')})
SELECT *, rank() OVER (PARTITION BY series ORDER BY mape) AS rank, rank() OVER (PARTITION BY series ORDER BY mape) = 1 AS is_best FROM me""")
def _(spark, d):
    """Weekly revenue per region: clean, split, forecast, score, rank."""
    return weekly_naive_ranking(panel(spark, d, "weekly"), K, H)


@query("fc9_future_frame", "series:s h:i ds:d", f"""
{ctes('monthly')}, s AS (SELECT series, unnest(generate_series(1, 6)) AS h FROM (SELECT DISTINCT series FROM monthly))
SELECT series, h, DATE '2001-10-01' + to_months(CAST(h AS INTEGER)) AS ds FROM s""")
def _(spark, d):
    return B.future_frame(panel(spark, d, "monthly"), K, 6, "monthly", "2001-09-15")


_ORDERS = "SELECT p, d, q FROM (SELECT unnest([0,1,2]) AS p), (SELECT unnest([0,1]) AS d), (SELECT unnest([0,1]) AS q) WHERE p + q > 0 ORDER BY p + d + q, '{\"d\": ' || d || ', \"p\": ' || p || ', \"q\": ' || q || '}' LIMIT 6"


@query("fc10_limit_grid", "series:s cand:s n_rows:i", f"""
{ctes('weekly')}, o AS ({_ORDERS}), s AS (SELECT series, count(*) AS n_rows FROM weekly GROUP BY series) SELECT series, '{{"d": ' || d || ', "p": ' || p || ', "q": ' || q || '}}' AS cand, n_rows FROM s, o""")
def _(spark, d):
    series = panel(spark, d, "weekly").groupBy("series").agg(F.count(F.lit(1)).alias("n_rows"))
    return J.cross_candidates(series, AR.arima_grid(spark, n=6))


def model_scores(spark, d):
    return metrics(panel(spark, d, "models"), ["series", "model"]).withColumnRenamed("model", "cand")


SCORES = f"sc AS ({metrics_sql('models', 'series, model')})"


@query("fc11_select_candidate", "series:s cand:s mape:f2 rmse:f2", f"""
{ctes('models')}, {SCORES}, b AS (SELECT *, min(mape) OVER (PARTITION BY series) AS m FROM sc)
SELECT series, model AS cand, mape, rmse FROM b WHERE mape = m OR mape - m < 2.0 QUALIFY row_number() OVER (PARTITION BY series ORDER BY rmse, mape, model) = 1""")
def _(spark, d):
    return SE.select_candidate(model_scores(spark, d), K, tie=2.0)


@query("fc11_select_penalised", "series:s cand:s mape:f2 rmse:f2 score:f4", f"""
{ctes('models')}, {SCORES}, b AS (SELECT *, mape / 9.0 AS r, rmse * (1 + greatest(0, mape / 9.0 - 2) * 0.5) AS score FROM sc)
SELECT series, model AS cand, mape, rmse, score FROM b QUALIFY row_number() OVER (PARTITION BY series ORDER BY score, model) = 1""")
def _(spark, d):
    return SE.select_candidate(model_scores(spark, d).withColumn("train_mape", F.lit(9.0)), K, rule="penalised")


_LADDER = """SELECT series, h, level, is_flat, yhat, yhat * 0.8 AS yhat_lower, yhat * 1.2 AS yhat_upper FROM (
 SELECT series, h, 0 AS level, false AS is_flat, CASE series WHEN 'ASIA' THEN yhat * 1.6 WHEN 'EUROPE' THEN yhat * 3 WHEN 'AFRICA' THEN yhat - 5000 ELSE yhat END AS yhat FROM {fc}
 UNION ALL SELECT series, h, 1, true, CASE series WHEN 'AFRICA' THEN yhat - 6000 ELSE yhat * 0.7 END FROM {fc} UNION ALL SELECT series, h, 2, true, yhat * 0.4 FROM {fc})"""


@query("fc13_level_guard", "series:s h:i level:i scale:f6 yhat:f5 yhat_lower:f5", f"""
{ctes('hist', 'fc')}, la AS ({_LADDER.replace('{fc}', 'fc')}), b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS back, count(*) OVER (PARTITION BY series) AS n, avg(y) OVER (PARTITION BY series) AS fm FROM hist),
r AS (SELECT series, avg(y) AS rec, any_value(fm) AS full_m FROM b WHERE back <= least(24, greatest(n // 4, 12)) GROUP BY series), s AS (SELECT series, level, avg(yhat) AS m, bool_or(yhat < 0) AS neg, bool_or(is_flat) AS flat FROM la GROUP BY ALL),
j AS (SELECT s.*, CASE WHEN rec > 0 THEN rec ELSE full_m END AS base, full_m FROM s JOIN r USING (series)), u AS (SELECT *, neg OR m < 0 OR (level = 0 AND (abs(m / base) > 2 OR abs(m / base) < 0.5 OR abs(m / full_m) > 5)) AS bad FROM j),
k AS (SELECT *, coalesce(min(level) FILTER (NOT bad) OVER (PARTITION BY series), max(level) OVER (PARTITION BY series)) AS take FROM u), p AS (SELECT *, CASE WHEN level = 0 AND NOT bad AND m / base > 1.3 THEN base * 1.3 / m ELSE 1 END AS s1 FROM k WHERE level = take),
q AS (SELECT *, s1 * CASE WHEN flat AND m * s1 > 0 AND base / (m * s1) > 1.1 THEN least(base / (m * s1), 1.95) ELSE 1 END AS scale FROM p)
SELECT la.series, la.h, la.level, scale, yhat * scale AS yhat, yhat_lower * scale AS yhat_lower FROM la JOIN q USING (series, level)""")
def _(spark, d):
    ladder = spark.sql(_LADDER, fc=panel(spark, d, "fc"))
    return SE.level_guard(ladder, panel(spark, d, "hist"), K, 12)


def last_times(step):
    """A forecaster: the last value, grown by ``step`` of itself with each period."""
    def forecast(hist, future, keys):
        last = hist.groupBy(*keys).agg(F.max_by("y", "ds").alias("last"))
        return future.select(*keys, "h", "ds").join(last, keys).select(*keys, "h", "ds", (F.col("last") * (1 + step * F.col("h"))).alias("yhat"))

    return forecast


# last value and mean of each slice; the mean of twelve steep steps is 4.25 times the last value
_LAST = "la AS (SELECT region, segment, arg_max(y, ds) AS last, arg_max(y, ds) * 4.25 / avg(y) AS ratio FROM slices GROUP BY region, segment), lb AS (SELECT *, ratio > 5 OR ratio < 0.2 AS off FROM la)"


def ladder(spark, d):
    rows = panel(spark, d, "slices")
    keys = ["region", "segment"]
    return LA.climb(rows, B.future_frame(rows, keys, H, "weekly"), keys, [("steep", last_times(0.5)), ("last", last_times(0.0)), ("season", NV.naive_forecaster)])


@query("fc13_climb_rounds", "region:s segment:s level:i level_name:s reason:s", f"""
{ctes('slices')}, {_LAST} SELECT region, segment, 0 AS level, 'steep' AS level_name, CASE WHEN off THEN 'mean_level' END AS reason FROM lb
UNION ALL SELECT region, segment, 1, 'last', 'flat' FROM lb WHERE off UNION ALL SELECT region, segment, 2, 'season', NULL FROM lb WHERE off""")
def _(spark, d):
    return ladder(spark, d)["rounds"]


@query("fc13_climb_forecast", "region:s segment:s h:i level_name:s yhat:f6", f"""
{ctes('slices')}, {_LAST}, nm AS (SELECT *, row_number() OVER (PARTITION BY region, segment ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY region, segment) AS n FROM slices),
hs AS (SELECT unnest(generate_series(1, {H})) AS h), ss AS (SELECT region, segment, h, y FROM (SELECT *, CASE WHEN n >= 52 THEN 52 WHEN n >= 12 THEN 12 ELSE n END AS s FROM nm) JOIN hs ON t = n - s + (h - 1) % s)
SELECT region, segment, h, CASE WHEN off THEN 'season' ELSE 'steep' END AS level_name, CASE WHEN off THEN y ELSE last * (1 + 0.5 * h) END AS yhat FROM lb JOIN ss USING (region, segment)""")
def _(spark, d):
    return ladder(spark, d)["forecast"]


_COEF = """SELECT series, 'disc' AS covariate, regr_slope(y, disc) AS coef FROM {ship} GROUP BY series UNION ALL SELECT series, 'qty', regr_slope(y, qty) FROM {ship} GROUP BY series UNION ALL SELECT series, 'promo', regr_slope(y, promo) FROM {ship} GROUP BY series"""


@query("fc14_covariate_impact", "series:s covariate:s coef:f4 impact:f5 score:f6 direction:s", f"""
{ctes('ship')}, c AS ({_COEF.replace('{ship}', 'ship')}), s AS (SELECT series, stddev_samp(disc) AS a, stddev_samp(qty) AS b, stddev_samp(promo) AS p FROM ship GROUP BY series),
i AS (SELECT c.*, abs(coef * CASE covariate WHEN 'disc' THEN a WHEN 'qty' THEN b ELSE p END) AS impact FROM c JOIN s USING (series))
SELECT *, least(100, impact / max(impact) OVER (PARTITION BY series) * 100) AS score, CASE WHEN coef > 0 THEN 'positive' ELSE 'negative' END AS direction FROM i""")
def _(spark, d):
    df = panel(spark, d, "ship").withColumn("promo", F.col("promo").cast("double"))
    return SE.covariate_impact(spark.sql(_COEF, ship=df), df, K)


# ---- fitted models: checked by shape and properties --------------------------------------

_FC = "series:s cand:s h:i ds:d yhat:f4 yhat_lower:f4 yhat_upper:f4 error:s"


@query("fc3_ets", _FC)
def _(spark, d):
    df = panel(spark, d, "weekly")
    return SM.ets(df, B.future_frame(df, K, H, "weekly"), K, SM.ets_grid(spark, 52))


@query("fc4_arima", _FC)
def _(spark, d):
    df = panel(spark, d, "weekly")
    return AR.arima(df, B.future_frame(df, K, H, "weekly"), K, AR.arima_grid(spark))


@query("fc5_sarimax", _FC)
def _(spark, d):
    df = panel(spark, d, "ship")
    flags = ["is_christmas_week", "is_thanksgiving_week"]
    fut = J.fill_future_covariates(B.future_frame(df, K, H, "weekly"), df, K, ["disc", "promo"])
    hist, ahead = C.add_weekly_holidays(df), C.add_weekly_holidays(fut)
    return AR.sarimax(hist, ahead, K, AR.sarimax_grid(spark, 52), ["disc", "promo", *flags])


@query("fc6_structural", _FC)
def _(spark, d):
    df = panel(spark, d, "weekly")
    return ST.structural(df, B.future_frame(df, K, H, "weekly"), K, ST.structural_grid(spark, "weekly"))


@query("fc7_boosted", "series:s h:i ds:d yhat:f4 yhat_lower:f4 yhat_upper:f4")
def _(spark, d):
    df = panel(spark, d, "weekly")
    return BO.boosted(df, B.future_frame(df, K, H, "weekly"), K, "weekly", H)


@query("fc8_theta", _FC)
def _(spark, d):
    df = panel(spark, d, "weekly")
    return SM.theta(df, B.future_frame(df, K, H, "weekly"), K, 52)


# trailing means of 1 to 26 values; the walk tries one and four more or fewer, from 8 on
_MEANS = (1, 26, 8)
_STEPS = (1, -1, 4, -4)


@query("fc8_frontier_means", "series:s width:i crit:f6 n_tried:i is_monotone:b is_settled:b", f"""
WITH RECURSIVE {ctes('weekly').removeprefix('WITH ')}, {num()}, ks AS (SELECT unnest(generate_series({_MEANS[0]}, {_MEANS[1]})) AS k),
er AS (SELECT a.series, k, a.t, any_value(a.y) - avg(b.y) AS e FROM nm a JOIN ks ON true JOIN nm b ON b.series = a.series AND b.t BETWEEN a.t - k AND a.t - 1 WHERE a.t >= {_MEANS[1]} GROUP BY a.series, k, a.t),
cr AS (SELECT series, k, count(*) * ln(avg(e * e)) AS crit FROM er GROUP BY series, k),
mv AS (SELECT unnest({list(_STEPS)}) AS s), nx AS (SELECT a.series, a.k, arg_min(b.k, b.crit) AS k2, min(b.crit) AS c2, any_value(a.crit) AS c1 FROM cr a JOIN mv ON true JOIN cr b ON b.series = a.series AND b.k = a.k + s GROUP BY a.series, a.k),
wk(series, k) AS (SELECT DISTINCT series, {_MEANS[2]} FROM cr UNION ALL SELECT wk.series, nx.k2 FROM wk JOIN nx ON nx.series = wk.series AND nx.k = wk.k WHERE nx.c2 < nx.c1),
tr AS (SELECT series, k FROM wk UNION SELECT wk.series, cr.k FROM wk JOIN mv ON true JOIN cr ON cr.series = wk.series AND cr.k = wk.k + s)
SELECT series, arg_min(k, crit) AS width, min(crit) AS crit, count(*) AS n_tried, true AS is_monotone, true AS is_settled FROM tr JOIN cr USING (series, k) GROUP BY series""")
def _(spark, d):
    """Frontier search with a criterion in DataFrame functions: the width of a trailing mean by its one-step errors."""
    low, high, first = _MEANS
    rows = panel(spark, d, "weekly")
    steps = spark.createDataFrame([([s], [low], [high]) for s in _STEPS], "step array<int>, low array<int>, high array<int>")
    packed = AU.pack(rows, K)

    def score(points):
        k = F.col("point")[0]
        at = F.sequence(F.lit(high + 1), F.size("values"))
        errors = F.transform(at, lambda i: F.element_at("values", i) - F.aggregate(F.slice("values", i - k, k), F.lit(0.0), lambda a, v: a + v) / k)
        n = F.size("values") - high
        sse = F.aggregate(errors, F.lit(0.0), lambda a, e: a + e * e)
        return points.join(packed, K).where(n > 0).select(*K, "point", (n * F.log(sse / n)).alias("crit"), F.lit(None).cast("string").alias("error"))

    starts = rows.select(*K).distinct().withColumn("point", F.array(F.lit(first)))
    tried = FR.frontier_search(starts, K, steps, score)
    return FR.search_report(tried, K, steps).withColumn("width", F.col("point")[0])


@query("fc8_auto_search", "series:s family:s d:i is_monotone:b is_settled:b is_within:b", f"""
{ctes('weekly')}, df AS (SELECT series, y, y - lag(y) OVER w AS y1, y - 2 * lag(y) OVER w + lag(y, 2) OVER w AS y2 FROM weekly WINDOW w AS (PARTITION BY series ORDER BY ds)),
sd AS (SELECT series, stddev_pop(y) AS s0, stddev_pop(y1) AS s1, stddev_pop(y2) AS s2 FROM df GROUP BY series)
SELECT series, family, CASE WHEN family <> 'arima' THEN NULL WHEN s1 < s0 AND NOT s2 < s1 THEN 1 WHEN s2 < s0 AND s2 < s1 THEN 2 ELSE 0 END AS d, true AS is_monotone, true AS is_settled, true AS is_within FROM sd, (SELECT unnest(['arima', 'ets', 'theta']) AS family)""")
def _(spark, d):
    """Walks of the automatic set: each round but the last improves, none ends beside an untried point, none tries more than the grid."""
    tried = AU.auto_search(panel(spark, d, "weekly"), K, 52)
    keys = [*K, "family"]
    grid = F.when(F.col("family") == "arima", 72).otherwise(F.when(F.col("family") == "ets", 9).otherwise(21))
    out = FR.search_report(tried, keys, AU.move_table(spark))
    return out.withColumns({"d": F.when(F.col("family") == "arima", F.col("point")[0]), "is_within": F.col("n_tried").between(2, grid)})


@query("fc8_auto_set", "series:s model:s cand:s h:i ds:d yhat:f4 yhat_lower:f4 yhat_upper:f4")
def _(spark, d):
    """Best family of each series by holdout error, at its best point, fitted on all rows."""
    return train_models(panel(spark, d, "weekly"), K, "weekly", H, {"auto": AU.auto_set(52)})["forecast"]


@query("fc12_train_and_refit", "series:s model:s cand:s h:i ds:d yhat:f4 yhat_lower:f4 yhat_upper:f4")
def _(spark, d):
    def maker(model, grid):
        return lambda winners: B.registered(model, grid if winners is None else winners)

    models = {"ets": maker(SM.ets_model, SM.ets_grid(spark, 52)), "theta": maker(SM.theta_model, B.grid_table(spark, [{"period": 52}])), "arima": maker(AR.arima_model, AR.arima_grid(spark))}
    return train_models(panel(spark, d, "weekly"), K, "weekly", H, models)["forecast"]


@query("udf1_pluggable_forecaster", _FC, f"""
{ctes('weekly')}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS back FROM weekly),
s AS (SELECT series, k, avg(y) FILTER (back <= k) AS m, stddev_pop(y) AS sd, max(ds) AS last FROM r, (SELECT unnest([1, 4]) AS k) GROUP BY series, k)
SELECT series, '{{"k": ' || k || '}}' AS cand, h, last + 7 * h AS ds, m AS yhat, m - 1.959963984540054 * sd AS yhat_lower, m + 1.959963984540054 * sd AS yhat_upper, CAST(NULL AS VARCHAR) AS error
FROM s, (SELECT unnest([1, 2, 3, 4]) AS h)""")
def _(spark, d):
    import numpy as np

    def last_value(y, ds, params, h, x=None, xf=None):
        return np.full(h, y[-int(params["k"]):].mean()), np.full(h, y.std())

    df = panel(spark, d, "weekly")
    return B.fan_out(df, B.future_frame(df, K, 4, "weekly"), K, B.grid_table(spark, {"k": (1, 4)}), last_value)


def _cv_sql(h, splits):
    room = "(n - greatest(n // 2, 10))"
    return f"""ln AS (SELECT series, any_value(n) AS n FROM nm GROUP BY series), kk AS (SELECT series, n, greatest(n // 2, 10) AS f0, CASE WHEN {room} < {splits * h} THEN greatest(1, {room} // {h}) ELSE {splits} END AS k FROM ln),
fo AS (SELECT series, n, fold, f0 + fold * ((n - f0) // k) AS sp FROM (SELECT *, unnest(generate_series(0, k - 1)) AS fold FROM kk)),
pd AS (SELECT fo.series, fold, a.y, b.y AS yhat FROM fo JOIN nm a ON a.series = fo.series AND a.t >= sp AND a.t < least(sp + {h}, fo.n)
 JOIN nm b ON b.series = fo.series AND b.t = sp - CASE WHEN sp >= 52 THEN 52 WHEN sp >= 12 THEN 12 ELSE sp END + (a.t - sp) % CASE WHEN sp >= 52 THEN 52 WHEN sp >= 12 THEN 12 ELSE sp END),
cs AS (SELECT series, fold, avg(least(1000, abs((y - yhat) / y) * 100)) AS m FROM pd GROUP BY ALL)"""


@query("evl5_cross_validate", "series:s cv_mape:f2 cv_mape_std:f2 n_splits:i scores:s", f"""
{ctes('weekly')}, {num()}, {_cv_sql(12, 3)} SELECT series, round(avg(m), 2) AS cv_mape, round(stddev_pop(m), 2) AS cv_mape_std, count(*) AS n_splits, string_agg(CAST(CAST(floor(m) AS BIGINT) AS VARCHAR), ',' ORDER BY fold) AS scores FROM cs GROUP BY series""")
def _(spark, d):
    out = cross_validate(panel(spark, d, "weekly"), K, NV.naive_forecaster, 3, 12)
    return out.withColumn("scores", F.concat_ws(",", F.transform("cv_scores", lambda x: F.floor(x).cast("bigint").cast("string"))))
