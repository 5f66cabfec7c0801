"""Advice rules."""

from pyspark.sql import functions as F

from ..operators import advice as A
from ..operators import quality as Q
from ..operators import signals as S
from ..operators.forecast import grids as GR
from ..operators.forecast import structural as ST
from ..operators.forecast.base import future_frame
from ..plans.profile import profile
from .calendar import HOL
from .panels import ctes, panel
from .quality import PROFILE_CTES, rows_of_profile
from .registry import query
from .signals import characteristics_sql, forecastability_sql, num

K = ["series"]
D = ["region", "segment"]

CHARS = characteristics_sql()
FS = f"{num()}, {forecastability_sql(52)}"
NOTNULL = "lambda x: x IS NOT NULL"


def chars(spark, d):
    return S.characteristics(panel(spark, d, "weekly"), K, "weekly")


def sig(spark, d, name="weekly", p=52):
    return S.forecastability(panel(spark, d, name), K, p)


_SEAS = "seasonality_type IN ('strong', 'moderate')"
REC = f"""rm AS (SELECT series, 'structural' AS model, round(greatest(0, least(1, 0.7 + CASE WHEN {_SEAS} THEN 0.2 ELSE 0 END - CASE WHEN n_observations < 52 THEN 0.3 ELSE 0 END - CASE WHEN outlier_pct > 5 THEN 0.1 ELSE 0 END
 + CASE WHEN trend_type IN ('strong_up', 'strong_down') THEN 0.1 ELSE 0 END)), 6) AS confidence, 0.3 AS lim FROM ch
UNION ALL SELECT series, 'ets', round(0.65 + CASE WHEN {_SEAS} THEN 0.15 ELSE 0 END - CASE WHEN n_observations < 24 THEN 0.2 ELSE 0 END, 6), 0.8 FROM ch
UNION ALL SELECT series, 'theta', round(least(1, 0.75 + CASE WHEN has_autocorrelation THEN 0.1 ELSE 0 END + CASE WHEN {_SEAS} THEN 0.1 ELSE 0 END - CASE WHEN n_observations < 24 THEN 0.2 WHEN n_observations < 52 THEN 0.1 ELSE 0 END), 6), 0.8 FROM ch
UNION ALL SELECT series, 'naive', round(0.7 + CASE WHEN n_observations >= 104 THEN 0.15 WHEN n_observations < 52 THEN -0.15 ELSE 0 END + CASE WHEN has_outliers THEN 0.05 ELSE 0 END, 6), 0.8 FROM ch
UNION ALL SELECT series, unnest(['arima', 'sarimax', 'boosted']), 0, 2 FROM ch),
recs AS (SELECT series, model, confidence, confidence >= lim AS recommended FROM rm)"""


@query("adv1_recommend_models", "series:s model:s confidence:f4 recommended:b", f"""
{ctes('weekly')}, {CHARS}, {REC} SELECT * FROM recs""")
def _(spark, d):
    return A.recommend_models(chars(spark, d), K)


_SHIFT = "SELECT series, n, score, CASE series WHEN 'ASIA' THEN 250.0 WHEN 'EUROPE' THEN 620.0 WHEN 'AFRICA' THEN 120.0 ELSE total_growth_pct END AS total_growth_pct, CASE WHEN series = 'AMERICA' THEN 15.0 ELSE score END AS s2 FROM "


def shifted(spark, d):
    return spark.sql(_SHIFT + "{fs}", fs=sig(spark, d)).drop("score").withColumnRenamed("s2", "score")


@query("adv2_advisor_models", "series:s recommended_models:a excluded_models:a", f"""
{ctes('weekly')}, {FS}, x AS ({_SHIFT} fs) SELECT series, CASE WHEN s2 < 20 THEN ['structural', 'ets'] WHEN total_growth_pct > 200 OR n < 104 THEN ['structural', 'ets', 'theta'] ELSE ['structural', 'ets', 'theta', 'naive'] END AS recommended_models,
list_filter(['arima:disabled', 'sarimax:disabled', 'boosted:disabled', CASE WHEN n < 104 THEN 'naive:short_history' WHEN total_growth_pct > 200 THEN 'naive:high_growth' WHEN s2 < 20 THEN 'naive:unforecastable' END, CASE WHEN s2 < 20 THEN 'theta:unforecastable' END], {NOTNULL}) AS excluded_models FROM x""")
def _(spark, d):
    return A.advisor_models(shifted(spark, d))


@query("adv3_training_window", "series:s training_window:i", f"""
{ctes('weekly')}, {FS}, x AS ({_SHIFT} fs) SELECT series, CASE WHEN total_growth_pct > 500 AND n > 104 THEN 78 WHEN total_growth_pct > 200 AND n > 130 THEN 104 WHEN total_growth_pct > 100 AND n > 156 THEN 130 END AS training_window FROM x""")
def _(spark, d):
    return A.training_window(shifted(spark, d))


LOGADV = """la AS (SELECT series, any_value(n) AS n, bool_or(y < 0) AS neg, avg(y) FILTER (t >= n - least(n, 52)) AS r, avg(y) FILTER (t < least(n, 52)) AS e, var_pop(y) FILTER (t < n // 2) AS v1, var_pop(y) FILTER (t >= n // 2) AS v2 FROM nm GROUP BY series),
lb AS (SELECT series, neg, greatest(r, CASE WHEN n > 52 THEN e ELSE r END) / greatest(least(r, CASE WHEN n > 52 THEN e ELSE r END), 1) AS magnitude_ratio, CASE WHEN n >= 20 AND v1 > 0 THEN v2 / v1 ELSE 1 END AS variance_ratio FROM la),
lg AS (SELECT lb.*, total_growth_pct AS g, CASE WHEN neg THEN 'never' WHEN magnitude_ratio > 10 AND total_growth_pct > 500 THEN 'always' WHEN variance_ratio > 4 AND total_growth_pct <= 100 THEN 'always' WHEN total_growth_pct > 100 THEN 'never' WHEN total_growth_pct > 50 THEN 'auto' ELSE 'never' END AS log_transform FROM lb JOIN gr USING (series))"""
_VAR = "SELECT series, ds, CASE WHEN series = 'ASIA' THEN exp((ds - DATE '1995-01-01') / 400.0) * y WHEN series = 'EUROPE' AND year(ds) > 1998 THEN 1500 + (y - 1500) * 4 WHEN series = 'AFRICA' THEN y - 3000 ELSE y END AS y FROM weekly"


@query("adv4_log_advice", "series:s magnitude_ratio:f5 variance_ratio:f5 log_transform:s", f"""
{ctes('weekly')}, gw AS ({_VAR}), {num('gw')}, g AS (SELECT series, any_value(n) AS n, median(y) FILTER (t < greatest(1, n // 4)) AS f, median(y) FILTER (t >= n - greatest(1, n // 4)) AS l FROM nm GROUP BY series),
gr AS (SELECT series, n, CASE WHEN n < 8 OR f = 0 THEN 0 ELSE (l - f) / abs(f) * 100 END AS total_growth_pct FROM g), {LOGADV} SELECT * FROM lg""")
def _(spark, d):
    y, yr = F.col("y"), F.year("ds")
    grown = F.exp(F.datediff("ds", F.lit("1995-01-01").cast("date")) / 400.0) * y
    df = panel(spark, d, "weekly").withColumn("y", F.when(F.col("series") == "ASIA", grown).when((F.col("series") == "EUROPE") & (yr > 1998), 1500 + (y - 1500) * 4)
                                              .when(F.col("series") == "AFRICA", y - 3000).otherwise(y))
    return A.log_advice(df, K, S.growth_rates(df, K, 52))


def horizon_sql(src, score="score", p=52):
    cap = f"least(greatest(1, n // 4), CASE WHEN {score} >= 80 THEN {p} WHEN {score} >= 60 THEN {p // 2} WHEN {score} >= 40 THEN {p // 4} WHEN {score} >= 20 THEN {p // 6} ELSE 4 END)"
    return f"""hz AS (SELECT *, {cap} AS max_reliable_horizon, greatest(1, least(CASE WHEN {score} >= 60 THEN {p // 4} WHEN {score} >= 40 THEN 8 ELSE 4 END, {cap})) AS recommended_horizon FROM {src})"""


@query("adv5_horizon_advice", "series:s max_reliable_horizon:i recommended_horizon:i horizon_ok:b", f"""
{ctes('weekly')}, {FS}, {horizon_sql('fs')} SELECT *, recommended_horizon <= max_reliable_horizon AS horizon_ok FROM hz""")
def _(spark, d):
    return A.horizon_advice(sig(spark, d), 52)


EXPECT = """round(CASE WHEN score >= 80 THEN 3 WHEN score >= 60 THEN 8 WHEN score >= 40 THEN 15 WHEN score >= 20 THEN 25 ELSE 35 END * CASE WHEN volume_level IN ('very_low', 'low') THEN 1.5 ELSE 1 END, 1) AS expected_mape_low,
 round(CASE WHEN score >= 80 THEN 8 WHEN score >= 60 THEN 15 WHEN score >= 40 THEN 25 WHEN score >= 20 THEN 40 ELSE 60 END * CASE WHEN volume_level IN ('very_low', 'low') THEN 1.5 ELSE 1 END, 1) AS expected_mape_high"""


@query("adv6_expected_mape", "series:s volume_level:s expected_mape_low:f1 expected_mape_high:f1", f"""
{ctes('weekly')}, {FS}, m AS (SELECT list(round(mean_y, 6) ORDER BY round(mean_y, 6)) AS l, count(*) AS c FROM fs),
v AS (SELECT fs.*, CASE WHEN round(mean_y, 6) <= l[CAST(floor(c * 0.2) AS BIGINT) + 1] THEN 'very_low' WHEN round(mean_y, 6) <= l[CAST(floor(c * 0.4) AS BIGINT) + 1] THEN 'low' WHEN round(mean_y, 6) <= l[CAST(floor(c * 0.6) AS BIGINT) + 1] THEN 'medium'
 WHEN round(mean_y, 6) <= l[CAST(floor(c * 0.8) AS BIGINT) + 1] THEN 'high' ELSE 'very_high' END AS volume_level FROM fs, m) SELECT series, volume_level, {EXPECT} FROM v""")
def _(spark, d):
    return A.expected_mape(Q.volume_class(sig(spark, d), K, "mean_y"))


_S2 = "'region=' || region || '/segment=' || segment"
SLICE_FS = f"sl AS (SELECT {_S2} AS series, region, segment, ds, y FROM slices), {num('sl')}, {forecastability_sql(52)}"


@query("adv7_merge_advice", "varied_dim:s parent:s n_slices:i avg_score:f5 combined_score:f5 improvement:f5", f"""
{ctes('slices')}, {SLICE_FS}, wk AS (SELECT DISTINCT sl.region, sl.segment, sl.series, score FROM fs JOIN sl USING (series) WHERE score < 60),
op AS (SELECT 'region' AS varied_dim, 'segment=' || segment AS parent, * FROM wk UNION ALL SELECT 'segment', 'region=' || region, * FROM wk),
gp AS (SELECT varied_dim, parent, count(*) AS n_slices, avg(score) AS avg_score FROM op GROUP BY ALL HAVING count(*) >= 2),
mg AS (SELECT varied_dim || '#' || parent AS series, ds, sum(y) AS y FROM op JOIN sl USING (series) JOIN gp USING (varied_dim, parent) GROUP BY ALL)
SELECT varied_dim, parent, n_slices, avg_score, score AS combined_score, score - avg_score AS improvement FROM gp JOIN (
 WITH {num('mg')}, {forecastability_sql(52)} SELECT series, n, score FROM fs) f ON f.series = varied_dim || '#' || parent WHERE n >= 104 AND score - avg_score >= -50""")
def _(spark, d):
    return A.merge_advice(panel(spark, d, "slices"), D, 52, poor=60.0, gain=-50.0)


_SQ = """q AS (SELECT series, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM sl GROUP BY ALL),
g2 AS (SELECT sl.*, q1, q3, ds - lag(ds) OVER (PARTITION BY series ORDER BY ds) AS gap FROM sl JOIN q USING (series)),
sq AS (SELECT series, count(*) >= 104 AS has_sufficient_history, count(*) FILTER (gap > 10.5) AS gap_count, CASE WHEN count(*) >= 10 THEN count(*) FILTER (y < q1 - 2 * (q3 - q1) OR y > q3 + 2 * (q3 - q1)) ELSE 0 END AS anomalous_count, round(avg(y), 6) AS pm FROM g2 GROUP BY series),
pl AS (SELECT list(pm ORDER BY pm) AS l, count(*) AS c FROM sq),
vl AS (SELECT sq.*, CASE WHEN pm <= l[CAST(floor(c * 0.2) AS BIGINT) + 1] THEN 'very_low' WHEN pm <= l[CAST(floor(c * 0.4) AS BIGINT) + 1] THEN 'low' WHEN pm <= l[CAST(floor(c * 0.6) AS BIGINT) + 1] THEN 'medium'
 WHEN pm <= l[CAST(floor(c * 0.8) AS BIGINT) + 1] THEN 'high' ELSE 'very_high' END AS volume_level FROM sq, pl)"""


@query("adv8_advise_slices", "region:s segment:s n:i score:f5 grade:s has_sufficient_history:b gap_count:i anomalous_count:i volume_level:s training_window:i recommended_models:a expected_mape_low:f1 expected_mape_high:f1", f"""
{ctes('slices')}, {SLICE_FS}, {_SQ}, k AS (SELECT DISTINCT series, region, segment FROM sl)
SELECT region, segment, n, score, grade, has_sufficient_history, gap_count, anomalous_count, volume_level, CASE WHEN total_growth_pct > 500 AND n > 104 THEN 78 WHEN total_growth_pct > 200 AND n > 130 THEN 104 WHEN total_growth_pct > 100 AND n > 156 THEN 130 END AS training_window,
CASE WHEN score < 20 THEN ['structural', 'ets'] WHEN total_growth_pct > 200 OR n < 104 THEN ['structural', 'ets', 'theta'] ELSE ['structural', 'ets', 'theta', 'naive'] END AS recommended_models, {EXPECT} FROM fs JOIN vl USING (series) JOIN k USING (series)""")
def _(spark, d):
    return A.advise_slices(panel(spark, d, "slices"), D, "weekly")


@query("adv8_overall_quality", "total_slices:i forecastable_slices:i problematic_slices:i overall_data_quality:s", f"""
{ctes('slices')}, {SLICE_FS}, a AS (SELECT count(*) AS n, count(*) FILTER (score >= 40) AS ok, bool_and(n >= 104) AS lng FROM fs)
SELECT n AS total_slices, ok AS forecastable_slices, n - ok AS problematic_slices, CASE WHEN lng AND ok >= n * 0.7 THEN CASE WHEN ok = n THEN 'EXCELLENT' ELSE 'GOOD' END WHEN ok >= n * 0.5 THEN 'FAIR' ELSE 'POOR' END AS overall_data_quality FROM a""")
def _(spark, d):
    return A.overall_quality(A.advise_slices(panel(spark, d, "slices"), D, "weekly"))


@query("adv9_auto_configure", "series:s n:i score:f5 grade:s training_window:i from_date:d log_transform:s recommended_horizon:i max_reliable_horizon:i horizon_ok:b recommended_models:a expected_mape_low:f1 expected_mape_high:f1", f"""
{ctes('weekly')}, gw AS (SELECT series, ds, CASE WHEN series = 'ASIA' THEN exp((ds - DATE '1995-01-01') / 800.0) * y ELSE y END AS y FROM weekly), {num('gw')}, {forecastability_sql(52)}, {LOGADV}, {horizon_sql('fs')},
c AS (SELECT hz.*, 'medium' AS volume_level, log_transform, CASE WHEN total_growth_pct > 500 AND n > 104 THEN 78 WHEN total_growth_pct > 200 AND n > 130 THEN 104 WHEN total_growth_pct > 100 AND n > 156 THEN 130 END AS training_window FROM hz JOIN lg USING (series))
SELECT series, n, score, grade, training_window, (SELECT nm.ds FROM nm WHERE nm.series = c.series AND nm.t = c.n - c.training_window AND c.n > c.training_window) AS from_date, log_transform, 12 AS recommended_horizon, max_reliable_horizon, 12 <= max_reliable_horizon AS horizon_ok,
CASE WHEN score < 20 THEN ['structural', 'ets'] WHEN total_growth_pct > 200 OR n < 104 THEN ['structural', 'ets', 'theta'] ELSE ['structural', 'ets', 'theta', 'naive'] END AS recommended_models, {EXPECT} FROM c""")
def _(spark, d):
    grown = F.exp(F.datediff("ds", F.lit("1995-01-01").cast("date")) / 800.0) * F.col("y")
    return A.auto_configure(panel(spark, d, "weekly").withColumn("y", F.when(F.col("series") == "ASIA", grown).otherwise(F.col("y"))), K, "weekly", 12)


_GRID = f"""gd AS (SELECT series, unnest(list_filter([
 CASE WHEN n_observations < 52 THEN {{'model': 'structural', 'param': 'trend_flexibility', 'v': '0.01,0.05,0.1'}} WHEN n_observations < 104 THEN {{'model': 'structural', 'param': 'trend_flexibility', 'v': '0.01,0.05,0.1,0.5'}} END,
 CASE WHEN n_observations < 52 THEN {{'model': 'structural', 'param': 'season_flexibility', 'v': '0.1,1.0'}} WHEN n_observations < 104 THEN {{'model': 'structural', 'param': 'season_flexibility', 'v': '0.1,1.0,10.0'}} END,
 CASE WHEN n_years < 2 THEN {{'model': 'structural', 'param': 'yearly', 'v': 'false'}} END, {{'model': 'structural', 'param': 'season_mode', 'v': season_mode}},
 CASE WHEN n_observations < 50 THEN {{'model': 'arima', 'param': 'p', 'v': '0,1,2'}} WHEN n_observations < 100 THEN {{'model': 'arima', 'param': 'p', 'v': '0,1,2,3'}} END, CASE WHEN n_observations < 50 THEN {{'model': 'arima', 'param': 'd', 'v': '0,1'}} WHEN n_observations < 100 THEN {{'model': 'arima', 'param': 'd', 'v': '0,1,2'}} END,
 CASE WHEN n_observations < 50 THEN {{'model': 'arima', 'param': 'q', 'v': '0,1,2'}} WHEN n_observations < 100 THEN {{'model': 'arima', 'param': 'q', 'v': '0,1,2,3'}} END, CASE WHEN n_observations < 50 THEN {{'model': 'sarimax', 'param': 'p', 'v': '0,1,2'}} WHEN n_observations < 100 THEN {{'model': 'sarimax', 'param': 'p', 'v': '0,1,2,3'}} END,
 CASE WHEN n_observations < 50 THEN {{'model': 'sarimax', 'param': 'd', 'v': '0,1'}} WHEN n_observations < 100 THEN {{'model': 'sarimax', 'param': 'd', 'v': '0,1,2'}} END, CASE WHEN n_observations < 50 THEN {{'model': 'sarimax', 'param': 'q', 'v': '0,1,2'}} WHEN n_observations < 100 THEN {{'model': 'sarimax', 'param': 'q', 'v': '0,1,2,3'}} END,
 CASE WHEN has_negative THEN {{'model': 'ets', 'param': 'trend', 'v': 'none,add'}} END, CASE WHEN has_negative THEN {{'model': 'ets', 'param': 'seasonal', 'v': 'none,add'}} WHEN seasonality_type = 'none' THEN {{'model': 'ets', 'param': 'seasonal', 'v': 'none'}} END,
 CASE WHEN n_observations < 100 THEN {{'model': 'boosted', 'param': 'n_trees', 'v': '50,100'}} WHEN n_observations < 500 THEN {{'model': 'boosted', 'param': 'n_trees', 'v': '100,200'}} END, CASE WHEN n_observations < 100 THEN {{'model': 'boosted', 'param': 'depth', 'v': '3'}} WHEN n_observations < 500 THEN {{'model': 'boosted', 'param': 'depth', 'v': '3,5'}} END,
 CASE WHEN cv > 1 THEN {{'model': 'boosted', 'param': 'rate', 'v': '0.01,0.05'}} WHEN n_observations < 100 THEN {{'model': 'boosted', 'param': 'rate', 'v': '0.1'}} WHEN n_observations < 500 THEN {{'model': 'boosted', 'param': 'rate', 'v': '0.05,0.1'}} END,
 {{'model': 'theta', 'param': 'season_length', 'v': '52'}}, {{'model': 'theta', 'param': 'variant', 'v': CASE WHEN n_observations < 24 THEN 'auto' WHEN n_observations < 52 THEN 'auto,arima' ELSE 'auto,arima,ets,theta' END}},
 {{'model': 'naive', 'param': 'samples', 'v': CASE WHEN has_outliers OR cv > 0.5 THEN '200' ELSE '100' END}}], {NOTNULL})) AS r FROM ch)"""


@query("adv10_candidate_grid", "series:s model:s param:s values:s", f"""
{ctes('weekly')}, {CHARS}, {_GRID} SELECT series, r.model AS model, r.param AS param, r.v AS "values" FROM gd""")
def _(spark, d):
    return A.candidate_grid(chars(spark, d), K).withColumn("values", F.concat_ws(",", "values"))


def _list_sql(model, param, src="gd"):
    """The values of a list as rows: the advised ones, else those the model has itself."""
    own = ",".join(str(v) for v in GR.OPEN_LISTS[model][param])
    return f"(SELECT s.series, unnest(string_split(coalesce(max(r.v) FILTER (r.model = '{model}' AND r.param = '{param}'), '{own}'), ',')) AS v FROM (SELECT DISTINCT series FROM {src}) s JOIN {src} USING (series) GROUP BY s.series)"


def _product_sql(model):
    ps = list(GR.OPEN_LISTS[model])
    return f"SELECT {ps[0]}.series, {', '.join(f'{p}.v AS {p}' for p in ps)} FROM {_list_sql(model, ps[0])} {ps[0]} " + " ".join(f"JOIN {_list_sql(model, p)} {p} USING (series)" for p in ps[1:])


def _expanded(spark, d, model):
    """Candidates of the regions from their own advised lists."""
    df = panel(spark, d, "weekly")
    fixed = {"freq": "weekly"} if model == "structural" else {"period": 52}
    return GR.expand_grid(A.candidate_grid(chars(spark, d), K), K, model, fixed), df


_ORDERS = "NOT (p = '0' AND q = '0')"


@query("adv10_expanded_structural", "series:s growth:s mode:s trend_flexibility:s season_flexibility:s yearly:s weekly:s freq:s", f"""
{ctes('weekly')}, {CHARS}, {_GRID} SELECT *, season_mode AS mode, 'weekly' AS freq FROM ({_product_sql('structural')})""")
def _(spark, d):
    cands, _ = _expanded(spark, d, "structural")
    return cands.select("series", *[F.get_json_object("cand", f"$.{p}").alias(p) for p in ("growth", "mode", "trend_flexibility", "season_flexibility", "yearly", "weekly", "freq")])


@query("adv10_expanded_orders", "series:s p:s d:s q:s", f"""
{ctes('weekly')}, {CHARS}, {_GRID} SELECT * FROM ({_product_sql('arima')}) WHERE {_ORDERS}""")
def _(spark, d):
    cands, _ = _expanded(spark, d, "arima")
    return cands.select("series", *[F.get_json_object("cand", f"$.{p}").alias(p) for p in "pdq"])


@query("adv10_tuned_fits", "series:s n_candidates:i n_rows:i n_failed:i last_ds:d", f"""
{ctes('weekly')}, {CHARS}, {_GRID}, pr AS ({_product_sql('structural')}), l AS (SELECT series, max(ds) AS ds, bool_or(y <= 0) AS low FROM weekly GROUP BY series)
SELECT series, count(*) AS n_candidates, 12 * count(*) FILTER (season_mode = 'additive' OR NOT low) AS n_rows, count(*) FILTER (season_mode <> 'additive' AND low) AS n_failed,
 CASE WHEN count(*) FILTER (season_mode = 'additive' OR NOT low) > 0 THEN any_value(l.ds) + 84 END AS last_ds FROM pr JOIN l USING (series) GROUP BY series""")
def _(spark, d):
    """Each series fitted with its own advised candidates."""
    cands, df = _expanded(spark, d, "structural")
    fc = ST.structural(df, future_frame(df, K, 12, "weekly"), K, cands)
    return fc.groupBy("series").agg(F.count_distinct("cand").alias("n_candidates"), F.count("yhat").alias("n_rows"), F.count("error").alias("n_failed"), F.max("ds").alias("last_ds"))


@query("adv10_profile_grid", "series:s model:s param:s values:s", f"""
{ctes('sales')}, {HOL}, {PROFILE_CTES}, w AS (SELECT *, unique_periods AS n, history_months / 12 AS yrs FROM pf)
SELECT series, model, param, v AS "values" FROM (
 SELECT series, 'structural' AS model, 'trend_flexibility' AS param, CASE WHEN n < 52 THEN '0.01,0.05,0.1' WHEN n < 104 THEN '0.01,0.05,0.1,0.5' ELSE '0.01,0.05,0.1,0.5,1.0' END AS v FROM w
 UNION ALL SELECT series, 'structural', 'season_flexibility', CASE WHEN n < 52 THEN '0.1,1.0' ELSE '0.1,1.0,10.0' END FROM w UNION ALL SELECT series, 'structural', 'yearly', CASE WHEN yrs < 2 THEN 'false' END FROM w
 UNION ALL SELECT series, 'structural', 'weekly', 'false' FROM w UNION ALL SELECT series, 'structural', 'season_mode', CASE WHEN has_trend AND has_seasonality THEN 'multiplicative' WHEN has_seasonality THEN 'additive,multiplicative' ELSE 'additive' END FROM w
 UNION ALL SELECT series, 'arima', unnest(['p', 'q']), CASE WHEN n < 50 THEN '0,1,2' WHEN n < 100 THEN '0,1,2,3' ELSE '0,1,2,3,4' END FROM w UNION ALL SELECT series, 'sarimax', unnest(['p', 'q']), CASE WHEN n < 50 THEN '0,1,2' ELSE '0,1,2,3' END FROM w
 UNION ALL SELECT series, unnest(['arima', 'sarimax']), 'd', CASE WHEN n < 50 THEN '0,1' ELSE '0,1,2' END FROM w
 UNION ALL SELECT series, 'ets', 'trend', CASE WHEN has_trend THEN 'add,mul' ELSE 'none,add' END FROM w UNION ALL SELECT series, 'ets', 'damped', CASE WHEN has_trend THEN 'true,false' ELSE 'false' END FROM w
 UNION ALL SELECT series, 'ets', 'seasonal', CASE WHEN has_seasonality THEN 'add,mul' ELSE 'none' END FROM w
 UNION ALL SELECT series, 'boosted', 'n_trees', CASE WHEN n < 100 THEN '50,100' WHEN n < 500 THEN '100,200' ELSE '100,200,300' END FROM w UNION ALL SELECT series, 'boosted', 'depth', CASE WHEN n < 100 THEN '3' WHEN n < 500 THEN '3,5' ELSE '3,5,7' END FROM w
 UNION ALL SELECT series, 'boosted', 'rate', CASE WHEN data_quality_score < 70 THEN '0.01,0.05' WHEN n < 100 THEN '0.1' WHEN n < 500 THEN '0.05,0.1' ELSE '0.01,0.05,0.1' END FROM w) WHERE v IS NOT NULL""")
def _(spark, d):
    return A.profile_grid(profile(rows_of_profile(spark, d), K, "monthly"), K).withColumn("values", F.concat_ws(",", "values"))


@query("adv11_default_params", "series:s model:s trend:s season_mode:s n_trees:s seasonal:s trend_flexibility:s", f"""
{ctes('sales')}, {HOL}, {PROFILE_CTES}
SELECT series, m AS model, CASE m WHEN 'ets' THEN CASE WHEN has_trend THEN 'add' ELSE 'none' END END AS trend, CASE m WHEN 'structural' THEN 'multiplicative' END AS season_mode, CASE m WHEN 'boosted' THEN CASE WHEN history_months < 24 THEN '100' ELSE '200' END END AS n_trees,
CASE m WHEN 'ets' THEN CASE WHEN has_seasonality THEN 'add' ELSE 'none' END WHEN 'arima' THEN CAST(has_seasonality AS VARCHAR) END AS seasonal, CASE m WHEN 'structural' THEN CASE WHEN has_trend THEN '0.05' ELSE '0.01' END END AS trend_flexibility
FROM pf, (SELECT unnest(['structural', 'arima', 'boosted', 'ets', 'sarimax']) AS m)""")
def _(spark, d):
    out = A.default_params(profile(rows_of_profile(spark, d), K, "monthly"), K)
    return out.select("*", *[F.try_element_at("params", F.lit(k)).alias(k) for k in ("trend", "season_mode", "n_trees", "seasonal", "trend_flexibility")])




def lengths(spark, d):
    df = panel(spark, d, "sales")
    return df.groupBy("region", "segment", F.year("ds").alias("year"), "status").agg(F.count_distinct("ds").alias("n_rows"))


_LENGTHS = "q AS (SELECT region, segment, year(ds) AS year, status, count(DISTINCT ds) AS n_rows FROM sales GROUP BY ALL)"


@query("adv12_eligible_models", "region:s segment:s year:i status:s n_rows:i eligible:a", f"""
{ctes('sales')}, {_LENGTHS} SELECT *, CASE WHEN n_rows < 12 THEN ['structural'] ELSE list_filter([CASE WHEN n_rows >= 12 THEN 'structural' END, CASE WHEN n_rows >= 30 THEN 'boosted' END, CASE WHEN n_rows >= 20 THEN 'arima' END, CASE WHEN n_rows >= 24 THEN 'ets' END,
 CASE WHEN n_rows >= 52 THEN 'sarimax' END, CASE WHEN n_rows >= 20 THEN 'naive' END, CASE WHEN n_rows >= 24 THEN 'theta' END], {NOTNULL}) END AS eligible FROM q""")
def _(spark, d):
    return A.eligible_models(lengths(spark, d))


@query("adv13_preset", "region:s segment:s year:i status:s preset:s budget:s", f"""
{ctes('sales')}, {_LENGTHS} SELECT *, CASE WHEN n_rows < 50 THEN 'fast' WHEN n_rows < 100 THEN 'medium' WHEN n_rows < 200 THEN 'high_quality' ELSE 'best' END AS preset, 'medium' AS budget FROM q""")
def _(spark, d):
    out = A.preset(lengths(spark, d))
    return A.preset(out.withColumnRenamed("preset", "p"), minutes=10).withColumnsRenamed({"preset": "budget"}).withColumnRenamed("p", "preset")


@query("adv14_recommendation_row", "series:s status:s quality:s quality_score:f4 n_years:f1 patterns:a top_models:a", f"""
{ctes('weekly')}, {CHARS}, {REC}, b AS (SELECT series, list(model ORDER BY confidence DESC, list_position(['structural', 'arima', 'sarimax', 'ets', 'boosted', 'theta', 'naive'], model)) AS m FROM recs WHERE recommended GROUP BY series)
SELECT series, CASE WHEN quality IN ('insufficient', 'poor') THEN quality ELSE 'ok' END AS status, quality, quality_score, round(n_years, 1) AS n_years,
list_filter([CASE WHEN trend_type <> 'flat' THEN trend_type || '_trend' END, CASE WHEN seasonality_type <> 'none' THEN seasonality_type || '_seasonality' END], {NOTNULL}) AS patterns, m[1:2] AS top_models FROM ch LEFT JOIN b USING (series)""")
def _(spark, d):
    c = chars(spark, d)
    return A.recommendation_row(c, A.recommend_models(c, K), K)


@query("qlt6_quality_grade", "series:s quality_score:f4 quality:s", f"""
{ctes('monthly')}, {characteristics_sql('monthly', 12, 45)} SELECT * FROM ch""")
def _(spark, d):
    return Q.quality_grade(S.characteristics(panel(spark, d, "monthly"), K, "monthly").drop("quality_score", "quality"))
