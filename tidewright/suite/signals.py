"""Series signals and holiday events."""


from ..operators import calendar as C
from ..operators import events as E
from ..operators import signals as S
from .calendar import HOL
from .panels import ctes, panel
from .registry import query

K = ["series"]
_NUM = "nm AS (SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY series) AS n FROM {src})"


def num(src="weekly"):
    return _NUM.format(src=src)


TREND = """tr AS (SELECT series, count(*) AS n, regr_slope(y, t) AS slope, regr_r2(y, t) AS r2, avg(abs(y)) AS size, stddev_pop(y) AS sd FROM nm GROUP BY series),
trend AS (SELECT *, slope * n / (size + 1e-10) AS relative_slope, CASE WHEN slope * n / (size + 1e-10) > 0.3 THEN 'strong_up' WHEN slope * n / (size + 1e-10) > 0.1 THEN 'moderate_up'
 WHEN slope * n / (size + 1e-10) < -0.3 THEN 'strong_down' WHEN slope * n / (size + 1e-10) < -0.1 THEN 'moderate_down' ELSE 'flat' END AS trend_type, greatest(r2, 0) AS trend_strength, abs(slope) > sd * 0.01 AS has_trend FROM tr)"""


@query("sig1_trend", "series:s n:i slope:f6 relative_slope:f8 trend_type:s trend_strength:f8 has_trend:b", f"""
{ctes('weekly')}, {num()}, {TREND} SELECT * FROM trend""")
def _(spark, d):
    return S.trend(panel(spark, d, "weekly"), K)


def acf_sql(name, lag, denom):
    return f"""c{name} AS (SELECT series, t, n, y - avg(y) OVER (PARTITION BY series) AS c, var_pop(y) OVER (PARTITION BY series) AS v FROM nm),
p{name} AS (SELECT *, c * lag(c, {lag}) OVER (PARTITION BY series ORDER BY t) AS p FROM c{name}),
{name} AS (SELECT series, any_value(n) AS n, sum(p) / ({denom}) AS acf FROM p{name} GROUP BY series)"""


@query("sig2_seasonality", "series:s period:i seasonality_strength:f8 seasonality_type:s", f"""
{ctes('weekly')}, {num()}, {acf_sql('a', 52, '(any_value(n) - 52) * (any_value(v) + 1e-10)')}
SELECT series, 52 AS period, CASE WHEN n >= 104 THEN abs(acf) ELSE 0 END AS seasonality_strength, CASE WHEN n < 104 THEN 'none' WHEN abs(acf) > 0.7 THEN 'strong' WHEN abs(acf) > 0.4 THEN 'moderate' WHEN abs(acf) > 0.2 THEN 'weak' ELSE 'none' END AS seasonality_type FROM a""")
def _(spark, d):
    return S.seasonality(panel(spark, d, "weekly"), K, "weekly")


@query("sig3_circular_acf", "series:s acf:f8 has_seasonality:b", f"""
{ctes('monthly')}, {num('monthly')}, c AS (SELECT series, t, n, y - avg(y) OVER (PARTITION BY series) AS c, var_pop(y) OVER (PARTITION BY series) AS v FROM nm)
SELECT a.series, sum(a.c * b.c) / any_value(a.n) / any_value(a.v) AS acf, sum(a.c * b.c) / any_value(a.n) / any_value(a.v) > 0.3 AS has_seasonality
FROM c a JOIN c b ON a.series = b.series AND b.t = (a.t - 12 + a.n) % a.n GROUP BY a.series HAVING any_value(a.n) > 24""")
def _(spark, d):
    return S.circular_acf(panel(spark, d, "monthly"), K, 12)


@query("sig4_acf1", "series:s acf_lag1:f8 has_autocorrelation:b", f"""
{ctes('weekly')}, {num()}, {acf_sql('a', 1, '(any_value(n) - 1) * (any_value(v) + 1e-10)')} SELECT series, acf AS acf_lag1, abs(acf) > 0.3 AS has_autocorrelation FROM a""")
def _(spark, d):
    return S.acf1(panel(spark, d, "weekly"), K)


def decomp_sql(period):
    h = period // 2
    return f"""d1 AS (SELECT *, (avg(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN {h} PRECEDING AND {h - 1} FOLLOWING)
 + avg(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN {h - 1} PRECEDING AND {h} FOLLOWING)) / 2 AS trend FROM nm),
d2 AS (SELECT *, avg(y - trend) OVER (PARTITION BY series, t % {period}) - avg(y - trend) OVER (PARTITION BY series) AS seasonal FROM d1),
dc AS (SELECT *, y - trend - seasonal AS remainder FROM d2)"""


@query("sig6_decompose", "series:s ds:d trend:f4 seasonal:f6 remainder:f6", f"""
{ctes('weekly')}, {num()}, {decomp_sql(52)} SELECT series, ds, trend, seasonal, remainder FROM dc""")
def _(spark, d):
    return S.decompose(panel(spark, d, "weekly"), K, 52)


STRENGTHS = """st AS (SELECT series, greatest(0, 1 - var_pop(remainder) / var_pop(trend + remainder)) AS trend_strength,
 greatest(0, 1 - var_pop(remainder) / var_pop(seasonal + remainder)) AS seasonal_strength FROM dc GROUP BY series)"""


@query("sig7_strengths", "series:s trend_strength:f8 seasonal_strength:f8", f"""
{ctes('weekly')}, {num()}, {decomp_sql(52)}, {STRENGTHS} SELECT * FROM st""")
def _(spark, d):
    return S.strengths(S.decompose(panel(spark, d, "weekly"), K, 52), K)


ENTROPY = """e0 AS (SELECT series, t, n, y - avg(y) OVER (PARTITION BY series) AS c FROM nm),
e1 AS (SELECT series, n, k, sum(c * cos(2 * pi() * k * t / n)) AS re, sum(c * sin(2 * pi() * k * t / n)) AS im FROM e0, (SELECT unnest(range(1, 5000)) AS k) WHERE k <= n // 2 GROUP BY series, n, k),
e2 AS (SELECT series, n, re * re + im * im AS p, sum(re * re + im * im) OVER (PARTITION BY series) AS tot FROM e1),
en AS (SELECT series, least(1.0, -sum(p / tot * log2(p / tot)) / log2(any_value(n) // 2 + 1)) AS spectral_entropy FROM e2 WHERE p > 0 GROUP BY series)"""


@query("sig8_spectral_entropy", "series:s spectral_entropy:f8", f"""
{ctes('weekly')}, {num()}, {ENTROPY} SELECT * FROM en""")
def _(spark, d):
    return S.spectral_entropy(panel(spark, d, "weekly"), K)


@query("sig9_linearity", "series:s linearity:f8", f"""
{ctes('weekly')}, {num()}, {decomp_sql(52)} SELECT series, greatest(0, regr_r2(trend, t)) AS linearity FROM dc GROUP BY series""")
def _(spark, d):
    return S.linearity(S.decompose(panel(spark, d, "weekly"), K, 52), K)


SPIKE = """s1 AS (SELECT series, n, remainder AS r, sum(remainder) OVER (PARTITION BY series) AS s, sum(remainder * remainder) OVER (PARTITION BY series) AS q FROM dc),
s2 AS (SELECT series, r, greatest(0, (q - r * r) / (n - 1) - ((s - r) / (n - 1)) ** 2) AS loo FROM s1),
sp AS (SELECT series, var_pop(loo) / (var_pop(r) * var_pop(r)) AS spikiness FROM s2 GROUP BY series)"""


@query("sig10_spikiness", "series:s spikiness:f8", f"""
{ctes('weekly')}, {num()}, {decomp_sql(52)}, {SPIKE} SELECT * FROM sp""")
def _(spark, d):
    return S.spikiness(S.decompose(panel(spark, d, "weekly"), K, 52), K)


GROWTH = """g AS (SELECT series, any_value(n) AS n, median(y) FILTER (t < greatest(1, n // 4)) AS f, median(y) FILTER (t >= n - greatest(1, n // 4)) AS l,
 avg(y) FILTER (n - t <= {h}) AS r, avg(y) FILTER (n - t > {h} AND n - t <= {p}) AS p FROM nm GROUP BY series),
gr AS (SELECT series, n, CASE WHEN n < 8 OR f = 0 THEN 0 ELSE (l - f) / abs(f) * 100 END AS total_growth_pct, CASE WHEN n < {p} OR p = 0 THEN 0 ELSE (r - p) / abs(p) * 100 END AS recent_growth_pct FROM g)"""


@query("sig11_growth_rates", "series:s n:i total_growth_pct:f6 recent_growth_pct:f6", f"""
{ctes('weekly')}, {num()}, {GROWTH.format(h=26, p=52)} SELECT * FROM gr""")
def _(spark, d):
    return S.growth_rates(panel(spark, d, "weekly"), K, 52)


def forecastability_sql(period):
    """CTEs from ``nm`` to ``fs``."""
    return f"""{decomp_sql(period)}, {STRENGTHS}, {ENTROPY}, {SPIKE}, {GROWTH.format(h=period // 2, p=period)},
li AS (SELECT series, greatest(0, regr_r2(trend, t)) AS linearity FROM dc GROUP BY series),
rc AS (SELECT series, t, n, remainder - avg(remainder) OVER (PARTITION BY series) AS c, var_pop(remainder) OVER (PARTITION BY series) AS v FROM dc),
rp AS (SELECT *, c * lag(c, 1) OVER (PARTITION BY series ORDER BY t) AS p FROM rc),
ra AS (SELECT series, greatest(-1, least(1, sum(p) / ((any_value(n) - 1) * any_value(v)))) AS acf1_remainder FROM rp GROUP BY series),
mn AS (SELECT series, avg(y) AS mean_y FROM nm GROUP BY series),
f0 AS (SELECT series, gr.n, total_growth_pct, recent_growth_pct, mean_y, CASE WHEN gr.n >= {2 * period} THEN spectral_entropy ELSE 0.8 END AS spectral_entropy, CASE WHEN gr.n >= {2 * period} THEN trend_strength ELSE 0 END AS trend_strength,
 CASE WHEN gr.n >= {2 * period} THEN seasonal_strength ELSE 0 END AS seasonal_strength, CASE WHEN gr.n >= {2 * period} THEN linearity ELSE 0 END AS linearity,
 CASE WHEN gr.n >= {2 * period} THEN spikiness ELSE 1 END AS spikiness, CASE WHEN gr.n >= {2 * period} THEN acf1_remainder ELSE 0 END AS acf1_remainder
 FROM gr JOIN st USING (series) LEFT JOIN en USING (series) LEFT JOIN sp USING (series) JOIN li USING (series) JOIN ra USING (series) JOIN mn USING (series)),
f1 AS (SELECT *, CASE WHEN n >= {2 * period} THEN greatest(0, least(100, 0.3 * (1 - spectral_entropy) * 100 + 0.2 * trend_strength * 100 + 0.2 * seasonal_strength * 100
 + 0.1 * least(100, linearity * 100) + 0.1 * 100 / (1 + spikiness * 50) + 0.1 * greatest(0, (1 - abs(acf1_remainder)) * 100))) ELSE greatest(10, least(30, n / {2.0 * period} * 40)) END AS score FROM f0),
fs AS (SELECT *, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' WHEN score >= 20 THEN 'poor' ELSE 'unforecastable' END AS grade FROM f1)"""


@query("sig12_forecastability", "series:s n:i score:f6 spectral_entropy:f8 trend_strength:f8 seasonal_strength:f8 linearity:f8 spikiness:f8 acf1_remainder:f8 total_growth_pct:f6", f"""
{ctes('weekly')}, {num()}, {forecastability_sql(52)} SELECT * FROM fs""")
def _(spark, d):
    return S.forecastability(panel(spark, d, "weekly"), K, 52)


@query("sig13_grade", "series:s grade:s", f"""
{ctes('monthly')}, {num('monthly')}, {forecastability_sql(12)} SELECT * FROM fs""")
def _(spark, d):
    return S.forecastability(panel(spark, d, "monthly"), K, 12)


@query("sig14_stationarity", "series:s adf_p:f6 kpss_p:f6 adf_stationary:b kpss_stationary:b stationary:b action:s")
def _(spark, d):
    return S.stationarity(panel(spark, d, "weekly"), K)


_RACF = "\n".join(f"SELECT series, n, v, {k} AS lag, sum(c * lagged) / (n * v) AS acf FROM (SELECT series, n, v, c, lag(c, {k}) OVER (PARTITION BY series ORDER BY ds) AS lagged FROM rc) GROUP BY series, n, v"
                  + (" UNION ALL" if k < 10 else "") for k in range(1, 11))


@query("sig15_residual_acf", "series:s n:i lag:i acf:f8 bound:f8 significant:b ljung_box_q:f5 ljung_box_p:f7 is_white_noise:b", f"""
{ctes('resid')}, rc AS (SELECT series, ds, count(*) OVER (PARTITION BY series) AS n, res - avg(res) OVER (PARTITION BY series) AS c, var_pop(res) OVER (PARTITION BY series) AS v FROM resid),
a AS ({_RACF}), q AS (SELECT series, any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)) AS q FROM a GROUP BY series),
t AS (SELECT *, exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24) AS p FROM q)
SELECT a.series, n, lag, acf, 1.959963984540054 / sqrt(n) AS bound, abs(acf) > 1.959963984540054 / sqrt(n) AS significant, q AS ljung_box_q, p AS ljung_box_p, p >= 0.05 AS is_white_noise FROM a JOIN t USING (series)""")
def _(spark, d):
    return S.residual_acf(panel(spark, d, "resid"), K)


def characteristics_sql(src="weekly", p=52, gap=10.5):
    """CTEs from ``nm`` to ``ch``."""
    return f"""{num(src)}, {TREND}, {acf_sql('sa', p, f'(any_value(n) - {p}) * (any_value(v) + 1e-10)')}, {acf_sql('a1', 1, '(any_value(n) - 1) * (any_value(v) + 1e-10)')},
ga AS (SELECT series, ds, ds - lag(ds) OVER (PARTITION BY series ORDER BY ds) AS gap FROM {src}),
fa AS (SELECT series, count(*) AS n_observations, min(ds) AS start_date, max(ds) AS end_date, (max(ds) - min(ds)) / 365.25 AS n_years, count(*) FILTER (gap > {gap}) AS gap_count FROM ga GROUP BY series),
qu AS (SELECT series, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM {src} GROUP BY series),
ds0 AS (SELECT series, avg(y) AS mean, stddev_pop(y) AS std, min(y) AS min, max(y) AS max, stddev_pop(y) / abs(avg(y)) AS cv, bool_or(y < 0) AS has_negative, bool_or(y = 0) AS has_zero,
 count(*) FILTER (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*) AS outlier_pct FROM {src} JOIN qu USING (series) GROUP BY series),
c0 AS (SELECT fa.*, ds0.* EXCLUDE (series), trend_type, trend_strength, a1.acf AS acf_lag1, CASE WHEN n_observations >= {2 * p} THEN abs(sa.acf) ELSE 0 END AS seasonality_strength
 FROM fa JOIN ds0 USING (series) JOIN trend USING (series) JOIN a1 USING (series) LEFT JOIN sa USING (series)),
c1 AS (SELECT *, CASE WHEN seasonality_strength > 0.7 THEN 'strong' WHEN seasonality_strength > 0.4 THEN 'moderate' WHEN seasonality_strength > 0.2 THEN 'weak' ELSE 'none' END AS seasonality_type,
 gap_count > 0 AS has_gaps, outlier_pct > 1 AS has_outliers, abs(acf_lag1) > 0.3 AS has_autocorrelation FROM c0),
c2 AS (SELECT *, greatest(0, least(100, 100 - CASE WHEN n_observations < 12 THEN 50 WHEN n_observations < 24 THEN 30 WHEN n_observations < 52 THEN 15 ELSE 0 END
 - CASE WHEN n_years < 1 THEN 20 WHEN n_years < 2 THEN 10 ELSE 0 END - least(20, gap_count * 2) - CASE WHEN cv > 1 THEN 10 ELSE 0 END
 - CASE WHEN outlier_pct > 5 THEN 15 WHEN outlier_pct > 2 THEN 5 ELSE 0 END + CASE WHEN seasonality_type IN ('strong', 'moderate') THEN 5 ELSE 0 END + CASE WHEN trend_strength > 0.5 THEN 5 ELSE 0 END)) AS quality_score FROM c1),
ch AS (SELECT *, CASE WHEN quality_score >= 80 THEN 'excellent' WHEN quality_score >= 60 THEN 'good' WHEN quality_score >= 40 THEN 'fair' WHEN quality_score >= 20 THEN 'poor' ELSE 'insufficient' END AS quality,
 CASE WHEN has_negative OR has_zero OR trend_type = 'flat' THEN 'additive' WHEN trend_strength > 0.3 AND seasonality_strength > 0.3 THEN 'multiplicative'
  WHEN trend_type IN ('strong_up', 'moderate_up') AND cv > 0.2 THEN 'multiplicative' ELSE 'additive' END AS season_mode,
 list_filter([CASE WHEN n_observations < 52 THEN 'limited_data' END, CASE WHEN n_years < 1 THEN 'short_history' END, CASE WHEN has_gaps THEN 'gaps' END, CASE WHEN has_negative THEN 'negatives' END,
  CASE WHEN outlier_pct > 5 THEN 'many_outliers' END, CASE WHEN cv > 1.5 THEN 'volatile' END], lambda x: x IS NOT NULL) AS warnings FROM c2)"""


@query("sig16_characteristics", "series:s n_observations:i start_date:d end_date:d n_years:f6 gap_count:i mean:f5 std:f5 min:f5 max:f5 cv:f8 trend_type:s trend_strength:f8 seasonality_type:s "
       "seasonality_strength:f8 outlier_pct:f6 has_outliers:b acf_lag1:f8 has_autocorrelation:b quality_score:f4 quality:s warnings:a", f"""
{ctes('weekly')}, {characteristics_sql()} SELECT * FROM ch""")
def _(spark, d):
    return S.characteristics(panel(spark, d, "weekly"), K, "weekly")


@query("sig5_season_mode", "series:s season_mode:s trend_type:s", f"""
{ctes('monthly')}, {characteristics_sql('monthly', 12, 45)} SELECT * FROM ch""")
def _(spark, d):
    return S.characteristics(panel(spark, d, "monthly"), K, "monthly")


# ---- events ------------------------------------------------------------------------------

_MAJOR = "('thanksgiving', 'christmas', 'new_years', 'july4', 'memorial_day', 'labor_day')"


@query("hol11_holiday_coverage", "series:s holiday_coverage:f1 holidays:a", f"""
{ctes('weekly')}, {HOL}, y AS (SELECT series, year(min(ds)) AS y0, year(max(ds)) AS y1 FROM weekly GROUP BY series),
f AS (SELECT DISTINCT w.series, h.holiday, h.year FROM weekly w JOIN y USING (series) JOIN hol h ON h.holiday IN {_MAJOR} AND h.year BETWEEN y0 AND y1 AND abs(w.ds - CAST(date_trunc('week', h.ds) AS DATE)) <= 7),
c AS (SELECT series, holiday, count(*) AS n FROM f GROUP BY ALL) SELECT series, sum(least(n / 2.0, 1)) * 100 / 6 AS holiday_coverage, list_sort(list(holiday)) AS holidays FROM c GROUP BY series""")
def _(spark, d):
    return E.holiday_coverage(panel(spark, d, "weekly"), K, "weekly")


ANOM = f"""{num('spiky')}, {decomp_sql(52)}, an AS (SELECT series, ds, y, y - remainder AS expected, CASE WHEN y - remainder <> 0 THEN remainder / abs(y - remainder) * 100 ELSE 0 END AS deviation_pct
 FROM (SELECT *, stddev_pop(remainder) OVER (PARTITION BY series) AS sd FROM dc) WHERE sd > 0 AND abs(remainder) > 2 * sd)"""
MATCH = f"""{HOL}, ord AS (SELECT ds, year, holiday, CASE holiday WHEN 'new_years' THEN 0 WHEN 'valentines' THEN 1 WHEN 'july4' THEN 2 WHEN 'halloween' THEN 3 WHEN 'christmas_eve' THEN 4 WHEN 'christmas' THEN 5
 WHEN 'new_years_eve' THEN 6 WHEN 'fiscal_q1_end' THEN 7 WHEN 'fiscal_q2_end' THEN 8 WHEN 'fiscal_q3_end' THEN 9 WHEN 'thanksgiving' THEN 10 WHEN 'black_friday' THEN 11 WHEN 'easter' THEN 12 WHEN 'super_bowl' THEN 13
 WHEN 'mothers_day' THEN 14 WHEN 'fathers_day' THEN 15 WHEN 'memorial_day' THEN 16 ELSE 17 END AS o FROM hol WHERE year BETWEEN (SELECT year(min(ds)) FROM spiky) AND (SELECT year(max(ds)) FROM spiky)),
oneday AS (SELECT * FROM ord QUALIFY row_number() OVER (PARTITION BY ds ORDER BY o DESC) = 1),
ma AS (SELECT an.*, h.holiday, h.ds AS holiday_date, abs(an.ds - h.ds) AS distance FROM an LEFT JOIN oneday h ON abs(an.ds - h.ds) <= 4
 QUALIFY row_number() OVER (PARTITION BY an.series, an.ds ORDER BY abs(an.ds - h.ds), h.year, h.o) = 1)"""


@query("hol12_anomalies", "series:s ds:d y:f7 expected:f7 deviation_pct:f6", f"""
{ctes('spiky')}, {ANOM} SELECT * FROM an""")
def _(spark, d):
    return E.anomalies(S.decompose(panel(spark, d, "spiky"), K, 52), K)


def _matched(spark, d):
    df = panel(spark, d, "spiky")
    return E.match_holidays(E.anomalies(S.decompose(df, K, 52), K), C.years_of(df))


@query("jon6_match_holidays", "series:s ds:d deviation_pct:f6 holiday:s holiday_date:d distance:i", f"""
{ctes('spiky')}, {ANOM}, {MATCH} SELECT * FROM ma""")
def _(spark, d):
    return _matched(spark, d)


IMPACT = """iy AS (SELECT series, holiday, year(ds) AS yr, arg_max(deviation_pct, abs(deviation_pct)) AS dev, count(*) AS k FROM ma WHERE holiday IS NOT NULL GROUP BY ALL),
i0 AS (SELECT series, holiday, avg(dev) AS avg_lift_pct, count(*) AS n_years, sum(k) AS n_periods, CASE WHEN count(*) > 1 AND avg(dev) <> 0 THEN greatest(0, 1 - stddev_pop(dev) / abs(avg(dev))) ELSE 0.5 END AS consistency FROM iy GROUP BY ALL),
im AS (SELECT *, CASE WHEN n_years >= 3 AND consistency >= 0.5 THEN 'high' WHEN n_years >= 2 AND consistency >= 0.3 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN avg_lift_pct > 0 THEN 'increase' ELSE 'decrease' END AS direction,
 CASE WHEN abs(avg_lift_pct) > 30 AND consistency > 0.6 THEN 'strong' WHEN abs(avg_lift_pct) > 15 THEN 'moderate' WHEN abs(avg_lift_pct) > 5 THEN 'mild' ELSE 'minimal' END AS effect FROM i0)"""
EVENTS = """ev AS (SELECT series, ds, deviation_pct, CASE WHEN deviation_pct > 0 THEN 'spike' ELSE 'dip' END AS direction, week(ds) AS iso_week,
 count(DISTINCT year(ds)) OVER (PARTITION BY series, week(ds)) > 1 AS is_recurring FROM ma WHERE holiday IS NULL)"""


@query("hol13_holiday_impact", "series:s holiday:s avg_lift_pct:f5 n_years:i n_periods:i consistency:f6 confidence:s direction:s effect:s", f"""
{ctes('spiky')}, {ANOM}, {MATCH}, {IMPACT} SELECT * FROM im""")
def _(spark, d):
    return E.holiday_impact(_matched(spark, d), K)


@query("hol14_unexplained", "series:s ds:d deviation_pct:f6 direction:s iso_week:i is_recurring:b", f"""
{ctes('spiky')}, {ANOM}, {MATCH}, {EVENTS} SELECT * FROM ev""")
def _(spark, d):
    return E.unexplained(_matched(spark, d), K)


@query("hol15_holiday_analysis", "series:s strong:i moderate:i events:i big_events:i recurring:i partial:i advice:a", f"""
{ctes('spiky')}, {ANOM}, {MATCH}, {IMPACT}, {EVENTS},
pt AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series) AS n_all, (sum(y) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - y) / 4 AS sm FROM spiky WINDOW w AS (PARTITION BY series ORDER BY ds)),
pw AS (SELECT series, count(*) AS k FROM pt WHERE i >= 2 AND i < n_all - 2 AND sm > 0 AND y < 0.5 * sm AND (day(ds) <= 10 OR day(ds) >= day(last_day(ds)) - 6) GROUP BY series),
s AS (SELECT series FROM spiky GROUP BY series HAVING count(*) >= 104),
c AS (SELECT series, coalesce((SELECT count(*) FROM im WHERE im.series = s.series AND abs(avg_lift_pct) > 20 AND confidence = 'high'), 0) AS strong,
 coalesce((SELECT count(*) FROM im WHERE im.series = s.series AND abs(avg_lift_pct) > 10 AND abs(avg_lift_pct) <= 20), 0) AS moderate,
 coalesce((SELECT count(*) FROM ev WHERE ev.series = s.series), 0) AS events, coalesce((SELECT count(*) FROM ev WHERE ev.series = s.series AND abs(deviation_pct) > 20), 0) AS big_events,
 coalesce((SELECT count(*) FROM ev WHERE ev.series = s.series AND is_recurring), 0) AS recurring, coalesce((SELECT k FROM pw WHERE pw.series = s.series), 0) AS partial FROM s),
l AS (SELECT *, list_filter([CASE WHEN partial > 0 THEN 'partial_weeks' END, CASE WHEN strong > 0 THEN 'strong_holidays' END, CASE WHEN moderate > 0 THEN 'moderate_holidays' END, CASE WHEN big_events > 0 THEN 'unexplained_events' END,
 CASE WHEN recurring > 0 THEN 'recurring_events' END], lambda x: x IS NOT NULL) AS a FROM c) SELECT *, CASE WHEN len(a) = 0 THEN ['standard'] ELSE a END AS advice FROM l""")
def _(spark, d):
    return E.holiday_analysis(panel(spark, d, "spiky"), K)["advice"]


