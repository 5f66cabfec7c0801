"""Data quality, preparation and profiles."""

from pyspark.sql import functions as F

from ..operators import prep as P
from ..operators import quality as Q
from ..operators import windows as WN
from ..plans.profile import profile
from .calendar import HOL
from .core import TAIL_SQL, split_sql
from .panels import ctes, panel, table
from .registry import query

K = ["series"]


def repair_sql(src, fill="0", keys="series", dup="load_no"):
    """CTEs ending in ``fixed`` (rows after winsorising)."""
    return f"""v0 AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n_rows, count(*) FILTER (y IS NULL) OVER (PARTITION BY {keys}) AS null_count FROM {src}),
v1 AS (SELECT *, null_count / n_rows * 100 AS null_pct, coalesce(y, last_value(y IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY ds, {dup} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {fill}) AS f FROM v0),
v2 AS (SELECT * EXCLUDE (y, f), CASE WHEN null_pct <= 20 THEN f ELSE y END AS y, row_number() OVER (PARTITION BY {keys}, ds ORDER BY {dup} DESC) AS k FROM v1),
v3 AS (SELECT *, count(*) FILTER (k > 1) OVER (PARTITION BY {keys}) AS duplicate_dates FROM v2),
v4 AS (SELECT * FROM v3 WHERE k = 1),
v5 AS (SELECT v4.*, ds - lag(ds) OVER (PARTITION BY {keys} ORDER BY ds) AS gap, q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM v4 JOIN (SELECT {keys}, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM v4 GROUP BY {keys}) USING ({keys})),
v6 AS (SELECT *, count(*) FILTER (y < lo OR y > hi) OVER (PARTITION BY {keys}) AS n_outliers FROM v5),
fixed AS (SELECT * EXCLUDE (y), n_outliers / n_rows * 100 AS outlier_pct, CASE WHEN n_outliers / n_rows * 100 <= 10 THEN least(greatest(y, lo), hi) ELSE y END AS y FROM v6)"""


@query("qlt1_validate_quality", "series:s ds:d y:f5", f"""
{ctes('holey')}, {repair_sql('holey')}, {TAIL_SQL.format(src='fixed')} SELECT series, ds, y FROM tail WHERE NOT is_tail""")
def _(spark, d):
    return Q.validate_quality(panel(spark, d, "holey"), K, "daily", order=["load_no"])[0]


REPORT = """rep AS (SELECT series, max(n_rows) AS n_rows, max(null_count) AS null_count, max(null_pct) AS null_pct, max(duplicate_dates) AS duplicate_dates, max(n_outliers) AS n_outliers, max(outlier_pct) AS outlier_pct,
 count(*) FILTER (gap > {gap}) AS gaps, count(*) FILTER (y < 0) AS n_negative, avg(y) AS mean, stddev_samp(y) AS std, stddev_samp(y) / avg(y) AS cv, max(n_rows) / {cycle}.0 AS cycles, count(*) FILTER (is_tail) AS n_tail FROM tail GROUP BY series),
report AS (SELECT *, n_rows >= {need} AND null_pct <= 20 AS is_valid,
 list_filter([CASE WHEN n_rows < {need} THEN 'insufficient_data' END, CASE WHEN null_pct > 20 THEN 'high_missing' END, CASE WHEN duplicate_dates > 0 THEN 'duplicate_dates' END], lambda x: x IS NOT NULL) AS issues,
 list_filter([CASE WHEN n_rows >= {need} AND n_rows < {want} THEN 'limited_data' END, CASE WHEN null_pct > 5 AND null_pct <= 20 THEN 'moderate_missing' END, CASE WHEN gaps > 0 THEN 'gaps' END, CASE WHEN outlier_pct > 10 THEN 'many_outliers' END, CASE WHEN {some} THEN 'outliers' END,
  CASE WHEN n_negative > 0 THEN 'negatives' END, CASE WHEN cv < 0.01 THEN 'low_variance' END, CASE WHEN cv > 2 THEN 'high_variance' END, CASE WHEN cycles < 2 THEN 'few_cycles' END, CASE WHEN n_tail > 0 THEN 'incomplete_tail' END], lambda x: x IS NOT NULL) AS warnings,
 list_filter([CASE WHEN null_count > 0 AND null_pct <= 20 THEN 'filled' END, CASE WHEN duplicate_dates > 0 THEN 'deduplicated' END, CASE WHEN n_outliers > 0 AND outlier_pct <= 10 THEN 'winsorized' END, CASE WHEN n_tail > 0 THEN 'dropped_tail' END], lambda x: x IS NOT NULL) AS repairs FROM rep)"""
_REP_COLS = ("series:s is_valid:b n_rows:i null_count:i null_pct:f6 duplicate_dates:i n_outliers:i outlier_pct:f6 gaps:i n_negative:i mean:f4 std:f4 cv:f8 cycles:f6 "
             "n_tail:i issues:a warnings:a repairs:a")


@query("qlt1_quality_report", _REP_COLS, f"""
{ctes('holey')}, {repair_sql('holey')}, {TAIL_SQL.format(src='fixed')}, {REPORT.format(gap=2, cycle=7, need=90, want=365, some='false')} SELECT * FROM report""")
def _(spark, d):
    return Q.validate_quality(panel(spark, d, "holey"), K, "daily", order=["load_no"])[1]


_BACK = "first_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds, load_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("qlt2_quality_report_automl", _REP_COLS, f"""
{ctes('holey')}, {repair_sql('holey', _BACK)}, tail AS (SELECT *, false AS is_tail FROM fixed), {REPORT.format(gap=2, cycle=7, need=90, want=365, some='n_outliers > 0 AND outlier_pct <= 10')} SELECT * FROM report""")
def _(spark, d):
    return Q.validate_quality(panel(spark, d, "holey"), K, "daily", order=["load_no"], variant="automl")[1]


@query("qlt3_iqr_outliers", "series:s ds:d y:f7 side:s lower:f4 upper:f4 outlier_pct:f6", f"""
{ctes('spiky')}, q AS (SELECT series, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM spiky GROUP BY series),
b AS (SELECT s.*, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, count(*) OVER (PARTITION BY series) AS n FROM spiky s JOIN q USING (series)),
p AS (SELECT *, count(*) FILTER (y < lower OR y > upper) OVER (PARTITION BY series) / n * 100 AS outlier_pct FROM b)
SELECT *, CASE WHEN y < lower THEN 'low' ELSE 'high' END AS side FROM p WHERE y < lower OR y > upper""")
def _(spark, d):
    return Q.iqr_outliers(panel(spark, d, "spiky"), K, 1.5)


@query("qlt4_quality_summary", "series:s n_rows:i actual_periods:i expected_periods:i gap_count:i missing:i missing_pct:f6 zeros:i mean:f4 std:f4 cv:f8 quick_wins:a", f"""
{ctes('holey')}, a AS (SELECT series, count(*) AS n_rows, count(DISTINCT ds) AS actual_periods, max(ds) - min(ds) + 1 AS expected_periods, count(*) - count(y) AS missing, count(*) FILTER (y = 0) AS zeros, avg(y) AS mean, stddev_samp(y) AS std FROM holey GROUP BY series)
SELECT *, greatest(0, expected_periods - actual_periods) AS gap_count, missing / n_rows * 100 AS missing_pct, std / mean AS cv,
list_filter([CASE WHEN expected_periods > actual_periods THEN 'missing_periods' END, CASE WHEN missing / n_rows > 0.1 THEN 'missing_values' END, CASE WHEN zeros / n_rows > 0.05 THEN 'zero_values' END, CASE WHEN std / mean > 1 THEN 'variability' END], lambda x: x IS NOT NULL) AS quick_wins FROM a""")
def _(spark, d):
    return Q.quality_summary(panel(spark, d, "holey"), K, "daily")


@query("qlt7_slice_quality", "region:s segment:s n_observations:i has_sufficient_history:b missing_pct:f4 gap_count:i anomalous_count:i anomalous_dates:a volume_level:s period_mean:f6 warnings:a", f"""
{ctes('slices')}, q AS (SELECT region, segment, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM slices GROUP BY ALL),
g AS (SELECT s.*, q1, q3, ds - lag(ds) OVER (PARTITION BY region, segment ORDER BY ds) AS gap FROM slices s JOIN q USING (region, segment)),
a AS (SELECT region, segment, count(*) AS n, round(avg(y), 6) AS period_mean, count(*) FILTER (gap > 10.5) AS gap_count, count(*) FILTER (y < q1 - 2 * (q3 - q1) OR y > q3 + 2 * (q3 - q1)) AS bad,
 list(CAST(ds AS VARCHAR) ORDER BY ds) FILTER (y < q1 - 2 * (q3 - q1) OR y > q3 + 2 * (q3 - q1)) AS dates FROM g GROUP BY ALL),
m AS (SELECT list(period_mean ORDER BY period_mean) AS l, count(*) AS c FROM a)
SELECT region, segment, n AS n_observations, n >= 104 AS has_sufficient_history, 0.0 AS missing_pct, gap_count, CASE WHEN n >= 10 THEN bad ELSE 0 END AS anomalous_count, dates[1:10] AS anomalous_dates, period_mean,
CASE WHEN c < 2 THEN 'medium' WHEN period_mean <= l[CAST(floor(c * 0.2) AS BIGINT) + 1] THEN 'very_low' WHEN period_mean <= l[CAST(floor(c * 0.4) AS BIGINT) + 1] THEN 'low'
 WHEN period_mean <= l[CAST(floor(c * 0.6) AS BIGINT) + 1] THEN 'medium' WHEN period_mean <= l[CAST(floor(c * 0.8) AS BIGINT) + 1] THEN 'high' ELSE 'very_high' END AS volume_level,
list_filter([CASE WHEN n < 104 THEN 'insufficient_history' END, CASE WHEN gap_count > 0 THEN 'gaps' END, CASE WHEN bad > n * 0.05 THEN 'anomalous' END], lambda x: x IS NOT NULL) AS warnings FROM a, m""")
def _(spark, d):
    return Q.slice_quality(panel(spark, d, "slices"), ["region", "segment"], "weekly")


@query("qlt8_volume_class", "p_brand:s period_mean:f6 volume_level:s", """
WITH a AS (SELECT p_brand, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 / count(DISTINCT CAST(l_shipdate AS DATE)), 6) AS period_mean FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
m AS (SELECT list(period_mean ORDER BY period_mean) AS l, count(*) AS c FROM a)
SELECT p_brand, period_mean, CASE WHEN period_mean <= l[CAST(floor(c * 0.2) AS BIGINT) + 1] THEN 'very_low' WHEN period_mean <= l[CAST(floor(c * 0.4) AS BIGINT) + 1] THEN 'low'
 WHEN period_mean <= l[CAST(floor(c * 0.6) AS BIGINT) + 1] THEN 'medium' WHEN period_mean <= l[CAST(floor(c * 0.8) AS BIGINT) + 1] THEN 'high' ELSE 'very_high' END AS volume_level FROM a, m""")
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    means = rows.groupBy("p_brand").agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / 1000 / F.count_distinct(F.col("l_shipdate").cast("date"))).alias("period_mean"))
    return Q.volume_class(means, ["p_brand"])


_COVS = "SELECT y, disc, qty, y * 2 + 5 AS twin, CASE WHEN series = 'A' THEN y + qty * 3 ELSE y - qty END AS mix, CAST(promo AS DOUBLE) AS promo FROM ship"


@query("qlt9_leaky_covariates", "column:s correlation:f6 is_leaky:b", f"""
{ctes('ship')}, c AS ({_COVS}), u AS (SELECT 'disc' AS c, corr(y, disc) AS r FROM c UNION ALL SELECT 'qty', corr(y, qty) FROM c UNION ALL SELECT 'twin', corr(y, twin) FROM c UNION ALL SELECT 'mix', corr(y, mix) FROM c UNION ALL SELECT 'promo', corr(y, promo) FROM c)
SELECT c AS "column", r AS correlation, abs(r) >= 0.9 AS is_leaky FROM u WHERE abs(r) >= 0.7""")
def _(spark, d):
    return Q.leaky_covariates(spark.sql(_COVS.replace("ship", "{ship}"), ship=panel(spark, d, "ship")), "y", ["disc", "qty", "twin", "mix", "promo"])


@query("qlt10_leak_risk", "column:s corr:f6 risk:s reasons:a", f"""
{ctes('ship')}, u AS (SELECT 'qty' AS c, corr(y, qty) AS r FROM ship UNION ALL SELECT 'lag_0', corr(y, disc) FROM ship UNION ALL SELECT 'next_disc', corr(y, disc) FROM ship UNION ALL SELECT 'disc', corr(y, disc) FROM ship)
SELECT c AS "column", r AS corr, CASE WHEN abs(r) > 0.95 OR c = 'lag_0' THEN 'high' WHEN abs(r) > 0.85 OR c = 'next_disc' THEN 'medium' ELSE 'low' END AS risk,
list_filter([CASE WHEN abs(r) > 0.95 THEN 'very_high_correlation' END, CASE WHEN abs(r) > 0.85 AND abs(r) <= 0.95 THEN 'high_correlation' END, CASE WHEN c = 'lag_0' THEN 'lag_below_one' END, CASE WHEN c = 'next_disc' THEN 'future_name' END], lambda x: x IS NOT NULL) AS reasons FROM u""")
def _(spark, d):
    df = panel(spark, d, "ship").select("y", "qty", F.col("disc").alias("lag_0"), F.col("disc").alias("next_disc"), "disc")
    return Q.leak_risk(df, "y", ["qty", "lag_0", "next_disc", "disc"])


@query("qlt11_check_split", "series:s train_end:d test_start:d n_overlap:i first_overlap:d gap_days:i is_valid:b violations:a", f"""
{ctes('weekly')}, {split_sql('weekly', 'series', 12)}, te AS (SELECT series, ds FROM split WHERE split <> 'train' UNION SELECT series, ds FROM split WHERE split = 'train' AND series = 'ASIA' AND year(ds) = 1999), tr AS (SELECT series, ds FROM split WHERE split = 'train'),
a AS (SELECT series, max(ds) AS train_end FROM tr GROUP BY series), b AS (SELECT series, min(ds) AS test_start FROM te GROUP BY series), o AS (SELECT tr.series, count(*) AS k, min(tr.ds) AS f FROM tr JOIN te USING (series, ds) GROUP BY tr.series)
SELECT series, train_end, test_start, coalesce(k, 0) AS n_overlap, f AS first_overlap, test_start - train_end AS gap_days, k IS NULL AND test_start > train_end AS is_valid,
list_filter([CASE WHEN k > 0 THEN 'overlap' END, CASE WHEN test_start <= train_end THEN 'test_not_after_train' END], lambda x: x IS NOT NULL) AS violations FROM a JOIN b USING (series) LEFT JOIN o USING (series)""")
def _(spark, d):
    df = WN.split_series(panel(spark, d, "weekly"), K, 12)
    return Q.check_split(df.where("split = 'train'"), df.where("split <> 'train' OR (series = 'ASIA' AND year(ds) = 1999)"), K)


_FUT = """SELECT series, ds, CASE WHEN ds > DATE '2001-06-01' OR (series = 'N' AND ds = DATE '1999-01-04') THEN NULL ELSE y END AS y,
CASE WHEN ds > DATE '2001-09-01' THEN disc * 20 WHEN ds > DATE '2001-07-15' AND series = 'R' THEN NULL ELSE disc END AS disc, qty FROM {ship}
WHERE NOT (ds > DATE '2001-07-01' AND ds < DATE '2001-08-20' AND series = 'A')"""


@query("qlt12_future_rows", "series:s n_future:i future_start:d future_end:d n_interspersed:i n_large_gaps:i is_valid:b issues:a", f"""
{ctes('ship')}, d AS ({_FUT.replace('{ship}', 'ship')}), f AS (SELECT *, y IS NULL AND (disc IS NOT NULL OR qty IS NOT NULL) AS fut FROM d),
h AS (SELECT series, max(ds) AS last_h, avg(disc) AS md, stddev_samp(disc) AS sd, avg(qty) AS mq, stddev_samp(qty) AS sq FROM f WHERE NOT fut GROUP BY series),
g AS (SELECT f.*, h.* EXCLUDE (series), ds - lag(ds) OVER (PARTITION BY f.series ORDER BY ds) AS gap FROM f JOIN h USING (series) WHERE fut), mg AS (SELECT series, median(gap) AS mgap FROM g GROUP BY series),
a AS (SELECT g.series, count(*) AS n, min(ds) AS s, max(ds) AS e, any_value(last_h) AS last_h, count(*) FILTER (ds < last_h) AS ni, count(*) FILTER (gap > 3 * mgap) AS ng, count(*) - count(disc) AS zd, count(*) - count(qty) AS zq,
 count(*) FILTER (abs(disc - md) > 5 * sd) AS xd, count(*) FILTER (abs(qty - mq) > 5 * sq) AS xq FROM g JOIN mg USING (series) GROUP BY g.series)
SELECT series, n AS n_future, s AS future_start, e AS future_end, ni AS n_interspersed, ng AS n_large_gaps, ni = 0 AS is_valid,
list_filter([CASE WHEN ni > 0 THEN 'interspersed' END, CASE WHEN ng > 0 THEN 'large_gaps' END, CASE WHEN zd > 0 AND zd < n THEN 'partial_disc' END, CASE WHEN zq > 0 AND zq < n THEN 'partial_qty' END,
 CASE WHEN xd > 0 THEN 'extreme_disc' END, CASE WHEN xq > 0 THEN 'extreme_qty' END, CASE WHEN e - last_h > 730 THEN 'far_ahead' END], lambda x: x IS NOT NULL) AS issues FROM a""")
def _(spark, d):
    return Q.future_rows(spark.sql(_FUT, ship=panel(spark, d, "ship")), K, ["disc", "qty"])


@query("qlt13_align_weeks", "series:s ds_raw:d ds:d was_off:b off_pct:f6 y:f5", f"""
{ctes('weekly')}, w AS (SELECT series, ds + CASE day(ds) % 6 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 0 END AS ds, y FROM weekly)
SELECT series, ds AS ds_raw, CASE WHEN (8 - isodow(ds)) % 7 <= 7 - (8 - isodow(ds)) % 7 THEN ds + CAST((8 - isodow(ds)) % 7 AS INTEGER) ELSE ds - CAST(7 - (8 - isodow(ds)) % 7 AS INTEGER) END AS ds,
isodow(ds) <> 1 AS was_off, count(*) FILTER (isodow(ds) <> 1) OVER (PARTITION BY series) / count(*) OVER (PARTITION BY series) * 100 AS off_pct, y FROM w""")
def _(spark, d):
    m = F.dayofmonth("ds") % 6
    return Q.align_weeks(panel(spark, d, "weekly").withColumn("ds", F.date_add("ds", F.when(m == 0, 2).when(m == 1, 5).otherwise(0))), K)


@query("qlt14_lag_sufficiency", "region:s segment:s n_rows:i can_add_yoy_lag:b can_add_seasonal:b recommended_min_rows:i seasonal_period:i", f"""
{ctes('slices')} SELECT region, segment, count(*) AS n_rows, count(*) >= 60 AS can_add_yoy_lag, count(*) >= 104 AS can_add_seasonal, 60 AS recommended_min_rows, 52 AS seasonal_period FROM slices GROUP BY ALL""")
def _(spark, d):
    return Q.lag_sufficiency(panel(spark, d, "slices"), ["region", "segment"], "weekly")


@query("qlt15_fingerprint", "n_rows:i hash:s", """
WITH h AS (SELECT CAST('0x' || left(sha256(concat_ws(chr(31), c_mktsegment, c_custkey, c_name, c_nationkey)), 15) AS BIGINT) AS h FROM (SELECT c_mktsegment AS a, * FROM customer)),
a AS (SELECT count(*) AS n, sum(CAST(h AS DECIMAL(38,0))) AS s, bit_xor(h) AS x FROM h) SELECT n AS n_rows, left(sha256(n || ':' || s || ':' || x), 16) AS hash FROM a""")
def _(spark, d):
    return Q.fingerprint(table(spark, d, "customer").select(F.col("c_custkey").alias("b"), F.col("c_name").alias("c"), F.col("c_nationkey").alias("d"), F.col("c_mktsegment").alias("a")))


@query("qlt15_verify", "n_rows:i is_intact:b", "SELECT count(*) AS n_rows, true AS is_intact FROM part")
def _(spark, d):
    df = table(spark, d, "part")
    return Q.verify(df.repartition(5), Q.fingerprint(df).first()["hash"])


def _profile_sql():
    return f"""b AS (SELECT series, count(*) AS row_count, min(ds) AS s, max(ds) AS e, count(DISTINCT ds) AS unique_periods, count(*) - count(y) AS missing_values, round((max(ds) - min(ds)) / 30.44, 1) AS history_months,
 count(*) > count(DISTINCT ds) AS has_multiple_slices, count(*) // count(DISTINCT ds) AS slice_count FROM rws GROUP BY series),
p AS (SELECT series, ds, sum(y) AS y FROM rws GROUP BY ALL), nm AS (SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY series) AS n FROM p WHERE y IS NOT NULL),
q AS (SELECT series, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM nm GROUP BY series),
sh AS (SELECT series, count(*) FILTER (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) AS n_outliers, abs(regr_slope(y, t)) > stddev_pop(y) * 0.01 AS has_trend FROM nm JOIN q USING (series) GROUP BY series),
c AS (SELECT series, t, n, y - avg(y) OVER (PARTITION BY series) AS c, var_pop(y) OVER (PARTITION BY series) AS v FROM nm),
se AS (SELECT a.series, sum(a.c * z.c) / any_value(a.n) / any_value(a.v) > 0.3 AS has_seasonality FROM c a JOIN c z ON a.series = z.series AND z.t = (a.t - 12 + a.n) % a.n GROUP BY a.series HAVING any_value(a.n) > 24),
mi AS (SELECT series, count(*) AS k FROM (SELECT series, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS DATE) AS ds FROM p GROUP BY series EXCEPT SELECT series, ds FROM p) GROUP BY series),
cv AS (SELECT series, sum(least(k / 2.0, 1)) * 100 / 6 AS holiday_coverage FROM (SELECT p.series, holiday, count(DISTINCT hol.year) AS k FROM p JOIN hol ON hol.ds = p.ds WHERE holiday IN ('thanksgiving', 'christmas', 'new_years', 'july4', 'memorial_day', 'labor_day') GROUP BY ALL) GROUP BY series),
dd AS (SELECT series, ds, sum(y) AS v, count(y) AS c FROM rws GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS rn FROM dd),
fi AS (SELECT series, coalesce((1 - max(v) FILTER (rn = 1) / median(v) FILTER (rn > 1)) * 100 > 50 OR (1 - max(c) FILTER (rn = 1) / median(c) FILTER (rn > 1)) * 100 > 30 OR (1 - max(v) FILTER (rn = 1) / max(v) FILTER (rn = 2)) * 100 > 70, false) AS inc FROM rk GROUP BY series),
j AS (SELECT b.*, sh.* EXCLUDE (series), coalesce(has_seasonality, false) AS has_seasonality, coalesce(mi.k, 0) AS n_missing_periods, coalesce(holiday_coverage, 0) AS holiday_coverage, inc AS has_incomplete_final_period
 FROM b JOIN sh USING (series) LEFT JOIN se USING (series) LEFT JOIN mi USING (series) LEFT JOIN cv USING (series) JOIN fi USING (series)),
sc AS (SELECT *, 100 - least(missing_values / row_count * 100, 30) - least(n_missing_periods / (unique_periods + n_missing_periods) * 150, 30) - least(n_outliers / row_count * 50, 10) AS s0 FROM j),
s1 AS (SELECT *, round(greatest(0, CASE WHEN unique_periods >= 104 THEN least(100, s0 + 10) WHEN unique_periods >= 52 THEN least(100, s0 + 5) ELSE s0 END), 1) AS data_quality_score FROM sc),
pf AS (SELECT *, list_filter([CASE WHEN history_months < 12 THEN 'high:history' END, CASE WHEN history_months >= 12 AND history_months < 24 THEN 'medium:history' END, CASE WHEN round(holiday_coverage, 1) < 50 THEN 'medium:holiday_coverage' END,
 CASE WHEN missing_values > 0 AND missing_values < 5 THEN 'low:missing_values' END, CASE WHEN missing_values >= 5 THEN 'medium:missing_values' END, CASE WHEN n_missing_periods > 0 AND n_missing_periods < 5 THEN 'low:missing_periods' END,
 CASE WHEN n_missing_periods BETWEEN 5 AND 9 THEN 'medium:missing_periods' END, CASE WHEN n_missing_periods >= 10 THEN 'high:missing_periods' END, CASE WHEN data_quality_score < 70 THEN 'high:quality_score' END], lambda x: x IS NOT NULL) AS warnings FROM s1)"""


_ROWS = """SELECT segment AS series, CAST(date_trunc('month', ds) AS DATE) AS ds, CASE WHEN id % 211 = 0 THEN NULL ELSE CAST(y AS DECIMAL(18,2)) / 1000 END AS y FROM {sales} WHERE NOT (segment = 'MACHINERY' AND year(ds) = 1998 AND month(ds) > 4)"""


def rows_of_profile(spark, d):
    return spark.sql(_ROWS, sales=panel(spark, d, "sales")).withColumn("y", F.col("y").cast("double"))


PROFILE_CTES = f"rws AS (SELECT series, ds, CAST(y AS DOUBLE) AS y FROM ({_ROWS.replace('{sales}', 'sales')})), {_profile_sql()}"


@query("qlt17_profile", "series:s row_count:i unique_periods:i history_months:f1 missing_values:i has_multiple_slices:b slice_count:i n_outliers:i has_trend:b has_seasonality:b n_missing_periods:i "
       "has_incomplete_final_period:b holiday_coverage:f1 data_quality_score:f1 warnings:a", f"""
{ctes('sales')}, {HOL}, {PROFILE_CTES} SELECT * FROM pf""")
def _(spark, d):
    return profile(rows_of_profile(spark, d), K, "monthly")


@query("qlt5_quality_score", "series:s data_quality_score:f1", f"""
{ctes('sales')}, {HOL}, {PROFILE_CTES} SELECT series, data_quality_score FROM pf""")
def _(spark, d):
    return Q.quality_score(profile(rows_of_profile(spark, d), K, "monthly").drop("data_quality_score"))


@query("qlt16_profile_warnings", "series:s warnings:a", f"""
{ctes('sales')}, {HOL}, {PROFILE_CTES} SELECT series, warnings FROM pf""")
def _(spark, d):
    return Q.profile_warnings(profile(rows_of_profile(spark, d), K, "monthly").drop("warnings"))


# ---- preparation -------------------------------------------------------------------------

_PREP = f"""p0 AS (SELECT ds, region AS series, sum(CAST(y AS DECIMAL(18,2))) AS yd, sum(id % 3) AS load, max(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS flag FROM sales WHERE segment IN ('BUILDING', 'MACHINERY') GROUP BY ALL),
p1 AS (SELECT ds, series, CAST(yd AS DOUBLE) AS y, 1 AS load_no, load, flag FROM p0), {TAIL_SQL.format(src='p1')}"""


@query("prp1_prepare", "series:s ds:d y:f5 load:i flag:i", f"""
{ctes('sales')}, {_PREP}, src AS (SELECT series, ds, y, load_no FROM tail WHERE NOT is_tail), {repair_sql('src')}, {TAIL_SQL.format(src='fixed').replace('t AS (', 't2 AS (').replace('FROM t WHERE', 'FROM t2 WHERE').replace('m AS (', 'm2 AS (').replace('l AS (SELECT t.*', 'l2 AS (SELECT t2.*').replace('FROM t JOIN m USING', 'FROM t2 JOIN m2 USING').replace('tail AS (', 'tail2 AS (').replace('FROM l)', 'FROM l2)')}
SELECT tail2.series, tail2.ds, tail2.y, p1.load, p1.flag FROM tail2 JOIN p1 USING (series, ds) WHERE NOT is_tail""")
def _(spark, d):
    df = panel(spark, d, "sales").select(F.col("region").alias("series"), "segment", "ds", "y", (F.col("id") % 3).alias("load"), (F.col("status") == "F").cast("int").alias("flag"))
    return P.prepare(df, "ds", "y", K, "sum", {"segment": ["BUILDING", "MACHINERY"]}, "daily", ["load", "flag"])[0]


@query("prp2_log_transform", "series:s ds:d y:f8 log_applied:b", f"""
{ctes('weekly')} SELECT series, ds, ln(1 + y) AS y, true AS log_applied FROM weekly""")
def _(spark, d):
    return P.log_transform(panel(spark, d, "weekly"), K, "always")


@query("prp2_log_auto", "series:s ds:d y:f8 log_applied:b", f"""
{ctes('weekly')}, g AS (SELECT series, ds, CASE WHEN series IN ('ASIA', 'EUROPE') THEN exp((ds - DATE '1995-01-01') / 300.0) * y ELSE y END AS y FROM weekly), t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY series) AS n FROM g),
a AS (SELECT series, any_value(n) AS n, avg(y) FILTER (t >= n - least(n, 52)) AS r, avg(y) FILTER (t < least(n, 52)) AS e, avg(y) FILTER (t < n // 2) AS f, avg(y) FILTER (t >= n - n // 2) AS s FROM t GROUP BY series),
w AS (SELECT series, n >= 52 AND greatest(r, e) / greatest(least(r, e), 1) > 10 AND (s - f) / f * 100 > 500 AS log_applied FROM a) SELECT series, ds, CASE WHEN log_applied THEN ln(1 + y) ELSE y END AS y, log_applied FROM g JOIN w USING (series)""")
def _(spark, d):
    grow = F.exp(F.datediff("ds", F.lit("1995-01-01").cast("date")) / 300.0) * F.col("y")
    return P.log_transform(panel(spark, d, "weekly").withColumn("y", F.when(F.col("series").isin("ASIA", "EUROPE"), grow).otherwise(F.col("y"))), K, "auto")


@query("prp2_inverse_log", "series:s model:s ds:d y:f5 yhat:f5", f"""
{ctes('models')} SELECT series, model, ds, y, yhat FROM models""")
def _(spark, d):
    df = panel(spark, d, "models").withColumns({"log_applied": F.col("series") > "B", "y": F.col("y"), "yhat": F.col("yhat")})
    to_log = [F.when(F.col("log_applied"), F.log1p(c)).otherwise(F.col(c)).alias(c) for c in ("y", "yhat")]
    return P.inverse_log(df.select("series", "model", "ds", "log_applied", *to_log))


@query("prp3_fill_lags_from_train", "series:s ds:d split:s lag_52:f6", f"""
{ctes('weekly')}, {split_sql('weekly', 'series', 12)}, l AS (SELECT *, lag(y, 52) OVER (PARTITION BY series ORDER BY ds) AS lag_52 FROM split)
SELECT series, ds, split, coalesce(lag_52, avg(lag_52) FILTER (split = 'train') OVER (PARTITION BY series), 0) AS lag_52 FROM l""")
def _(spark, d):
    return P.fill_lags_from_train(WN.add_lags(WN.split_series(panel(spark, d, "weekly"), K, 12), K, "weekly"), K, ["lag_52"])


@query("prp4_admit_regressors", "series:s regressor:s filled_share:f6 admitted:b", f"""
{ctes('ship')}, s0 AS (SELECT series, ds, y, disc, CASE WHEN promo = 1 THEN qty END AS part FROM ship), {split_sql('s0', 'series', 12)}
SELECT series, 'disc' AS regressor, count(disc) / count(*) AS filled_share, count(disc) / count(*) >= 0.5 AS admitted FROM split WHERE split = 'train' GROUP BY series
UNION ALL SELECT series, 'part', count(part) / count(*), count(part) / count(*) >= 0.5 FROM split WHERE split = 'train' GROUP BY series""")
def _(spark, d):
    df = panel(spark, d, "ship").withColumn("part", F.when(F.col("promo") == 1, F.col("qty")))
    return P.admit_regressors(WN.split_series(df, K, 12), K, ["disc", "part"])


@query("prp5_split_future", "series:s ds:d y:f5 disc:f8 part:s", f"""
{ctes('ship')}, d AS ({_FUT.replace('{ship}', 'ship')}) SELECT series, ds, y, disc, CASE WHEN y IS NULL AND (disc IS NOT NULL OR qty IS NOT NULL) THEN 'future' ELSE 'history' END AS part FROM d""")
def _(spark, d):
    hist, fut = P.split_future(spark.sql(_FUT, ship=panel(spark, d, "ship")), ["disc", "qty"])
    return hist.withColumn("part", F.lit("history")).unionByName(fut.withColumn("part", F.lit("future")))
