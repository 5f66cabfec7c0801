"""Filters, aggregations, windows, orderings and set operations."""

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import filters as FL
from ..operators import setops as S
from ..operators import quality as Q
from ..operators import windows as WN
from .panels import ctes, panel
from .registry import query

K = ["series"]

# ---- filters -----------------------------------------------------------------------------


@query("flt1_filter_dimensions", "id:i region:s segment:s y:f2", f"""
{ctes('sales')} SELECT id, region, segment, y FROM sales WHERE region = 'ASIA' AND segment IN ('MACHINERY', 'BUILDING')""")
def _(spark, d):
    return FL.filter_dimensions(panel(spark, d, "sales"), {"region": "ASIA", "segment": ["MACHINERY", "BUILDING"], "none": 1})


@query("flt2_filter_categories", "series:s ds:d y:f4 load_no:i", f"""
{ctes('holey')} SELECT * FROM holey WHERE y IS NOT NULL AND CAST(load_no AS VARCHAR) = '1'""")
def _(spark, d):
    return FL.filter_categories(panel(spark, d, "holey"), {"load_no": "1", "series": ""}, "y")


@query("flt3_filter_dates", "series:s ds:d y:f2", f"""
{ctes('daily')} SELECT series, ds, y FROM daily WHERE ds BETWEEN DATE '1996-03-01' AND DATE '1998-06-30'""")
def _(spark, d):
    return FL.filter_dates(panel(spark, d, "daily"), "ds", "1996-03-01", "1998-06-30")


@query("flt4_to_series", "series:s ds:d y:f5 disc:f6 qty:f6 absent:f2", f"""
{ctes('ship')} SELECT series, ds, y, disc, qty, NULL AS absent FROM ship""")
def _(spark, d):
    raw = panel(spark, d, "ship").withColumn("y", F.concat(F.lit("$"), F.col("y").cast("decimal(20,5)").cast("string")))
    return FL.to_series(raw, K, "ds", "y", ["disc", "qty", "absent", "y"])


@query("flt6_select_segments", "region:s segment:s ds:d y:f5", f"""
{ctes('slices')} SELECT * FROM slices WHERE (region, segment) IN (SELECT region, segment FROM sales GROUP BY ALL HAVING count(*) >= 50)
AND segment NOT IN ('FURNITURE')""")
def _(spark, d):
    counts = panel(spark, d, "sales").groupBy("region", "segment").count()
    return FL.select_segments(panel(spark, d, "slices"), ["region", "segment"], include=counts.where("count >= 50"),
                              exclude=counts.where("segment = 'FURNITURE'"))


@query("flt7_trim_window", "series:s ds:d y:f2", f"""
{ctes('daily')} SELECT series, ds, y FROM daily QUALIFY row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 104""")
def _(spark, d):
    return FL.trim_window(panel(spark, d, "daily"), K, 104)


@query("flt8_min_rows", "region:s segment:s ds:d y:f5", f"""
{ctes('slices')} SELECT * FROM slices QUALIFY count(*) OVER (PARTITION BY region, segment) >= 250""")
def _(spark, d):
    return FL.min_rows(panel(spark, d, "slices"), ["region", "segment"], 250)


@query("flt9_filter_status", "id:i status:s y:f2", f"""
{ctes('sales')} SELECT id, status, y FROM sales WHERE status IN ('P', 'F')""")
def _(spark, d):
    return FL.filter_status(panel(spark, d, "sales"), ["P", "F"])


@query("flt10_validate_input", "n_rows:i missing_target:i invalid_dates:i blank_rows:i codes:a", f"""
{ctes('messy')}, f AS (SELECT count(*) n_rows, count(*) FILTER (num_text IN ('n/a', '') OR num_text LIKE '%EUR' OR num_text LIKE '(%'
  OR num_text LIKE '%\\%' ESCAPE '\\' OR num_text LIKE '%.%.%') missing_target,
  count(*) FILTER (id % 12 = 11) invalid_dates,
  count(*) FILTER (num_text = '' OR trim(date_text) = '' OR trim(str_text) = '') blank_rows FROM messy)
SELECT *, list_filter([CASE WHEN missing_target > 0 THEN 'missing_target' END, CASE WHEN invalid_dates > 0 THEN 'invalid_dates' END,
  CASE WHEN n_rows <= 12 THEN 'insufficient_rows' END, CASE WHEN blank_rows > n_rows * 0.1 THEN 'many_blanks' END], lambda x: x IS NOT NULL) AS codes FROM f""")
def _(spark, d):
    return FL.validate_input(panel(spark, d, "messy").select("num_text", "date_text", "str_text"), "date_text", "num_text", 12)


# ---- aggregations ------------------------------------------------------------------------


@query("agg1_aggregate_series", "ds:d region:s y:f2 id:i", f"""
{ctes('sales')} SELECT ds, region, sum(y) AS y, max(id) AS id FROM sales GROUP BY ds, region""")
def _(spark, d):
    return A.aggregate_series(panel(spark, d, "sales"), "ds", "y", ["region"], "sum", {"id": "max"})


@query("agg1_aggregate_median", "ds:d priority:s y:f5 id:f4", f"""
{ctes('sales')} SELECT ds, priority, median(y) AS y, avg(id) AS id FROM sales GROUP BY ds, priority""")
def _(spark, d):
    return A.aggregate_series(panel(spark, d, "sales"), "ds", "y", ["priority"], "median", {"id": "mean"})


@query("agg1_aggregate_total", "ds:d y:f2", f"""
{ctes('sales')} SELECT ds, min(y) AS y FROM sales GROUP BY ds""")
def _(spark, d):
    return A.aggregate_series(panel(spark, d, "sales"), "ds", "y", how="min")


@query("agg2_covariate_aggs", "series:s ds:d y:f5 disc:f6 qty:f6 promo:i", f"""
{ctes('ship')} SELECT series, last_day(ds) AS ds, sum(y) AS y, avg(disc) AS disc, avg(qty) AS qty, max(promo) AS promo FROM ship
GROUP BY series, last_day(ds)""")
def _(spark, d):
    df = panel(spark, d, "ship")
    return A.resample(df, K, "monthly", {"y": "sum", **A.covariate_aggs(df, ["disc", "qty", "promo"], "mean")}, "weekly")


@query("agg3_resample_weekly", "series:s ds:d y:f2 n:i", f"""
{ctes('daily')}, w AS (SELECT series, CAST(date_trunc('week', ds) AS DATE) + 6 AS ds, sum(y) AS y, sum(n) AS n FROM daily GROUP BY ALL),
sp AS (SELECT series, unnest(generate_series(min(ds), max(ds), INTERVAL 7 DAY)) AS ds FROM w GROUP BY series)
SELECT series, sp.ds, coalesce(y, 0) AS y, coalesce(n, 0) AS n FROM sp LEFT JOIN w USING (series, ds)""")
def _(spark, d):
    return A.resample(panel(spark, d, "daily"), K, "weekly", {"y": "sum", "n": "sum"})


@query("agg3_resample_monthly_last", "series:s load_no:i ds:d y:f2 n:i", f"""
{ctes('holey')}
SELECT series, load_no, last_day(ds) AS ds, arg_max(y, ds) FILTER (y IS NOT NULL) AS y, count(*) AS n FROM holey GROUP BY series, load_no, last_day(ds) HAVING count(y) > 0""")
def _(spark, d):
    df = panel(spark, d, "holey").withColumn("n", F.lit(1))
    return A.resample(df, [*K, "load_no"], "monthly", {"y": "last", "n": "sum"})


@query("agg4_rollup_named", "series:s ds:d avg_price:f6", f"""
{ctes('sales')}, dd AS (SELECT priority AS series, ds, avg(y) AS v FROM sales GROUP BY ALL)
SELECT series, CAST(date_trunc('week', ds) AS DATE) AS ds, avg(v) AS avg_price FROM dd GROUP BY ALL""")
def _(spark, d):
    df = panel(spark, d, "sales").withColumnsRenamed({"priority": "series", "y": "avg_price"})
    return A.rollup_named(df, K, "ds", "avg_price", "weekly")


@query("agg4_rollup_named_sum", "series:s ds:d revenue:f2", f"""
{ctes('sales')} SELECT priority AS series, CAST(date_trunc('month', ds) AS DATE) AS ds, sum(y) AS revenue FROM sales GROUP BY ALL""")
def _(spark, d):
    df = panel(spark, d, "sales").withColumnsRenamed({"priority": "series", "y": "revenue"})
    return A.rollup_named(df, K, "ds", "revenue", "monthly")


@query("agg5_resample_anchored", "series:s ds:d y:f2 n:f6", f"""
{ctes('daily')} SELECT series, CAST(date_trunc('week', ds - 1) AS DATE) + 7 AS ds, sum(y) AS y, avg(n) AS n FROM daily GROUP BY ALL""")
def _(spark, d):
    return A.resample(panel(spark, d, "daily"), K, "W-MON", {"y": "sum", "n": "mean"})


@query("agg6_list_segments", "segment:s n_rows:i", f"""
{ctes('sales')} SELECT 'region=' || region || ' | segment=' || segment AS segment, count(*) AS n_rows FROM sales GROUP BY region, sales.segment""")
def _(spark, d):
    return A.list_segments(panel(spark, d, "sales"), ["region", "segment"]).toDF("segment", "r", "s", "n_rows")


@query("agg7_slice_stats", "slice:s n_rows:i target_sum:f2 target_avg:f6", f"""
{ctes('sales')}, u AS (SELECT coalesce(nullif(CASE WHEN region = 'ASIA' THEN '' ELSE region END, ''), 'Unknown') || ' | ' || status AS slice, y FROM sales)
SELECT slice, count(*) AS n_rows, sum(y) AS target_sum, avg(y) AS target_avg FROM u GROUP BY slice""")
def _(spark, d):
    df = panel(spark, d, "sales").withColumn("region", F.when(F.col("region") == "ASIA", "").otherwise(F.col("region")))
    return A.slice_stats(df, ["region", "status"], "y")


@query("agg8_sibling_rollup", "ds:d region:s segment:s merged_dim:s y:f5", f"""
{ctes('slices')} SELECT ds, region, segment, CASE WHEN grouping(region) = 1 THEN 'region' ELSE 'segment' END AS merged_dim, sum(y) AS y
FROM slices GROUP BY GROUPING SETS ((ds, region), (ds, segment))""")
def _(spark, d):
    return A.sibling_rollup(panel(spark, d, "slices"), ["region", "segment"])


@query("agg9_snapshot", "series:s n_rows:i min_ds:d max_ds:d n_dates:i min_y:f4 max_y:f4 mean_y:f5 std_y:f4 median_y:f5 null_y:i zero_y:i "
       "sum_y:f3 load_no_non_null:i load_no_non_zero:i load_no_unique:i load_no_min:i load_no_max:i", f"""
{ctes('holey')} SELECT series, count(*) n_rows, min(ds) min_ds, max(ds) max_ds, count(DISTINCT ds) n_dates, min(y) min_y, max(y) max_y,
avg(y) mean_y, stddev_samp(y) std_y, median(y) median_y, count(*) - count(y) null_y, count(*) FILTER (y = 0) zero_y, sum(y) sum_y,
count(load_no) load_no_non_null, count(*) FILTER (load_no <> 0) load_no_non_zero, count(DISTINCT load_no) load_no_unique,
min(load_no) load_no_min, max(load_no) load_no_max FROM holey GROUP BY series""")
def _(spark, d):
    return A.snapshot(panel(spark, d, "holey"), K, "ds", "y", ["load_no"])


@query("agg10_date_coverage", "series:s start:d end:d n_rows:i span_days:i span_years:f6 history_months:f6", f"""
{ctes('weekly')} SELECT series, min(ds) AS start, max(ds) AS "end", count(*) AS n_rows, max(ds) - min(ds) AS span_days,
(max(ds) - min(ds)) / 365.25 AS span_years, (max(ds) - min(ds)) / 30.44 AS history_months FROM weekly GROUP BY series""")
def _(spark, d):
    return A.date_coverage(panel(spark, d, "weekly"), K)


@query("agg11_describe_series", "series:s mean:f6 std:f5 min:f5 max:f5 cv:f6 has_negative:b has_zero:b", f"""
{ctes('weekly')}, c AS (SELECT series, y - 1000 AS y FROM weekly)
SELECT series, avg(y) AS mean, stddev_pop(y) AS std, min(y) AS min, max(y) AS max, stddev_pop(y) / abs(avg(y)) AS cv,
bool_or(y < 0) AS has_negative, bool_or(y = 0) AS has_zero FROM c GROUP BY series""")
def _(spark, d):
    return A.describe_series(panel(spark, d, "weekly").withColumn("y", F.col("y") - 1000), K)


# ---- windows -----------------------------------------------------------------------------


@query("win1_add_trend", "series:s ds:d time_index:i year:i days_since_start:i weeks_since_start:f6 months_since_start:f6 time_normalized:f6", f"""
{ctes('daily')}, t AS (SELECT *, row_number() OVER w - 1 AS time_index, ds - min(ds) OVER (PARTITION BY series) AS dd,
count(*) OVER (PARTITION BY series) AS n_all FROM daily WINDOW w AS (PARTITION BY series ORDER BY ds))
SELECT series, ds, time_index, year(ds) AS year, dd AS days_since_start, dd / 7.0 AS weeks_since_start, dd / 30.44 AS months_since_start,
CASE WHEN n_all > 1 THEN CAST(time_index AS DOUBLE) / (n_all - 1) ELSE 0 END AS time_normalized FROM t""")
def _(spark, d):
    return WN.add_trend(panel(spark, d, "daily"), K)


@query("win2_add_lags", "series:s ds:d lag_1:f5 lag_4:f5 lag_13:f5 lag_26:f5 lag_52:f5", f"""
{ctes('weekly')} SELECT series, ds, {', '.join(f'lag(y, {k}) OVER w AS lag_{k}' for k in (1, 4, 13, 26, 52))}
FROM weekly WINDOW w AS (PARTITION BY series ORDER BY ds)""")
def _(spark, d):
    return WN.add_lags(panel(spark, d, "weekly"), K, "weekly")


@query("win3_add_rolling", "series:s ds:d rolling_mean_7:f6 rolling_std_7:f4 rolling_mean_28:f6", f"""
{ctes('daily')} SELECT series, ds, avg(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean_7,
stddev_samp(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_std_7,
avg(y) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS rolling_mean_28
FROM daily WINDOW w AS (PARTITION BY series ORDER BY ds)""")
def _(spark, d):
    return WN.add_rolling(panel(spark, d, "daily"), K, "daily")


@query("win4_add_yoy", "series:s ds:d lag_52:f5 lag_52_avg:f7", f"""
{ctes('weekly')} SELECT series, ds, lag(y, 52) OVER w AS lag_52, avg(y) OVER (w ROWS BETWEEN 55 PRECEDING AND 52 PRECEDING) AS lag_52_avg
FROM weekly WINDOW w AS (PARTITION BY series ORDER BY ds) QUALIFY count(y) OVER (PARTITION BY series) >= 60""")
def _(spark, d):
    return WN.add_yoy(panel(spark, d, "weekly"), K, "weekly")


_TREE = ["lag_1", "lag_7", "rolling_mean_7", "lag_52", "lag_52_rolling_avg"]


@query("win5_add_tree_lags", "series:s ds:d yoy_ratio:f6 " + " ".join(f"{c}:f7" for c in _TREE), f"""
{ctes('weekly')}, t AS (SELECT series, ds, y, lag(y, 1) OVER w AS lag_1, lag(y, 7) OVER w AS lag_7,
avg(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean_7, lag(y, 52) OVER w AS lag_52,
avg(y) OVER (w ROWS BETWEEN 55 PRECEDING AND 49 PRECEDING) AS lag_52_rolling_avg FROM weekly WINDOW w AS (PARTITION BY series ORDER BY ds))
SELECT series, ds, CASE WHEN lag_52 IS NULL OR lag_52 = 0 THEN 1 ELSE least(greatest(y / lag_52, 0.1), 10) END AS yoy_ratio,
{', '.join(f'coalesce(first_value({c} IGNORE NULLS) OVER (v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value({c} IGNORE NULLS) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {c}' for c in _TREE)}
FROM t WINDOW v AS (PARTITION BY series ORDER BY ds)""")
def _(spark, d):
    return WN.add_tree_lags(panel(spark, d, "weekly"), K, "weekly")


@query("win6_gaps", "series:s prev_ds:d ds:d gap_days:i", f"""
{ctes('daily')}, g AS (SELECT series, ds, lag(ds) OVER (PARTITION BY series ORDER BY ds) AS prev_ds FROM daily)
SELECT series, prev_ds, ds, ds - prev_ds AS gap_days FROM g WHERE ds - prev_ds > 2""")
def _(spark, d):
    return WN.gaps(panel(spark, d, "daily"), K, "daily")


@query("win6_gaps_tolerance", "region:s segment:s prev_ds:d ds:d gap_days:i", f"""
{ctes('slices')}, g AS (SELECT region, segment, ds, lag(ds) OVER (PARTITION BY region, segment ORDER BY ds) AS prev_ds FROM slices)
SELECT *, ds - prev_ds AS gap_days FROM g WHERE ds - prev_ds > 10.5""")
def _(spark, d):
    return WN.gaps(panel(spark, d, "slices"), ["region", "segment"], "weekly", "analysis")


@query("win7_fill", "series:s load_no:i ds:d y:f4 z:f4", f"""
{ctes('holey')}
SELECT series, load_no, ds, coalesce(last_value(y IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(y IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS y, coalesce(y, -1) AS z
FROM holey WINDOW w AS (PARTITION BY series, load_no ORDER BY ds)""")
def _(spark, d):
    df, keys = panel(spark, d, "holey").withColumn("z", F.col("y")), [*K, "load_no"]
    return WN.fill(WN.fill(df, keys, ["y"], constant=0.0), keys, ["z"], how=(), constant=-1.0)


@query("win8_dedup_dates", "series:s ds:d y:f4 load_no:i", f"""
{ctes('holey')} SELECT series, ds, y, load_no FROM holey QUALIFY row_number() OVER (PARTITION BY series, ds ORDER BY load_no DESC) = 1""")
def _(spark, d):
    return WN.dedup_dates(panel(spark, d, "holey"), K, ["load_no"])


TAIL_SQL = """t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY series) AS n_all FROM {src}),
m AS (SELECT series, median(y) AS med FROM t WHERE i < n_all - 4 GROUP BY series),
l AS (SELECT t.*, n_all >= 6 AND med > 0 AND i > greatest(n_all - 5, 4) AND y / med < 0.5 AS low FROM t JOIN m USING (series)),
tail AS (SELECT *, bool_and(coalesce(low, false)) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_tail FROM l)"""


@query("win9_drop_incomplete_tail", "series:s ds:d y:f7", f"""
{ctes('spiky')}, {TAIL_SQL.format(src='spiky')} SELECT series, ds, y FROM tail WHERE NOT is_tail""")
def _(spark, d):
    return WN.drop_incomplete_tail(panel(spark, d, "spiky"), K)


@query("win10_incomplete_final", "series:s last_date:d last_value:f5 prev_value:f5 median_value:f6 drop_pct:f4 row_drop_pct:f4 "
       "sudden_drop_pct:f4 reason:s is_incomplete:b", f"""
{ctes('sales')}, dd AS (SELECT region AS series, CAST(date_trunc('month', ds) AS DATE) AS ds, sum(y / 1000) AS v, count(*) AS c FROM sales GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS rn FROM dd),
a AS (SELECT series, count(*) AS n, sum(c) > count(*) AS multi, max(ds) AS last_date, max(v) FILTER (rn = 1) AS last_value,
 max(v) FILTER (rn = 2) AS prev_value, max(c) FILTER (rn = 1) AS lr, median(v) FILTER (rn > 1) AS median_value, median(c) FILTER (rn > 1) AS mr FROM t GROUP BY series),
p AS (SELECT *, CASE WHEN median_value > 0 THEN (1 - last_value / median_value) * 100 END AS drop_pct,
 CASE WHEN multi AND mr > 0 THEN (1 - lr / mr) * 100 END AS row_drop_pct, CASE WHEN prev_value > 0 THEN (1 - last_value / prev_value) * 100 END AS sudden_drop_pct FROM a),
r AS (SELECT *, CASE WHEN n < 5 THEN NULL WHEN drop_pct > 50 THEN 'below_median' WHEN row_drop_pct > 30 THEN 'fewer_rows' WHEN sudden_drop_pct > 70 THEN 'sudden_drop' END AS reason FROM p)
SELECT *, reason IS NOT NULL AS is_incomplete FROM r""")
def _(spark, d):
    df = panel(spark, d, "sales").select(
        F.col("region").alias("series"), F.trunc("ds", "month").alias("ds"), (F.col("y") / 1000).alias("y"))
    return WN.incomplete_final(df, K)


@query("win11_partial_weeks", "series:s ds:d y:f7 surrounding_mean:f7 drop_pct:f4", f"""
{ctes('spiky')}, t AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series) AS n_all,
(sum(y) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - y) / 4 AS surrounding_mean FROM spiky WINDOW w AS (PARTITION BY series ORDER BY ds))
SELECT series, ds, y, surrounding_mean, (y / surrounding_mean - 1) * 100 AS drop_pct FROM t
WHERE i >= 2 AND i < n_all - 2 AND surrounding_mean > 0 AND y < 0.5 * surrounding_mean AND (day(ds) <= 10 OR day(ds) >= day(last_day(ds)) - 6)""")
def _(spark, d):
    return WN.partial_weeks(panel(spark, d, "spiky"), K)


@query("win13_growth", "series:s ds:d growth_pct:f4", f"""
{ctes('monthly')} SELECT series, ds, (y - lag(y) OVER w) / nullif(lag(y) OVER w, 0) * 100 AS growth_pct FROM monthly WINDOW w AS (PARTITION BY series ORDER BY ds)""")
def _(spark, d):
    return WN.growth(panel(spark, d, "monthly"), K)


def split_sql(src, keys, h):
    """CTE ``split`` with the labels."""
    return f"""sp1 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ds DESC) AS back, count(*) OVER (PARTITION BY {keys}) AS n_all FROM {src}),
sp2 AS (SELECT *, least({h}, greatest(1, n_all // 7)) AS hs FROM sp1),
sp3 AS (SELECT *, n_all - 2 * hs < greatest({2 * h}, 30) AS short FROM sp2),
split AS (SELECT *, CASE WHEN back <= CASE WHEN short THEN 0 ELSE hs END THEN 'holdout'
 WHEN back <= CASE WHEN short THEN least({h}, n_all // 5) ELSE 2 * hs END THEN 'eval' ELSE 'train' END AS split FROM sp3)"""


@query("win14_split_series", "series:s ds:d y:f5 split:s", f"""
{ctes('weekly')}, {split_sql('weekly', 'series', 12)} SELECT series, ds, y, split FROM split""")
def _(spark, d):
    return WN.split_series(panel(spark, d, "weekly"), K, 12)


@query("win15_split_simple", "series:s ds:d split:s", f"""
{ctes('monthly')}, t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS back, count(*) OVER (PARTITION BY series) AS n_all FROM monthly),
a AS (SELECT *, greatest(CAST(floor(n_all * CAST(0.15 AS DOUBLE)) AS BIGINT), 6, 3) AS k FROM t),
b AS (SELECT *, CASE WHEN n_all < 50 THEN greatest(least(6, n_all // 4), 3) WHEN n_all - 2 * k < n_all * 0.5 THEN greatest(CAST(floor(n_all * 0.5) AS BIGINT) // 2, 6, 3) ELSE k END AS size FROM a)
SELECT series, ds, CASE WHEN back <= size THEN 'holdout' WHEN back <= 2 * size THEN 'eval' ELSE 'train' END AS split FROM b""")
def _(spark, d):
    return WN.split_series(panel(spark, d, "monthly"), K, 6, mode="simple")


# ---- orderings and sets ------------------------------------------------------------------


@query("srt3_first_n", "series:s ds:d y:f2", f"""
{ctes('daily')}, q AS (SELECT series, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM daily GROUP BY series HAVING count(y) >= 10)
SELECT series, ds, y FROM daily JOIN q USING (series) WHERE y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) QUALIFY row_number() OVER (PARTITION BY series ORDER BY ds) <= 10""")
def _(spark, d):
    """The first outliers of each series."""
    return S.first_n(Q.iqr_outliers(panel(spark, d, "daily"), K).select("series", "ds", "y"), K, 10)


@query("srt6_order_advice", "slice:s target_avg:f6", f"""
{ctes('sales')} SELECT region || ' | ' || segment AS slice, avg(y) AS target_avg FROM sales GROUP BY region, segment""")
def _(spark, d):
    return S.order_advice(A.slice_stats(panel(spark, d, "sales"), ["region", "segment"], "y"), "target_avg", ["slice"])


@query("set1_union_rows", "series:s ds:d y:f5 disc:f6", f"""
{ctes('ship', 'weekly')} SELECT series, ds, y, disc FROM ship UNION ALL SELECT series, ds, y, NULL FROM weekly""")
def _(spark, d):
    return S.union_rows(panel(spark, d, "ship"), panel(spark, d, "weekly"))


@query("set2_date_overlap", "series:s ds:d", f"""
{ctes('daily')} SELECT series, ds FROM daily WHERE ds < DATE '2000-01-01' INTERSECT SELECT series, ds FROM daily WHERE ds >= DATE '1998-07-01'""")
def _(spark, d):
    """Dates that a training and a test part of the same series share."""
    df = panel(spark, d, "daily")
    return S.date_overlap(df.where("ds < DATE'2000-01-01'"), df.where("ds >= DATE'1998-07-01'"), K)


@query("set3_date_difference", "series:s ds:d", f"""
{ctes('daily')} SELECT series, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM daily GROUP BY series EXCEPT SELECT series, ds FROM daily""")
def _(spark, d):
    df = panel(spark, d, "daily")
    spine = df.groupBy("series").agg(F.explode(F.sequence(F.min("ds"), F.max("ds"))).alias("ds"))
    return S.date_difference(spine, df, K)


@query("set4_distinct_keys", "region:s segment:s", f"""
{ctes('sales')} SELECT DISTINCT region, segment FROM sales""")
def _(spark, d):
    return S.distinct_keys(panel(spark, d, "sales"), ["region", "segment"])

