"""Column roles and table structure."""

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import roles as R
from .panels import ctes, panel, table
from .registry import query

K = ["series"]


@query("rol1_detect_date_column", "table:s column:s rule:s score:f6", f"""
{ctes('messy')} SELECT 'orders' AS "table", 'o_orderdate' AS "column", 'name_part' AS rule, NULL AS score
UNION ALL SELECT 'messy', 'stamp', 'parsed', count(try_strptime(us_date, '%m/%d/%Y')) / count(*) FROM messy
UNION ALL SELECT 'panel', 'ds', 'name', NULL""")
def _(spark, d):
    tables = {"orders": table(spark, d, "orders"), "messy": panel(spark, d, "messy").select("num_text", F.col("us_date").alias("stamp")),
              "panel": panel(spark, d, "daily")}
    out = None
    for name, df in tables.items():
        one = R.detect_date_column(df).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("rol2_detect_target_column", "table:s column:s rule:s score:f3", """
SELECT 'lineitem' AS "table", 'l_quantity' AS "column", 'name_part' AS rule, NULL AS score
UNION ALL SELECT 'orders', c, 'variance', v FROM (SELECT c, v FROM (SELECT 'o_orderkey' AS c, var_samp(o_orderkey) AS v FROM orders UNION ALL SELECT 'o_custkey', var_samp(o_custkey) FROM orders) ORDER BY v DESC LIMIT 1)""")
def _(spark, d):
    a = R.detect_target_column(table(spark, d, "lineitem"), "l_shipdate").withColumn("table", F.lit("lineitem"))
    b = R.detect_target_column(table(spark, d, "orders").drop("o_totalprice"), "o_orderdate").withColumn("table", F.lit("orders"))
    return a.unionByName(b)


_FREQ_SQL = """g AS (SELECT series, ds - lag(ds) OVER (PARTITION BY series ORDER BY ds) AS gap FROM {src}),
m AS (SELECT series, floor(median(gap)) AS median_gap FROM g GROUP BY series)"""


@query("rol3_detect_frequency", "series:s median_gap:f2 frequency:s", f"""
{ctes('sales')}, u AS (SELECT DISTINCT region AS series, ds FROM sales), {_FREQ_SQL.format(src='u')}
SELECT *, CASE WHEN median_gap <= 1 OR median_gap IS NULL THEN 'daily' WHEN median_gap <= 8 THEN 'weekly' ELSE 'monthly' END AS frequency FROM m""")
def _(spark, d):
    return R.detect_frequency(panel(spark, d, "sales").withColumnRenamed("region", "series"), K, "profile")


@query("rol3_frequency_analysis", "series:s median_gap:f2 frequency:s", f"""
{ctes('monthly', 'weekly')}, u AS (SELECT * FROM monthly UNION ALL SELECT * FROM weekly), {_FREQ_SQL.format(src='u')}
SELECT *, CASE WHEN median_gap IS NULL THEN 'unknown' WHEN median_gap <= 1 THEN 'daily' WHEN median_gap BETWEEN 5 AND 9 THEN 'weekly' WHEN median_gap BETWEEN 25 AND 35 THEN 'monthly' ELSE 'irregular' END AS frequency FROM m""")
def _(spark, d):
    return R.detect_frequency(panel(spark, d, "monthly").unionByName(panel(spark, d, "weekly")), K, "analysis")


@query("rol3_frequency_first50", "series:s median_gap:f2 frequency:s", f"""
{ctes('weekly')}, g AS (SELECT series, ds - lag(ds) OVER w AS gap, row_number() OVER w AS i FROM weekly WINDOW w AS (PARTITION BY series ORDER BY ds)),
l AS (SELECT series, list(gap ORDER BY gap) FILTER (i > 1) AS a FROM g WHERE i <= 50 GROUP BY series)
SELECT series, a[len(a) // 2 + 1] AS median_gap, CASE WHEN a[len(a) // 2 + 1] <= 1.5 THEN 'daily' WHEN a[len(a) // 2 + 1] <= 8 THEN 'weekly' ELSE 'monthly' END AS frequency FROM l""")
def _(spark, d):
    return R.detect_frequency(panel(spark, d, "weekly"), K, "first50")


@query("rol4_week_anchor", "series:s weekday:i anchor:s", f"""
{ctes('sales')}, c AS (SELECT region AS series, isodow(ds) - 1 AS wd, count(*) AS n FROM sales GROUP BY ALL),
b AS (SELECT series, wd FROM c QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, wd) = 1)
SELECT series, wd AS weekday, 'W-' || ['MON','TUE','WED','THU','FRI','SAT','SUN'][wd + 1] AS anchor FROM b""")
def _(spark, d):
    return R.week_anchor(panel(spark, d, "sales").withColumnRenamed("region", "series"), K)


@query("rol5_detect_dimensions", "column:s n_unique:i type:s samples:a null_count:i", f"""
{ctes('sales')}, u AS (SELECT 'priority' AS c, priority AS v FROM sales UNION ALL SELECT 'status', status FROM sales UNION ALL SELECT 'segment', segment FROM sales
UNION ALL SELECT 'region', nullif(region, 'ASIA') FROM sales UNION ALL SELECT 'wk', CAST(week(ds) AS VARCHAR) FROM sales UNION ALL SELECT 'q', CAST(quarter(ds) AS VARCHAR) FROM sales)
SELECT c AS "column", count(DISTINCT v) AS n_unique, CASE c WHEN 'wk' THEN 'numeric_categorical' WHEN 'q' THEN 'flag/code' ELSE 'categorical' END AS type,
list_sort(list(DISTINCT v) FILTER (v IS NOT NULL))[1:5] AS samples, count(*) - count(v) AS null_count FROM u GROUP BY c
UNION ALL SELECT 'id', NULL, 'measure', NULL, NULL""")
def _(spark, d):
    df = panel(spark, d, "sales").withColumns({
        "wk": F.weekofyear("ds"), "q": F.quarter("ds"), "region": F.nullif(F.col("region"), F.lit("ASIA"))})
    return R.detect_dimensions(df, "ds", "y")


@query("rol6_aggregation_needed", "n_rows:i n_dates:i recommended:b rows_per_date:f6", f"""
{ctes('sales')} SELECT count(*) AS n_rows, count(DISTINCT ds) AS n_dates, count(*) > count(DISTINCT ds) AS recommended, count(*) / count(DISTINCT ds) AS rows_per_date FROM sales""")
def _(spark, d):
    return A.aggregation_needed(panel(spark, d, "sales"), "ds")


@query("rol7_find_covariates", "column:s filled:f6 low_cardinality:b", """
WITH t AS (SELECT l_quantity AS q, CASE WHEN l_orderkey % 10 < 3 THEN l_extendedprice END AS sparse, CASE WHEN l_orderkey % 10 < 3 THEN l_linenumber END AS few, l_tax AS tax FROM lineitem)
SELECT 'q' AS "column", count(q) / count(*) AS filled, count(DISTINCT q) <= 20 AS low_cardinality FROM t
UNION ALL SELECT 'few', count(few) / count(*), count(DISTINCT few) <= 20 FROM t UNION ALL SELECT 'tax', count(tax) / count(*), count(DISTINCT tax) <= 20 FROM t""")
def _(spark, d):
    some = F.col("l_orderkey") % 10 < 3
    df = table(spark, d, "lineitem").select(
        F.col("l_shipdate").alias("ds"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("q"), F.when(some, F.col("l_extendedprice")).alias("sparse"),
        F.when(some, F.col("l_linenumber")).alias("few"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"))
    return R.find_covariates(df, "ds", "y")


@query("rol8_classify_columns", "column:s kind:s is_numeric:b", f"""
{ctes('ship', 'messy')}, p AS (SELECT bool_and(promo IN (0, 1)) AS b FROM ship),
n AS (SELECT count(*) FILTER (regexp_matches(trim(num_text), '^[+-]?([0-9]|[.][0-9])')) / count(*) FILTER (trim(num_text) <> '') AS r FROM messy)
SELECT 'promo' AS "column", CASE WHEN b THEN 'holiday' ELSE 'numeric' END AS kind, b AS is_numeric FROM p UNION ALL SELECT 'ds', 'date', false UNION ALL SELECT 'y', 'numeric', true UNION ALL
SELECT 'series', 'categorical', false UNION ALL SELECT 'us_date', 'date', false UNION ALL SELECT 'flag_text', 'categorical', false
UNION ALL SELECT 'num_text', CASE WHEN r >= 0.8 THEN 'numeric' ELSE 'categorical' END, r >= 0.8 FROM n UNION ALL SELECT 'easter_week', 'holiday', false""")
def _(spark, d):
    a = R.classify_columns(panel(spark, d, "ship").select("series", "ds", "y", "promo"))
    b = R.classify_columns(panel(spark, d, "messy").select("us_date", "flag_text", "num_text", F.col("str_text").alias("easter_week")))
    return a.unionByName(b)


@query("rol9_detect_slices", "column:s kind:s count:i samples:a", f"""
{ctes('sales')}, u AS (SELECT 'priority' AS c, 'other' AS kind, priority AS v FROM sales UNION ALL SELECT 'status', 'other', status FROM sales
UNION ALL SELECT 'segment', 'category', segment FROM sales UNION ALL SELECT 'region', 'region', region FROM sales)
SELECT c AS "column", kind, count(DISTINCT v) AS count, list_sort(list(DISTINCT v))[1:5] AS samples FROM u GROUP BY ALL""")
def _(spark, d):
    return R.detect_slices(panel(spark, d, "sales"))


@query("rol10_categorize_covariates", "column:s category:s", f"""
{ctes('ship')} SELECT 'disc' AS "column", 'numeric' AS category UNION ALL SELECT 'promo', 'promotion' UNION ALL SELECT 'unit_price', 'pricing'
UNION ALL SELECT 'flag', CASE WHEN bool_and(promo IN (0, 1)) THEN 'holiday' ELSE 'numeric' END FROM ship UNION ALL SELECT 'outside_temp', 'external'""")
def _(spark, d):
    df = panel(spark, d, "ship").select("disc", "promo", F.col("y").alias("unit_price"), F.col("promo").alias("flag"), F.col("qty").alias("outside_temp"))
    return R.categorize_covariates(df, df.columns)


@query("rol11_detect_event_columns", "column:s n_on:i", f"""
{ctes('ship')} SELECT 'promo' AS "column", sum(promo) AS n_on FROM ship HAVING max(promo) = 1""")
def _(spark, d):
    df = panel(spark, d, "ship").withColumn("off", F.lit(0))
    return R.detect_event_columns(df, exclude=["series", "ds", "y"])


@query("rol12_filterable_columns", "column:s n:i values:a", f"""
{ctes('sales')}, u AS (SELECT 'priority' AS c, priority AS v FROM sales UNION ALL SELECT 'status', status FROM sales
UNION ALL SELECT 'segment', segment FROM sales UNION ALL SELECT 'region', region FROM sales)
SELECT c AS "column", count(DISTINCT v) AS n, list_sort(list(DISTINCT v)) AS values FROM u GROUP BY c HAVING count(DISTINCT v) BETWEEN 2 AND 20""")
def _(spark, d):
    return R.filterable_columns(panel(spark, d, "sales"), exclude=["ds", "y"])
