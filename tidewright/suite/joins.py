"""Joins and spines."""

from pyspark.sql import functions as F

from ..operators import joins as J
from .panels import ctes, panel, table
from .registry import query

K = ["series"]


@query("jon1_join_features", "series:s ds:d y:f2 n:i promo:i qty:f2", f"""
{ctes('daily', 'ship')}, f AS (SELECT ds, promo, qty FROM ship QUALIFY row_number() OVER (PARTITION BY ds ORDER BY series DESC) = 1)
SELECT d.series, d.ds, d.y, d.n, coalesce(f.promo, 0) AS promo, coalesce(f.qty, 0) AS qty FROM daily d LEFT JOIN f USING (ds)""")
def _(spark, d):
    feats = panel(spark, d, "ship").select("ds", "series", "promo", "qty")
    return J.join_features(panel(spark, d, "daily").withColumn("qty", F.lit(-1.0)), feats, "ds", order=["series"])


@query("jon2_join_actuals", "series:s h:i ds:d yhat:f6 actual:f5", f"""
{ctes('fc', 'act')} SELECT series, h, ds, yhat, y AS actual FROM fc JOIN act USING (series, ds)""")
def _(spark, d):
    return J.join_actuals(panel(spark, d, "fc"), panel(spark, d, "act"), K)


@query("jon3_timeline", "series:s ds:d actual:f5 validation_yhat:f6 forecast_yhat:f6 yhat_lower:f6 yhat_upper:f6 type:s", f"""
{ctes('hist', 'resid', 'fc')}, v AS (SELECT series, ds + 3 * CAST(day(ds) = 7 AS INTEGER) AS ds, y, yhat FROM resid),
b AS (SELECT h.series, max(h.ds) AS last_ds, (SELECT min(ds) FROM fc WHERE fc.series = h.series) AS first_ds FROM hist h GROUP BY h.series),
j AS (SELECT coalesce(h.series, v.series, f.series) AS series, coalesce(h.ds, v.ds, f.ds) AS ds, h.y AS hy, v.y AS vy, v.yhat AS vh, f.yhat AS fh, f.yhat_lower, f.yhat_upper
 FROM hist h FULL JOIN v ON h.series = v.series AND h.ds = v.ds FULL JOIN fc f ON f.series = coalesce(h.series, v.series) AND f.ds = coalesce(h.ds, v.ds))
SELECT j.series, j.ds, coalesce(hy, vy) AS actual, vh AS validation_yhat, coalesce(fh, CASE WHEN j.ds = last_ds AND first_ds <> last_ds THEN hy END) AS forecast_yhat, yhat_lower, yhat_upper,
CASE WHEN fh IS NOT NULL THEN 'forecast' WHEN hy IS NOT NULL THEN 'history' ELSE 'validation' END AS type FROM j JOIN b ON j.series = b.series""")
def _(spark, d):
    val = panel(spark, d, "resid").withColumn("ds", F.when(F.dayofmonth("ds") == 7, F.date_add("ds", 3)).otherwise(F.col("ds")))
    return J.timeline(panel(spark, d, "hist"), val, panel(spark, d, "fc"), K)


@query("jon4_combine_slices", "region:s ds:d y:f5", f"""
{ctes('slices')} SELECT region, ds, sum(y) AS y FROM slices GROUP BY region, ds""")
def _(spark, d):
    return J.combine_slices(panel(spark, d, "slices"), ["region"])


def _future(src, series, h):
    return f"SELECT {series}, unnest(generate_series(1, {h})) AS h, max(ds) AS last_ds FROM {src} GROUP BY {series}"


@query("jon5_yoy_lookup", "series:s h:i ds:d lag_52:f6 lag_52_avg:f6", f"""
{ctes('weekly')}, s AS ({_future('weekly', 'series', 60)}), f AS (SELECT series, h, last_ds + 7 * CAST(h AS INTEGER) AS ds FROM s),
r AS (SELECT series, avg(y) AS m FROM (SELECT series, y FROM weekly QUALIFY row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 52) GROUP BY series)
SELECT f.series, h, f.ds, coalesce(w.y, m, 0) AS lag_52, coalesce(w.y, m, 0) AS lag_52_avg FROM f LEFT JOIN weekly w ON w.series = f.series AND w.ds = f.ds - 364 LEFT JOIN r ON r.series = f.series""")
def _(spark, d):
    hist = panel(spark, d, "weekly")
    return J.yoy_lookup(J.future_spine(hist, K, 60, "weekly"), hist, K, "weekly")


@query("jon5_yoy_lookup_monthly", "series:s h:i ds:d lag_12:f6", f"""
{ctes('monthly')}, s AS ({_future('monthly', 'series', 14)}), f AS (SELECT series, h, CAST(last_ds + to_months(CAST(h AS INTEGER)) AS DATE) AS ds FROM s),
r AS (SELECT series, avg(y) AS m FROM (SELECT series, y FROM monthly QUALIFY row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 12) GROUP BY series)
SELECT f.series, h, f.ds, coalesce(w.y, m, 0) AS lag_12 FROM f LEFT JOIN monthly w ON w.series = f.series AND w.ds = f.ds - INTERVAL 12 MONTH LEFT JOIN r ON r.series = f.series""")
def _(spark, d):
    hist = panel(spark, d, "monthly")
    return J.yoy_lookup(J.future_spine(hist, K, 14, "monthly"), hist, K, "monthly")


@query("jon9_missing_periods", "region:s segment:s ds:d", f"""
{ctes('slices')}, b AS (SELECT region, segment, unnest(generate_series(min(ds), max(ds), INTERVAL 7 DAY)) AS ds FROM slices GROUP BY region, segment)
SELECT region, segment, CAST(ds AS DATE) AS ds FROM b EXCEPT SELECT region, segment, ds FROM slices""")
def _(spark, d):
    return J.missing_periods(panel(spark, d, "slices"), ["region", "segment"], "weekly")


@query("jon9_missing_days", "series:s ds:d", f"""
{ctes('daily')}, b AS (SELECT series, unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS ds FROM daily GROUP BY series)
SELECT series, CAST(ds AS DATE) AS ds FROM b EXCEPT SELECT series, ds FROM daily""")
def _(spark, d):
    return J.missing_periods(panel(spark, d, "daily"), K, "daily")


@query("jon10_fill_future_covariates", "series:s h:i ds:d disc:f8 promo:i", f"""
{ctes('ship')}, s AS ({_future('ship', 'series', 8)}), f AS (SELECT series, h, last_ds + 7 * CAST(h AS INTEGER) AS ds FROM s),
m AS (SELECT series, avg(disc) AS disc FROM ship GROUP BY series),
k AS (SELECT series, ds + 28 AS ds, disc, promo FROM ship)
SELECT f.series, h, f.ds, coalesce(k.disc, m.disc) AS disc, coalesce(k.promo, 0) AS promo FROM f LEFT JOIN k ON f.series = k.series AND f.ds = k.ds JOIN m ON m.series = f.series""")
def _(spark, d):
    hist = panel(spark, d, "ship")
    known = hist.select("series", F.date_add("ds", 28).alias("ds"), "disc", "promo")
    return J.fill_future_covariates(J.future_spine(hist, K, 8, "weekly"), hist, K, ["disc", "promo"], known)


@query("jon11_future_spine", "series:s h:i ds:d", f"""
{ctes('daily')}, s AS ({_future('daily', 'series', 30)}) SELECT series, h, last_ds + CAST(h AS INTEGER) AS ds FROM s""")
def _(spark, d):
    return J.future_spine(panel(spark, d, "daily"), K, 30, "daily")


@query("jon12_cross_candidates", "region:s segment:s alpha:f2 form:s n_rows:i", f"""
{ctes('sales')} SELECT region, segment, alpha, form, n_rows FROM (SELECT region, segment, count(*) AS n_rows FROM sales GROUP BY ALL)
CROSS JOIN (VALUES (0.2), (0.5), (0.8)) a(alpha) CROSS JOIN (VALUES ('add'), ('mul')) f(form)""")
def _(spark, d):
    grid = spark.createDataFrame([(a, f) for a in (0.2, 0.5, 0.8) for f in ("add", "mul")], "alpha double, form string")
    return J.cross_candidates(panel(spark, d, "sales").groupBy("region", "segment").agg(F.count(F.lit(1)).alias("n_rows")), grid)


_ROUTE_FC = """rf AS (SELECT region, segment, 'region=' || region || '|segment=' || segment AS sid, row_number() OVER (PARTITION BY region, segment ORDER BY ds DESC) AS h, ds, y AS yhat FROM slices)"""


@query("jon13_route_requests", "request_id:i segment:s h:i ds:d yhat:f5 error:s n_available:i", f"""
{ctes('slices')}, {_ROUTE_FC}, q AS (SELECT c_custkey AS request_id, 1 + c_custkey % 5 AS periods, 'region=' || CASE WHEN c_custkey % 11 = 0 THEN 'NOWHERE' ELSE r_name END || '|segment=' || c_mktsegment AS key
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), n AS (SELECT count(DISTINCT sid) AS c FROM rf)
SELECT request_id, sid AS segment, h, ds, yhat, CASE WHEN sid IS NULL THEN 'no_matching_segment' END AS error, CASE WHEN sid IS NULL THEN c END AS n_available
FROM q CROSS JOIN n LEFT JOIN rf ON sid = key AND h <= periods""")
def _(spark, d):
    from pyspark.sql import Window as W

    fc = panel(spark, d, "slices").select(
        "region", "segment", F.row_number().over(W.partitionBy("region", "segment").orderBy(F.desc("ds"))).alias("h"), "ds", F.col("y").alias("yhat"))
    where = (table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
             .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    name = F.when(F.col("c_custkey") % 11 == 0, "NOWHERE").otherwise(F.col("r_name"))
    reqs = where.select(F.col("c_custkey").alias("request_id"), (1 + F.col("c_custkey") % 5).alias("periods"),
                        F.create_map(F.lit("segment"), "c_mktsegment", F.lit("region"), name).alias("filters"))
    return J.route_requests(reqs, fc, ["segment", "region"])


@query("jon17_append_future", "series:s ds:d y:f5 yhat:f6", f"""
{ctes('hist', 'fc')}, f AS (SELECT series, ds - 28 AS ds, yhat FROM fc)
SELECT series, ds, y, NULL AS yhat FROM hist UNION ALL SELECT series, ds, NULL, yhat FROM f WHERE ds > (SELECT max(ds) FROM hist WHERE hist.series = f.series)""")
def _(spark, d):
    fut = panel(spark, d, "fc").select("series", F.date_sub("ds", 28).alias("ds"), "yhat")
    return J.append_future(panel(spark, d, "hist"), fut, K)
