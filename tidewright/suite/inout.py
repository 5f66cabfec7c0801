"""Sources and sinks: written to a scratch folder and read back."""

import os
import uuid

from pyspark.sql import functions as F

from ..operators import audit as AU
from ..operators import windows as WN
from ..session import shared_folder
from ..sources import readers as R
from ..sources import writers as WR
from .auditing import SCORE, SEGS, segs
from .core import split_sql
from .panels import ctes, panel, table
from .registry import query

K = ["series"]


def scratch(spark, name):
    """A new folder below the shared one."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


@query("src1_read_delimited", "p_partkey:i p_name:s p_brand:s p_retailprice:f2", "SELECT p_partkey, p_name || ';' || p_size AS p_name, p_brand, p_retailprice FROM part WHERE p_partkey % 10 <> 3")
def _(spark, d):
    """Semicolons, quoted fields with the delimiter inside, and a file of rows that are short."""
    path = scratch(spark, "src1")
    p = table(spark, d, "part")
    short = F.col("p_partkey") % 10 == 3
    p.where(~short).select("p_partkey", F.concat_ws(";", "p_name", "p_size").alias("p_name"), "p_brand", "p_retailprice").write.option("header", True).option("sep", ";").csv(path)
    p.where(short).select(F.concat(F.col("p_partkey").cast("string"), F.lit(";short")).alias("value")).write.mode("append").text(path)
    return R.read_delimited(spark, path)


@query("src2_read_csv", "o_orderkey:i o_orderstatus:s o_totalprice:f2", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    path = scratch(spark, "src2")
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.option("header", True).csv(path)
    return R.read_delimited(spark, path)


@query("src3_read_table", "status:s n:i", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    name = f"tidewright_src_{uuid.uuid4().hex}"
    table(spark, d, "orders").createOrReplaceTempView(name)
    return R.read_table(spark, name).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("src4_read_panel", "series:s ds:d y:f5", f"{ctes('weekly')} SELECT * FROM weekly WHERE series = 'ASIA'")
def _(spark, d):
    path = scratch(spark, "src4")
    panel(spark, d, "weekly").write.partitionBy("series").parquet(path)
    return R.read_panel(spark, path, {"series": "ASIA"})


@query("src5_from_records", "series:s ds:d y:f5 n_orders:i", f"{ctes('weekly', 'sales')}, n AS (SELECT region, count(*) AS n_orders FROM sales GROUP BY region) SELECT series, ds, y, n_orders FROM weekly JOIN n ON region = series")
def _(spark, d):
    """A request's records joined to the data they speak of (one record per region)."""
    counts = panel(spark, d, "sales").groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()
    records = R.from_records(spark, [{"series": r["region"], "n_orders": r["n"]} for r in counts])
    return panel(spark, d, "weekly").join(records, "series")


@query("snk1_write_forecast", "series:s date:d forecast:f6 lower_bound:f6 upper_bound:f6 growth_pct:f6", f"""
{ctes('fc')} SELECT series, ds AS date, yhat AS forecast, yhat_lower AS lower_bound, yhat_upper AS upper_bound, (yhat - lag(yhat) OVER w) / lag(yhat) OVER w * 100 AS growth_pct FROM fc WINDOW w AS (PARTITION BY series ORDER BY ds)""")
def _(spark, d):
    path = scratch(spark, "snk1")
    WR.write_forecast(panel(spark, d, "fc"), path, K)
    return R.read_delimited(spark, path)


@query("snk2_write_batch_summary", "region:s segment:s status:s mape:f5", f"""
{ctes('sales')} SELECT region, 'region=' || region || ' | seg=' || sales.segment AS segment, 'success' AS status, avg(y) / 1000 AS mape FROM sales GROUP BY region, sales.segment""")
def _(spark, d):
    path = scratch(spark, "snk2")
    res = panel(spark, d, "sales").groupBy("region", F.col("segment").alias("seg")).agg((F.avg("y") / 1000).alias("mape")).withColumns({"status": F.lit("success"), "best_model": F.lit("ets")})
    WR.write_batch_summary(res, path, ["region", "seg"])
    return R.read_delimited(spark, f"{path}/summary")


@query("snk3_write_scorecard", "region:s segment:s actual_mape:f6 periods:i status:s", f"{ctes('slices')}, {SEGS}, {SCORE} SELECT * FROM score")
def _(spark, d):
    path = scratch(spark, "snk3")
    WR.write_scorecard(AU.scorecard(*segs(spark, d), ["region", "segment"]), path)
    return R.read_delimited(spark, path)


@query("snk4_write_splits", "series:s split:s n_rows:i start:d end:d", f"""
{ctes('weekly')}, {split_sql('weekly', 'series', 12)} SELECT series, split, count(*) AS n_rows, min(ds) AS start, max(ds) AS "end" FROM split GROUP BY ALL""")
def _(spark, d):
    return WR.write_splits(WN.split_series(panel(spark, d, "weekly"), K, 12), scratch(spark, "snk4"), K)


@query("snk5_append_results", "series:s model:s n:i first_date:s last_pred:f6 sum_upper:f5", f"""
{ctes('models')} SELECT series, model, count(*) AS n, CAST(min(ds) AS VARCHAR) AS first_date, arg_max(yhat, h) AS last_pred, sum(yhat * 1.25) AS sum_upper FROM models GROUP BY ALL""")
def _(spark, d):
    path = scratch(spark, "snk5")
    fc = panel(spark, d, "models").withColumns({"yhat_lower": F.col("yhat") * 0.75, "yhat_upper": F.col("yhat") * 1.25})
    WR.append_results(fc.where("series < 'B'"), path, ["series", "model"])
    WR.append_results(fc.where("series >= 'B'"), path, ["series", "model"])
    back = R.read_panel(spark, path)
    return back.select("series", "model", F.size("predictions").alias("n"), F.element_at("forecast_dates", 1).cast("string").alias("first_date"), F.element_at("predictions", -1).alias("last_pred"),
                       F.aggregate("upper_bounds", F.lit(0.0), lambda s, x: s + x).alias("sum_upper"))


@query("snk5_publish_attempts", "series:s model:s attempt:i n:i last_pred:f6 sum_pred:f5", f"""
{ctes('models')}, w AS (SELECT *, CASE WHEN series >= 'E' THEN 2 ELSE 1 END AS attempt FROM models)
SELECT series, model, attempt, count(*) AS n, arg_max(yhat, h) * attempt AS last_pred, sum(yhat) * attempt AS sum_pred FROM w GROUP BY series, model, attempt""")
def _(spark, d):
    """The first attempt twice, a second one for some series with other values: every series once, the later attempt wins."""
    path = scratch(spark, "publish")
    fc = panel(spark, d, "models").withColumns({"yhat_lower": F.col("yhat") * 0.75, "yhat_upper": F.col("yhat") * 1.25})
    rows = WR.result_rows(fc, ["series", "model"])
    again = WR.result_rows(fc.where("series >= 'E'").withColumn("yhat", F.col("yhat") * 2), ["series", "model"])
    for part, attempt in ((rows, 1), (rows, 1), (again, 2)):
        WR.publish(part, path, ["series"], attempt)
    back = WR.published(spark, path, ["series"])
    return back.select("series", "model", "attempt", F.size("predictions").alias("n"), F.element_at("predictions", -1).alias("last_pred"),
                       F.aggregate("predictions", F.lit(0.0), lambda s, x: s + x).alias("sum_pred"))
