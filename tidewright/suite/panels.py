"""Input panels made from the given tables.

Each panel is one SELECT in the common part of both SQL dialects; base tables and other
panels are written in braces.  Spark receives them as DataFrames, the SQL side as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

PANELS: dict[str, str] = {
    # raw rows of a sales table with dimensions; several rows per date
    "sales": """
        SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS ds, o_totalprice AS y, o_orderpriority AS priority,
               o_orderstatus AS status, c_mktsegment AS segment, r_name AS region
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
        JOIN {region} ON n_regionkey = r_regionkey""",
    # one row per (priority, day)
    "daily": """
        SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS ds, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y,
               count(*) AS n
        FROM {orders} GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)""",
    "daily_total": """
        SELECT ds, CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) AS y, sum(n) AS n FROM {daily} GROUP BY ds""",
    # weeks labelled by their Monday, per region
    "weekly": """
        SELECT region AS series, CAST(date_trunc('week', ds) AS DATE) AS ds, CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS y
        FROM {sales} GROUP BY region, CAST(date_trunc('week', ds) AS DATE)""",
    # many series: brand, return flag and line status by week
    "brands": """
        SELECT concat(p_brand, '|', l_returnflag, '|', l_linestatus) AS series, CAST(date_trunc('week', l_shipdate) AS DATE) AS ds,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS y
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, l_returnflag, l_linestatus, CAST(date_trunc('week', l_shipdate) AS DATE)""",
    "monthly": """
        SELECT segment AS series, CAST(date_trunc('month', ds) AS DATE) AS ds, CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS y
        FROM {sales} GROUP BY segment, CAST(date_trunc('month', ds) AS DATE)""",
    # two dimensions, weekly
    "slices": """
        SELECT region, segment, CAST(date_trunc('week', ds) AS DATE) AS ds, CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS y
        FROM {sales} GROUP BY region, segment, CAST(date_trunc('week', ds) AS DATE)""",
    # weekly shipments with covariates
    "ship": """
        SELECT l_returnflag AS series, CAST(date_trunc('week', l_shipdate) AS DATE) AS ds,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS y, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS disc,
               CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) AS qty, max(CASE WHEN l_discount >= 0.1 AND l_quantity >= 49 THEN 1 ELSE 0 END) AS promo
        FROM {lineitem} GROUP BY l_returnflag, CAST(date_trunc('week', l_shipdate) AS DATE)""",
    # daily panel with NULLs and some repeated dates (rows get a load order)
    "holey": """
        SELECT series, ds, CASE WHEN extract(day FROM ds) % 17 = 0 THEN NULL ELSE y END AS y, 1 AS load_no FROM {daily}
        UNION ALL
        SELECT series, ds, y * 1.5 AS y, 2 AS load_no FROM {daily} WHERE extract(day FROM ds) = 11""",
    # weekly with spikes, dips and a cut tail
    "spiky": """
        SELECT w.series, w.ds,
               CASE WHEN extract(month FROM w.ds) = 11 AND extract(day FROM w.ds) BETWEEN 20 AND 27 THEN w.y * 8
                    WHEN extract(month FROM w.ds) = 3 AND extract(day FROM w.ds) <= 7 THEN w.y * 0.1
                    WHEN w.ds > CAST(m.last_ds - INTERVAL 14 DAY AS DATE) THEN w.y * 0.05 ELSE w.y END AS y
        FROM {weekly} w JOIN (SELECT series, max(ds) AS last_ds FROM {weekly} GROUP BY series) m ON w.series = m.series""",
    # weekly values with simple predictions and the position from the end
    "lagged": """
        SELECT series, ds, y, lag(y, 1) OVER (PARTITION BY series ORDER BY ds) AS l1, lag(y, 4) OVER (PARTITION BY series ORDER BY ds) AS l4,
               avg(y) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m7,
               lag(y, 7) OVER (PARTITION BY series ORDER BY ds) AS l7,
               lag(y, 52) OVER (PARTITION BY series ORDER BY ds) AS l52,
               row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS back
        FROM {weekly}""",
    # four simple models over the last 24 weeks of each series
    "models": """
        SELECT series, 'last' AS model, ds, 25 - back AS h, y, l1 AS yhat FROM {lagged} WHERE back <= 24
        UNION ALL SELECT series, 'month', ds, 25 - back, y, l4 FROM {lagged} WHERE back <= 24
        UNION ALL SELECT series, 'mean7', ds, 25 - back, y, m7 FROM {lagged} WHERE back <= 24
        UNION ALL SELECT series, 'year', ds, 25 - back, y, l52 FROM {lagged} WHERE back <= 24""",
    "hist": "SELECT series, ds, y FROM {lagged} WHERE back > 12",
    "act": "SELECT series, ds, y FROM {lagged} WHERE back <= 12",
    "fc": """
        SELECT series, h - 12 AS h, ds, yhat, yhat * 0.75 AS yhat_lower, yhat * 1.25 AS yhat_upper FROM {models} WHERE model = 'mean7' AND h > 12""",
    # history with one model and its residuals
    "resid": "SELECT series, ds, y, m7 AS yhat, y - m7 AS res FROM {lagged} WHERE back > 12 AND l7 IS NOT NULL",
    # a run log: jobs, results of models, queue, sessions, uploads
    "jobs": """
        SELECT o_orderkey AS job_id, o_custkey AS user_id,
          CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'QUEUED' ELSE 'PENDING' END END AS status,
          o_orderdate + INTERVAL 1 SECOND * CAST(o_orderkey % 86400 AS INT) AS submitted_at,
          CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + INTERVAL 1 SECOND * CAST(o_orderkey % 86400 + 60 AS INT) END AS started_at,
          CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 SECOND * CAST(o_orderkey % 86400 + 60 + o_custkey % 5000 AS INT) END AS completed_at,
          CASE WHEN o_orderstatus <> 'O' THEN CAST(o_custkey % 5000 AS BIGINT) END AS duration_seconds,
          CAST(4 + o_orderkey % 9 AS INT) AS horizon, CASE o_orderkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' ELSE 'monthly' END AS frequency,
          CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 400 AS DOUBLE) / 8 END AS best_mape, CASE WHEN o_orderstatus = 'F' THEN 'ets' END AS best_model,
          'seed=' || CAST(o_orderkey % 100 AS VARCHAR(10)) AS request_params, CAST(o_orderkey % 100 AS INT) AS random_seed
        FROM {orders}""",
    "results": """
        SELECT l_orderkey AS job_id, CASE l_linenumber WHEN 1 THEN 'structural' WHEN 2 THEN 'ets' WHEN 3 THEN 'arima' WHEN 4 THEN 'theta' WHEN 5 THEN 'naive' WHEN 6 THEN 'boosted' ELSE 'sarimax' END AS model_name,
          CASE WHEN l_linenumber = 4 AND l_partkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 640 AS DOUBLE) / 16 END AS mape, l_extendedprice AS rmse
        FROM {lineitem}""",
    "queue": """
        SELECT o_orderkey AS job_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '2-HIGH' THEN 'HIGH' WHEN '5-LOW' THEN 'LOW' ELSE 'NORMAL' END AS priority,
          o_orderdate + INTERVAL 1 SECOND * CAST(o_custkey % 3600 AS INT) AS enqueued_at, o_orderstatus <> 'F' AS is_active
        FROM {orders}""",
    # a queue that lacks some of the jobs, as joins must keep these
    "queue_gaps": "SELECT * FROM {queue} WHERE job_id % 13 <> 5",
    "uploads": """
        SELECT o_orderkey AS upload_id, o_custkey AS user_id, substr(o_orderpriority, 1, 1) || '-' || o_orderstatus AS data_hash,
          o_orderdate + INTERVAL 1 SECOND * CAST(o_orderkey % 86400 AS INT) AS uploaded_at, o_orderkey % 10 = 3 AS is_deleted
        FROM {orders}""",
    # text forms of numbers, dates, flags
    "messy": """
        SELECT o_orderkey AS id,
          CASE o_orderkey % 9
            WHEN 0 THEN '$' || big || ',' || lpad(small, 3, '0') || '.' || cents
            WHEN 1 THEN big || '.' || lpad(small, 3, '0') || ',' || cents || ' EUR'
            WHEN 2 THEN '(' || big || ',' || lpad(small, 3, '0') || ')'
            WHEN 3 THEN small || '%'
            WHEN 4 THEN big || ',' || cents
            WHEN 5 THEN ' ' || big || lpad(small, 3, '0') || '.' || cents || ' '
            WHEN 6 THEN 'n/a'
            WHEN 7 THEN '1.' || lpad(small, 3, '0') || '.' || lpad(small, 3, '0')
            ELSE '' END AS num_text,
          CASE o_orderkey % 12
            WHEN 0 THEN yyyy || '-' || mm || '-' || dd
            WHEN 1 THEN yyyy || '/' || mm || '/' || dd
            WHEN 2 THEN mm || '/' || dd || '/' || yyyy
            WHEN 3 THEN mm || '-' || dd || '-' || yyyy
            WHEN 4 THEN mm || '/' || dd || '/' || right(yyyy, 2)
            WHEN 5 THEN 'January ' || dd || ', ' || yyyy
            WHEN 6 THEN dd || ' Aug ' || yyyy
            WHEN 7 THEN 'W' || mm || ' ' || yyyy
            WHEN 8 THEN yyyy || ' W' || dd
            WHEN 9 THEN 'Q' || qq || ' ' || yyyy
            WHEN 10 THEN yyyy || '-' || mm || '-' || dd || 'T10:20:30'
            ELSE 'someday' END AS date_text,
          CASE o_orderkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0'
            WHEN 4 THEN 'maybe' WHEN 5 THEN 'Active' ELSE 'off' END AS flag_text,
          CASE o_orderkey % 5 WHEN 0 THEN '  a   b ' WHEN 1 THEN 'x' || chr(160) || 'y' WHEN 2 THEN '﻿bom'
            WHEN 3 THEN 'l1' || chr(13) || chr(10) || 'l2' ELSE '   ' END AS str_text,
          CASE o_orderkey % 4 WHEN 0 THEN '0' || small WHEN 1 THEN '0.' || cents WHEN 2 THEN big || '' ELSE 'x' || small END AS code_text,
          mm || '/' || dd || '/' || yyyy AS us_date,
          big || ',' || lpad(small, 3, '0') AS comma_num
        FROM (SELECT o_orderkey,
                CAST(CAST(floor(floor(o_totalprice) / 1000) AS BIGINT) AS VARCHAR(20)) AS big,
                CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR(20)) AS small,
                lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 97 AS VARCHAR(20)), 2, '0') AS cents,
                CAST(extract(year FROM o_orderdate) AS VARCHAR(20)) AS yyyy,
                lpad(CAST(extract(month FROM o_orderdate) AS VARCHAR(20)), 2, '0') AS mm,
                lpad(CAST(extract(day FROM o_orderdate) AS VARCHAR(20)), 2, '0') AS dd,
                CAST(extract(quarter FROM o_orderdate) AS VARCHAR(20)) AS qq
              FROM {orders}) AS parts""",
}


def _deps(name: str, seen: list[str]) -> list[str]:
    for ref in re.findall(r"\{(\w+)\}", PANELS[name]):
        if ref in PANELS and ref not in seen:
            _deps(ref, seen)
    if name not in seen:
        seen.append(name)
    return seen


def _models(spark: SparkSession, d: str) -> DataFrame:
    """The ``models`` panel with its four rows per week made by one pass over the lags."""
    per = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("yhat")) for name, c in (("last", "l1"), ("month", "l4"), ("mean7", "m7"), ("year", "l52"))])
    rows = panel(spark, d, "lagged").where("back <= 24")
    return rows.select("series", "ds", (25 - F.col("back")).alias("h"), "y", F.inline(per)).select("series", "model", "ds", "h", "y", "yhat")


_SPARK_FORM = {"models": _models}
_known: dict[tuple[str, str, str, str], DataFrame] = {}


def _once(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    """The same lazy DataFrame for the same session, so that a plan is analysed once."""
    key = (spark.sparkContext.applicationId, str(id(spark)), d, name)
    if key not in _known:
        _known[key] = make()
    return _known[key]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return _once(spark, d, name, lambda: spark.read.parquet(f"{d}/{name}.parquet"))


def panel(spark: SparkSession, d: str, name: str) -> DataFrame:
    def make() -> DataFrame:
        if name in _SPARK_FORM:
            return _SPARK_FORM[name](spark, d)
        text = PANELS[name]
        refs = {r: panel(spark, d, r) if r in PANELS else table(spark, d, r) for r in set(re.findall(r"\{(\w+)\}", text))}
        return spark.sql(text, **refs)

    return _once(spark, d, f"panel:{name}", make)


def ctes(*names: str) -> str:
    """``WITH …`` text for the SQL side."""
    order: list[str] = []
    for n in names:
        _deps(n, order)
    parts = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', PANELS[n]).strip()})" for n in order]
    return "WITH " + ",\n".join(parts)
