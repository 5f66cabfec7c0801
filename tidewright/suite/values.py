"""Value cleaning and scalar functions."""

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import dates as D
from ..functions import stats as ST
from ..operators import normalize as N
from .calendar import EASTER
from .panels import ctes, panel, table
from .registry import query

NUM = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def num_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NUM}') THEN TRY_CAST({x} AS DOUBLE) END"


CLEAN_NUM = f"(SELECT id, regexp_replace(num_text, '[,$ ]', '', 'g') AS t FROM messy)"

# numeric text step by step
NORM_NUM = f"""
n0 AS (SELECT id, num_text, trim(num_text) AS s FROM messy),
n1 AS (SELECT id, num_text, trim(regexp_replace(s, '[$€£¥₹]|USD|EUR|GBP', '', 'g')) AS s FROM n0),
n2 AS (SELECT id, num_text, s LIKE '%\\%' ESCAPE '\\' AS pct, trim(CASE WHEN s LIKE '%\\%' ESCAPE '\\' THEN s[:-2] ELSE s END) AS s FROM n1),
n3 AS (SELECT id, num_text, pct, CASE WHEN s LIKE '(%)' THEN '-' || s[2:-2] ELSE s END AS s FROM n2),
n4 AS (SELECT id, num_text, pct, s, len(s) - len(replace(s, ',', '')) AS cc, len(s) - len(replace(s, '.', '')) AS pc FROM n3),
n5 AS (SELECT id, num_text, pct, CASE
  WHEN cc > 0 AND pc > 0 AND instr(reverse(s), '.') < instr(reverse(s), ',') THEN replace(s, ',', '')
  WHEN cc > 0 AND pc > 0 THEN replace(replace(s, '.', ''), ',', '.')
  WHEN cc = 1 AND len(split_part(s, ',', 2)) = 3 THEN replace(s, ',', '')
  WHEN cc = 1 THEN replace(s, ',', '.')
  WHEN cc > 1 THEN replace(s, ',', '') WHEN pc > 1 THEN replace(s, '.', '') ELSE s END AS s FROM n4),
norm_num AS (SELECT id, num_text, ({num_sql('s')}) / CASE WHEN pct THEN 100 ELSE 1 END AS num FROM n5)"""

NORM_BOOL = """norm_bool AS (SELECT id, CASE WHEN lower(trim(flag_text)) IN ('true','yes','y','1','on','active','enabled') THEN true
  WHEN lower(trim(flag_text)) IN ('false','no','n','0','off','inactive','disabled') THEN false END AS flag FROM messy)"""


def _first_monday(y: str) -> str:
    return f"(make_date({y}, 1, 1) + CAST((8 - isodow(make_date({y}, 1, 1))) % 7 AS INTEGER))"


_Y = "CAST(right(date_text, 4) AS INTEGER)"
PARSE = f"""norm_date AS (SELECT id, date_text, CAST(CASE id % 12
  WHEN 0 THEN CAST(date_text AS DATE) WHEN 1 THEN strptime(date_text, '%Y/%m/%d') WHEN 2 THEN strptime(date_text, '%m/%d/%Y')
  WHEN 3 THEN strptime(date_text, '%m-%d-%Y') WHEN 4 THEN strptime(date_text[:6] || '20' || right(date_text, 2), '%m/%d/%Y')
  WHEN 5 THEN strptime(date_text, '%B %d, %Y') WHEN 6 THEN strptime(date_text, '%d %b %Y')
  WHEN 7 THEN {_first_monday(_Y)} + 7 * (CAST(date_text[2:3] AS INTEGER) - 1)
  WHEN 8 THEN {_first_monday("CAST(left(date_text, 4) AS INTEGER)")} + 7 * (CAST(right(date_text, 2) AS INTEGER) - 1)
  WHEN 9 THEN make_date({_Y}, CAST(date_text[2] AS INTEGER) * 3 - 2, 1)
  WHEN 10 THEN CAST(date_text[:10] AS DATE) END AS DATE) AS day FROM messy)"""


@query("cln1_clean_numeric", "id:i num:f4", f"""
{ctes('messy')} SELECT id, {num_sql('t')} AS num FROM {CLEAN_NUM}""")
def _(spark, d):
    return panel(spark, d, "messy").select("id", C.clean_numeric(F.col("num_text")).alias("num"))


@query("cln2_normalize_numeric", "id:i num_text:s num:f6", f"""
{ctes('messy')}, {NORM_NUM} SELECT * FROM norm_num""")
def _(spark, d):
    return panel(spark, d, "messy").select("id", "num_text", C.normalize_numeric(F.col("num_text")).alias("num"))


@query("cln3_normalize_boolean", "id:i flag:b", f"""
{ctes('messy')}, {NORM_BOOL} SELECT * FROM norm_bool""")
def _(spark, d):
    return panel(spark, d, "messy").select("id", C.normalize_boolean(F.col("flag_text")).alias("flag"))


NORM_STR = """norm_str AS (SELECT id, nullif(trim(regexp_replace(replace(replace(replace(str_text, chr(160), ' '), chr(8203), ''), chr(65279), ''),
  '\\s+', ' ', 'g')), '') AS txt FROM messy)"""


@query("cln4_normalize_string", "id:i txt:s", f"""
{ctes('messy')}, {NORM_STR} SELECT * FROM norm_str""")
def _(spark, d):
    return panel(spark, d, "messy").select("id", C.normalize_string(F.col("str_text")).alias("txt"))


@query("cln5_parse_date", "id:i date_text:s day:d", f"""
{ctes('messy')}, {PARSE} SELECT id, date_text, day FROM norm_date""")
def _(spark, d):
    return panel(spark, d, "messy").select("id", "date_text", D.parse_date(F.col("date_text")).alias("day"))


_FMT = """CASE id % 12 WHEN 0 THEN 'iso' WHEN 1 THEN 'ymd_slash' WHEN 2 THEN 'mdy_slash' WHEN 3 THEN 'mdy_dash' WHEN 4 THEN 'mdy2_slash'
 WHEN 5 THEN 'month_name' WHEN 6 THEN 'day_month_name' WHEN 7 THEN 'week' WHEN 8 THEN 'year_week' WHEN 9 THEN 'quarter' WHEN 10 THEN 'iso_time' END"""


@query("cln6_date_format_stats", "format:s n:i is_ambiguous:b likely_dayfirst:b parse_rate:f6", f"""
{ctes('messy')}, f AS (SELECT id, {_FMT} AS format, CASE WHEN id % 12 IN (2, 3, 4) THEN CAST(date_text[4:5] AS INTEGER) <= 12 ELSE false END AS amb FROM messy),
t AS (SELECT count(*) AS n_all, count(format) AS ok, count(*) FILTER (amb) AS amb FROM f)
SELECT format, count(*) AS n, any_value(t.amb > n_all * 0.5) AS is_ambiguous, false AS likely_dayfirst, any_value(ok / n_all) AS parse_rate
FROM f, t WHERE format IS NOT NULL GROUP BY format""")
def _(spark, d):
    return N.date_format_stats(panel(spark, d, "messy"), "date_text")


_VOTE_COLS = ["num_text", "date_text", "flag_text", "str_text", "us_date", "comma_num", "id"]


@query("cln7_infer_column_types", "column:s type:s subtype:s confidence:f6", f"""
{ctes('messy')}, {NORM_NUM}, {NORM_BOOL}, {PARSE},
r AS (SELECT count(*) AS n, count(num) / count(*) AS num_num, (SELECT count(day) FROM norm_date) / count(*) AS date_date,
 (SELECT count(flag) FROM norm_bool) / count(*) AS flag_bool FROM norm_num),
z AS (SELECT count(*) FILTER (lower(trim(flag_text)) IN ('0', '1')) / count(*) AS flag_num FROM messy)
SELECT 'num_text' AS "column", CASE WHEN num_num > 0.8 THEN 'numeric' ELSE 'string' END AS type, CASE WHEN num_num > 0.8 THEN 'currency' END AS subtype,
 CASE WHEN num_num > 0.8 THEN num_num ELSE 1 - num_num END AS confidence FROM r
UNION ALL SELECT 'date_text', CASE WHEN date_date > 0.8 THEN 'datetime' ELSE 'string' END, NULL, date_date FROM r
UNION ALL SELECT 'flag_text', CASE WHEN flag_bool > 0.9 THEN 'boolean' ELSE 'string' END, NULL, CASE WHEN flag_bool > 0.9 THEN flag_bool ELSE 1 - greatest(flag_bool, flag_num) END FROM r, z
UNION ALL SELECT 'str_text', 'string', NULL, 1 UNION ALL SELECT 'us_date', 'datetime', NULL, 1
UNION ALL SELECT 'comma_num', 'numeric', 'number', 1 UNION ALL SELECT 'id', 'numeric', NULL, 1""")
def _(spark, d):
    return N.infer_column_types(panel(spark, d, "messy").select(*_VOTE_COLS))


@query("cln8_normalize_table", "id:i num_text:f6 us_date:d flag_text:b str_text:s comma_num:f2", f"""
{ctes('messy')}, {NORM_NUM}, {NORM_BOOL}, {NORM_STR}
SELECT m.id, n.num AS num_text, strptime(m.us_date, '%m/%d/%Y') AS us_date, b.flag AS flag_text, s.txt AS str_text, CAST(replace(comma_num, ',', '') AS DOUBLE) AS comma_num
FROM messy m JOIN norm_num n USING (id) JOIN norm_bool b USING (id) JOIN norm_str s USING (id)""")
def _(spark, d):
    df = panel(spark, d, "messy").select("id", "num_text", "us_date", "flag_text", "str_text", "comma_num")
    return N.normalize_table(df, types={"id": "numeric", "num_text": "numeric", "us_date": "datetime", "flag_text": "boolean",
                                        "str_text": "string", "comma_num": "numeric"})[0]


@query("cln8_normalize_report", "column:s type:s failed:i", f"""
{ctes('messy')}, {NORM_NUM}, {PARSE}
SELECT 'num_text' AS "column", 'numeric' AS type, count(*) - count(num) AS failed FROM norm_num
UNION ALL SELECT 'date_text', 'datetime', count(*) - count(day) FROM norm_date
UNION ALL SELECT 'comma_num', 'numeric', 0""")
def _(spark, d):
    df = panel(spark, d, "messy").select("num_text", "date_text", "comma_num")
    return N.normalize_table(df, date_cols=["date_text"], numeric_cols=["num_text"])[1]


@query("cln9_coerce_numeric_columns", "id:i comma_num:f2 code_text:s", f"""
{ctes('messy')} SELECT id, CAST(replace(comma_num, ',', '') AS DOUBLE) AS comma_num, code_text FROM messy""")
def _(spark, d):
    return N.coerce_numeric_columns(panel(spark, d, "messy").select("id", "comma_num", "code_text"))


@query("cln10_typed_value", "id:i code_text:s num:f4", f"""
{ctes('messy')} SELECT id, code_text, CASE WHEN NOT (starts_with(code_text, '0') AND code_text <> '0' AND NOT starts_with(code_text, '0.')) THEN {num_sql('code_text')} END AS num FROM messy""")
def _(spark, d):
    return panel(spark, d, "messy").select("id", "code_text", C.typed_value(F.col("code_text")).alias("num"))


@query("cln11_sanitize", "series:s ds:d y:f4 mape:f4", f"""
{ctes('daily')} SELECT series, ds, CASE WHEN day(ds) IN (5, 7) THEN 0 ELSE y END AS y, CASE WHEN day(ds) IN (5, 9) THEN 100 ELSE CAST(n AS DOUBLE) END AS mape FROM daily""")
def _(spark, d):
    day = F.dayofmonth("ds")
    df = panel(spark, d, "daily").select(
        "series", "ds", F.when(day == 5, float("nan")).when(day == 7, float("inf")).otherwise(F.col("y")).alias("y"),
        F.when(day == 5, float("-inf")).when(day == 9, None).otherwise(F.col("n").cast("double")).alias("mape"))
    return N.sanitize(df, ["y", "mape"])


# ---- scalar functions --------------------------------------------------------------------


@query("scl1_date_parts", "id:i wd:i weekend:i month:i quarter:i day:i week:i year:i", """
SELECT o_orderkey AS id, isodow(o_orderdate) - 1 AS wd, CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS weekend, month(o_orderdate) AS month,
quarter(o_orderdate) AS quarter, day(o_orderdate) AS day, week(o_orderdate) AS week, year(o_orderdate) AS year FROM orders""")
def _(spark, d):
    o = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.weekday(o).alias("wd"), (F.weekday(o) >= 5).cast("int").alias("weekend"), F.month(o).alias("month"),
        F.quarter(o).alias("quarter"), F.dayofmonth(o).alias("day"), F.weekofyear(o).alias("week"), F.year(o).alias("year"))


@query("scl2_period_edges", "ds:d is_month_start:i is_month_end:i is_quarter_start:i is_quarter_end:i week_of_month:i", f"""
{ctes('daily_total')} SELECT ds, CAST(day(ds) = 1 AS INTEGER) AS is_month_start, CAST(ds = last_day(ds) AS INTEGER) AS is_month_end,
CAST(ds = date_trunc('quarter', ds) AS INTEGER) AS is_quarter_start, CAST(ds + 1 = date_trunc('quarter', ds + 1) AS INTEGER) AS is_quarter_end,
(day(ds) - 1) // 7 + 1 AS week_of_month FROM daily_total""")
def _(spark, d):
    from ..operators.calendar import period_edges

    return panel(spark, d, "daily_total").select("ds", *period_edges(F.col("ds")))


@query("scl3_date_arithmetic", "ds:d plus_days:d plus_weeks:d plus_months:d third_friday:d week_start:d", f"""
{ctes('daily_total')} SELECT ds, ds + 10 AS plus_days, ds + 21 AS plus_weeks, ds + INTERVAL 5 MONTH AS plus_months,
date_trunc('month', ds) + to_days(CAST((12 - isodow(date_trunc('month', ds))) % 7 + 14 AS INTEGER)) AS third_friday, date_trunc('week', ds) AS week_start FROM daily_total""")
def _(spark, d):
    c = F.col("ds")
    return panel(spark, d, "daily_total").select(
        "ds", F.date_add(c, 10).alias("plus_days"), F.date_add(c, 21).alias("plus_weeks"), F.add_months(c, 5).alias("plus_months"),
        F.date_add(F.next_day(F.date_sub(F.trunc(c, "month"), 1), "FRI"), 14).alias("third_friday"), D.week_start(c).alias("week_start"))


@query("scl4_easter", "year:i easter:d n_orders:i", f"""
WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n_orders FROM orders GROUP BY 1), {EASTER}
SELECT y AS year, d AS easter, n_orders FROM y LEFT JOIN ea ON year(d) = y""")
def _(spark, d):
    years = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n_orders"))
    return years.withColumn("easter", D.easter(F.col("year")))


@query("scl5_math", "id:i a:f6 s:f6 c:f6 l:f6 e:f6 x:f6 g:f6 w:f6", """
SELECT l_orderkey * 10 + l_linenumber AS id, abs(l_quantity - 25) AS a, sqrt(l_quantity) AS s, least(greatest(l_quantity, 10), 40) AS c, ln(1 + l_quantity) AS l,
exp(l_discount) - 1 AS e, exp(-l_discount) AS x, log2(l_quantity) AS g, sin(2 * pi() * l_quantity / 52) + cos(2 * pi() * l_quantity / 52) AS w FROM lineitem""")
def _(spark, d):
    q, disc = F.col("l_quantity"), F.col("l_discount")
    ang = 2 * F.pi() * q / 52
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.abs(q - 25).alias("a"), F.sqrt(q).alias("s"),
        F.least(F.greatest(q, F.lit(10.0)), F.lit(40.0)).alias("c"), F.log1p(q).alias("l"), F.expm1(disc).alias("e"), F.exp(-disc).alias("x"),
        F.log2(q).alias("g"), (F.sin(ang) + F.cos(ang)).alias("w"))


@query("scl6_strings", "p_partkey:i title:s first_word:s is_ring:b label:s slug:s", """
SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS title, split_part(p_name, ' ', 1) AS first_word,
regexp_matches(p_name, 'ring$') AS is_ring, concat_ws(' | ', 'brand=' || p_brand, 'type=' || p_type) AS label, lower(replace(trim(p_brand), '#', '-')) AS slug FROM part""")
def _(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", F.initcap(n).alias("title"), F.split(n, " ")[0].alias("first_word"), n.rlike("ring$").alias("is_ring"),
        F.concat_ws(" | ", F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit("type="), "p_type")).alias("label"),
        F.lower(F.replace(F.trim("p_brand"), F.lit("#"), F.lit("-"))).alias("slug"))


@query("scl7_json", "event_id:i k:i payload:s", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"type":"' || event_type || '","user":' || user_id || '}' AS payload FROM events""")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"),
        F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("payload"))


@query("scl8_arrays", "series:s first3:a last_ds:d any_big:b all_pos:b one:f4", f"""
{ctes('monthly')}, l AS (SELECT series, list(ds ORDER BY ds) AS dl, list(y ORDER BY ds) AS yl FROM monthly GROUP BY series)
SELECT series, list_transform(dl[1:3], lambda x: CAST(x AS VARCHAR)) AS first3, dl[-1] AS last_ds, len(list_filter(yl, lambda v: v > 20000)) > 0 AS any_big,
len(list_filter(yl, lambda v: v > 0)) = len(yl) AS all_pos, yl[2] AS one FROM l""")
def _(spark, d):
    rows = panel(spark, d, "monthly").groupBy("series").agg(F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("a"))
    return rows.select(
        "series", F.transform(F.slice("a", 1, 3), lambda x: x["ds"].cast("string")).alias("first3"), F.element_at("a", -1)["ds"].alias("last_ds"),
        F.exists("a", lambda x: x["y"] > 20000).alias("any_big"), F.forall("a", lambda x: x["y"] > 0).alias("all_pos"), F.element_at("a", 2)["y"].alias("one"))


@query("scl9_hash", "id:i sha:s short:s", """
SELECT o_orderkey AS id, sha256(o_orderkey || '|' || o_orderstatus) AS sha, left(sha256(o_orderkey || '|' || o_orderstatus), 16) AS short FROM orders""")
def _(spark, d):
    h = F.sha2(F.concat_ws("|", "o_orderkey", "o_orderstatus"), 256)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), h.alias("sha"), F.substring(h, 1, 16).alias("short"))


@query("scl10_critical_values", "l_orderkey:i n:i critical:f6 tail:f8", f"""
WITH q AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) / 10 AS v FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n, CASE n {' '.join(f'WHEN {k} THEN {ST.t_critical(0.95, k - 1)!r}' for k in range(2, 30))} WHEN 1 THEN NULL ELSE {ST.z_critical(0.95)!r} END AS critical,
exp(-v / 2) * (1 + v / 2 + (v / 2) ** 2 / 2 + (v / 2) ** 3 / 6 + (v / 2) ** 4 / 24) AS tail FROM q""")
def _(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), (F.sum("l_quantity") / 10).alias("v"))
    return rows.select("l_orderkey", "n", ST.critical_value(F.col("n"), 0.95).alias("critical"), ST.chi2_tail_even(F.col("v"), 10).alias("tail"))
