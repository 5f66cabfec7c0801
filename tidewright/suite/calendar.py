"""Calendar and holiday features."""

from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import joins as J
from .panels import ctes, panel
from .registry import query

K = ["series"]

# fixed values: the Easter Sundays of 1990 to 2030
EASTER_DATES = """
1990-04-15 1991-03-31 1992-04-19 1993-04-11 1994-04-03 1995-04-16 1996-04-07 1997-03-30 1998-04-12 1999-04-04 2000-04-23 2001-04-15
2002-03-31 2003-04-20 2004-04-11 2005-03-27 2006-04-16 2007-04-08 2008-03-23 2009-04-12 2010-04-04 2011-04-24 2012-04-08 2013-03-31
2014-04-20 2015-04-05 2016-03-27 2017-04-16 2018-04-01 2019-04-21 2020-04-12 2021-04-04 2022-04-17 2023-04-09 2024-03-31 2025-04-20
2026-04-05 2027-03-28 2028-04-16 2029-04-01 2030-04-21
""".split()
# every key holiday by an independent rule over generated days
EASTER = "ea AS (SELECT unnest([" + ", ".join(f"DATE '{x}'" for x in EASTER_DATES) + "]) AS d)"
HOL = EASTER + """,
days AS (SELECT CAST(d AS DATE) AS d FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS d)),
hol AS (SELECT d AS ds, year(d) AS year, unnest(list_filter([
 CASE WHEN month(d) = 1 AND day(d) = 1 THEN 'new_years' END, CASE WHEN month(d) = 2 AND day(d) = 14 THEN 'valentines' END,
 CASE WHEN month(d) = 7 AND day(d) = 4 THEN 'july4' END, CASE WHEN month(d) = 10 AND day(d) = 31 THEN 'halloween' END,
 CASE WHEN month(d) = 12 AND day(d) = 24 THEN 'christmas_eve' END, CASE WHEN month(d) = 12 AND day(d) = 25 THEN 'christmas' END,
 CASE WHEN month(d) = 12 AND day(d) = 31 THEN 'new_years_eve' END, CASE WHEN month(d) = 3 AND day(d) = 31 THEN 'fiscal_q1_end' END,
 CASE WHEN month(d) = 6 AND day(d) = 30 THEN 'fiscal_q2_end' END, CASE WHEN month(d) = 9 AND day(d) = 30 THEN 'fiscal_q3_end' END,
 CASE WHEN month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28 THEN 'thanksgiving' END,
 CASE WHEN month(d) = 11 AND isodow(d) = 5 AND day(d) BETWEEN 23 AND 29 THEN 'black_friday' END,
 CASE WHEN d IN (SELECT ea.d FROM ea) THEN 'easter' END,
 CASE WHEN month(d) = 2 AND isodow(d) = 7 AND (day(d) - 1) // 7 = CASE WHEN year(d) >= 2022 THEN 1 ELSE 0 END THEN 'super_bowl' END,
 CASE WHEN month(d) = 5 AND isodow(d) = 7 AND day(d) BETWEEN 8 AND 14 THEN 'mothers_day' END,
 CASE WHEN month(d) = 6 AND isodow(d) = 7 AND day(d) BETWEEN 15 AND 21 THEN 'fathers_day' END,
 CASE WHEN month(d) = 5 AND isodow(d) = 1 AND day(d) >= 25 THEN 'memorial_day' END,
 CASE WHEN month(d) = 9 AND isodow(d) = 1 AND day(d) <= 7 THEN 'labor_day' END], lambda x: x IS NOT NULL)) AS holiday FROM days)"""
PUBLIC = """fixeddays AS (SELECT d, CASE WHEN month(d) = 1 AND day(d) = 1 THEN 'new_years' WHEN month(d) = 6 AND day(d) = 19 AND year(d) >= 2021 THEN 'juneteenth'
 WHEN month(d) = 7 AND day(d) = 4 THEN 'july4' WHEN month(d) = 11 AND day(d) = 11 THEN 'veterans' WHEN month(d) = 12 AND day(d) = 25 THEN 'christmas' END AS holiday FROM days),
pub AS (SELECT d, holiday FROM fixeddays WHERE holiday IS NOT NULL
 UNION SELECT CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END, holiday FROM fixeddays WHERE holiday IS NOT NULL
 UNION SELECT d, CASE WHEN isodow(d) = 1 AND month(d) = 1 AND day(d) BETWEEN 15 AND 21 THEN 'mlk' WHEN isodow(d) = 1 AND month(d) = 2 AND day(d) BETWEEN 15 AND 21 THEN 'presidents'
  WHEN isodow(d) = 1 AND month(d) = 5 AND day(d) >= 25 THEN 'memorial' WHEN isodow(d) = 1 AND month(d) = 9 AND day(d) <= 7 THEN 'labor'
  WHEN isodow(d) = 1 AND month(d) = 10 AND day(d) BETWEEN 8 AND 14 THEN 'columbus' WHEN isodow(d) = 4 AND month(d) = 11 AND day(d) BETWEEN 22 AND 28 THEN 'thanksgiving' END AS h FROM days WHERE h IS NOT NULL)"""


@query("hol1_holiday_dim", "year:i holiday:s ds:d revenue:f2", f"""
{ctes('daily_total')}, {HOL} SELECT hol.year, hol.holiday, hol.ds, t.y AS revenue FROM hol LEFT JOIN daily_total t USING (ds)
WHERE hol.year BETWEEN (SELECT year(min(ds)) FROM daily_total) AND (SELECT year(max(ds)) FROM daily_total)""")
def _(spark, d):
    t = panel(spark, d, "daily_total")
    return C.holiday_dim(C.years_of(t)).join(t.select("ds", F.col("y").alias("revenue")), "ds", "left")


_WIN = ", ".join(f"('{n}', {lo}, {hi})" for n, (lo, hi) in C.WINDOWS.items())


@query("hol2_holiday_windows", "holiday:s offset:i n_days:i avg_y:f6", f"""
{ctes('daily_total')}, {HOL}, w(holiday, lo, hi) AS (VALUES {_WIN}), x AS (SELECT holiday, ds, CAST(unnest(generate_series(lo, hi)) AS INTEGER) AS off FROM hol JOIN w USING (holiday))
SELECT holiday, off AS offset, count(*) AS n_days, avg(t.y) AS avg_y FROM x JOIN daily_total t ON t.ds = x.ds + off GROUP BY ALL""")
def _(spark, d):
    t = panel(spark, d, "daily_total")
    days = C.holiday_windows(C.years_of(t, pad=1)).select("holiday", "offset", F.col("day").alias("ds"))
    return t.join(days, "ds").groupBy("holiday", "offset").agg(F.count(F.lit(1)).alias("n_days"), F.avg("y").alias("avg_y"))


@query("hol3_holiday_weeks", "series:s ds:d holiday:s y:f5", f"""
{ctes('weekly')}, {HOL}, {PUBLIC}, pw AS (SELECT DISTINCT CAST(date_trunc('week', d) AS DATE) AS ws, holiday FROM pub WHERE holiday <> 'juneteenth')
SELECT w.series, w.ds, pw.holiday, w.y FROM weekly w JOIN pw ON w.ds = pw.ws""")
def _(spark, d):
    w = panel(spark, d, "weekly")
    return w.join(C.holiday_weeks(C.years_of(w, pad=1)).withColumnRenamed("week_start", "ds"), "ds")


@query("hol4_add_calendar", "series:s ds:d day_of_week:i is_weekend:i month:i quarter:i day_of_month:i week_of_year:i is_month_start:i is_month_end:i "
       "is_quarter_start:i is_quarter_end:i week_of_month:i", f"""
{ctes('daily')} SELECT series, ds, isodow(ds) - 1 AS day_of_week, CASE WHEN isodow(ds) > 5 THEN 1 ELSE 0 END AS is_weekend, month(ds) AS month, quarter(ds) AS quarter,
day(ds) AS day_of_month, week(ds) AS week_of_year, CAST(day(ds) = 1 AS INTEGER) AS is_month_start, CAST(day(ds + 1) = 1 AS INTEGER) AS is_month_end,
CAST(day(ds) = 1 AND month(ds) % 3 = 1 AS INTEGER) AS is_quarter_start, CAST(day(ds + 1) = 1 AND month(ds) % 3 = 0 AS INTEGER) AS is_quarter_end, (day(ds) - 1) // 7 + 1 AS week_of_month FROM daily""")
def _(spark, d):
    return C.add_calendar(panel(spark, d, "daily"), edges=True)


_DIST_COLS = " ".join(f"days_to_{n}:i days_since_{n}:i is_{n}_window:i" for n in C.TRACKED)
_DIST_SQL = ", ".join(
    f"least((SELECT min(h.ds) FROM hol h WHERE h.holiday = '{n}' AND h.ds >= u.ds) - u.ds, 365) AS days_to_{n}, "
    f"least(u.ds - (SELECT max(h.ds) FROM hol h WHERE h.holiday = '{n}' AND h.ds <= u.ds), 365) AS days_since_{n}, "
    f"CAST(EXISTS (SELECT 1 FROM hol h WHERE h.holiday = '{n}' AND h.ds BETWEEN u.ds - 3 AND u.ds + 3) AS INTEGER) AS is_{n}_window" for n in C.TRACKED)


@query("jon7_holiday_distance", "series:s ds:d " + _DIST_COLS, f"""
{ctes('daily')}, {HOL}, u AS (SELECT DISTINCT ds FROM daily), f AS (SELECT u.ds, {_DIST_SQL} FROM u) SELECT daily.series, f.* FROM daily JOIN f USING (ds)""")
def _(spark, d):
    return C.holiday_distance(panel(spark, d, "daily"))


_FLAGS = ("is_holiday", "is_holiday_adjacent", "is_new_years", "is_july4", "is_christmas", "is_thanksgiving_period", "is_super_bowl_period", "is_weekend")
_DAILY_SQL = """dh AS (SELECT DISTINCT ds, CAST(ds IN (SELECT d FROM pub) AS INTEGER) AS is_holiday,
 CAST(ds IN (SELECT d FROM pub) OR ds - 1 IN (SELECT d FROM pub) OR ds + 1 IN (SELECT d FROM pub) AS INTEGER) AS is_holiday_adjacent,
 CAST(month(ds) = 1 AND day(ds) <= 2 AS INTEGER) AS is_new_years, CAST(month(ds) = 7 AND day(ds) IN (3, 4, 5) AS INTEGER) AS is_july4,
 CAST(month(ds) = 12 AND day(ds) IN (24, 25, 26) AS INTEGER) AS is_christmas, CAST(month(ds) = 11 AND day(ds) BETWEEN 22 AND 28 AS INTEGER) AS is_thanksgiving_period,
 CAST(month(ds) = 2 AND day(ds) <= 14 AND isodow(ds) = 7 AS INTEGER) AS is_super_bowl_period, CAST(isodow(ds) > 5 AS INTEGER) AS is_weekend FROM daily)"""


@query("hol5_add_daily_holidays", "series:s ds:d " + " ".join(f"{c}:i" for c in _FLAGS) + " days_to_easter:i", f"""
{ctes('daily')}, {HOL}, {PUBLIC}, {_DAILY_SQL}, e AS (SELECT ds, least((SELECT min(h.ds) FROM hol h WHERE h.holiday = 'easter' AND h.ds >= dh.ds) - dh.ds, 365) AS days_to_easter FROM dh)
SELECT daily.series, dh.*, e.days_to_easter FROM daily JOIN dh USING (ds) JOIN e USING (ds)""")
def _(spark, d):
    return C.add_daily_holidays(panel(spark, d, "daily"))


_WEEK_FLAGS = [f"is_{n}_week" for n in C.PUBLIC_WEEKS]
_WEEK_SQL = """pw AS (SELECT DISTINCT CAST(date_trunc('week', d) AS DATE) AS ws, holiday FROM pub UNION SELECT CAST(date_trunc('week', ds) AS DATE), holiday || '_key' FROM hol)"""
_WEEK_SELECT = ", ".join(
    [f"CAST(EXISTS (SELECT 1 FROM pw WHERE ws = date_trunc('week', u.ds) AND holiday = '{n}') AS INTEGER) AS is_{n}_week" for n in C.PUBLIC_WEEKS]
    + ["CAST(EXISTS (SELECT 1 FROM pw WHERE ws = date_trunc('week', u.ds) AND holiday = 'super_bowl_key') AS INTEGER) AS is_super_bowl_week",
       "CAST(EXISTS (SELECT 1 FROM pw WHERE ws = date_trunc('week', u.ds) AND holiday = 'thanksgiving_key') AS INTEGER) AS is_black_friday_week"])
_ALL_WEEK = _WEEK_FLAGS + ["is_super_bowl_week", "is_black_friday_week"]


@query("hol6_add_weekly_holidays", "series:s ds:d " + " ".join(f"{c}:i" for c in _ALL_WEEK), f"""
{ctes('daily')}, {HOL}, {PUBLIC}, {_WEEK_SQL}, u AS (SELECT DISTINCT ds FROM daily), f AS (SELECT u.ds, {_WEEK_SELECT} FROM u) SELECT daily.series, f.* FROM daily JOIN f USING (ds)""")
def _(spark, d):
    return C.add_weekly_holidays(panel(spark, d, "daily"))


def _prox_sql(name):
    return (f"coalesce((SELECT min(-(CAST(date_trunc('week', u.ds) AS DATE) - CAST(date_trunc('week', h.ds) AS DATE)) // 7) FROM hol h WHERE h.holiday = '{name}' AND "
            f"CAST(date_trunc('week', h.ds) AS DATE) - CAST(date_trunc('week', u.ds) AS DATE) BETWEEN 0 AND 14), 99) AS weeks_to_{name}, "
            f"coalesce((SELECT min((CAST(date_trunc('week', u.ds) AS DATE) - CAST(date_trunc('week', h.ds) AS DATE)) // 7) FROM hol h WHERE h.holiday = '{name}' AND "
            f"CAST(date_trunc('week', u.ds) AS DATE) - CAST(date_trunc('week', h.ds) AS DATE) BETWEEN 7 AND 14), 99) AS weeks_after_{name}")


_PROX_COLS = [f"{a}_{n}" for n in ("thanksgiving", "christmas") for a in ("weeks_to", "weeks_after", "is_pre", "is_post")]
_PROX_FLAGS = ", ".join(f"CAST(weeks_to_{n} BETWEEN 1 AND 2 AS INTEGER) AS is_pre_{n}, CAST(weeks_after_{n} BETWEEN 1 AND 2 AS INTEGER) AS is_post_{n}" for n in ("thanksgiving", "christmas"))
_PROX = f"""pr AS (SELECT u.ds, {_prox_sql('thanksgiving')}, {_prox_sql('christmas')} FROM u), px AS (SELECT *, {_PROX_FLAGS} FROM pr)"""


@query("hol7_add_proximity", "series:s ds:d " + " ".join(f"{c}:i" for c in _PROX_COLS), f"""
{ctes('daily')}, {HOL}, u AS (SELECT DISTINCT ds FROM daily), {_PROX} SELECT daily.series, px.* FROM daily JOIN px USING (ds)""")
def _(spark, d):
    return C.add_proximity(panel(spark, d, "daily"))


@query("jon8_holiday_week_flags", "series:s ds:d is_thanksgiving_week:i is_christmas_week:i weeks_to_thanksgiving:i weeks_after_christmas:i", f"""
{ctes('weekly')}, {HOL}, {PUBLIC}, {_WEEK_SQL}, u AS (SELECT DISTINCT ds FROM weekly), {_PROX}, f AS (SELECT u.ds, {_WEEK_SELECT} FROM u)
SELECT weekly.series, ds, is_thanksgiving_week, is_christmas_week, weeks_to_thanksgiving, weeks_after_christmas FROM weekly JOIN px USING (ds) JOIN f USING (ds)""")
def _(spark, d):
    return panel(spark, d, "weekly").transform(C.add_weekly_holidays).transform(C.add_proximity)


_CAL = "isodow(ds) - 1 AS day_of_week, CASE WHEN isodow(ds) > 5 THEN 1 ELSE 0 END AS is_weekend, month(ds) AS month, week(ds) AS week_of_year"


@query("hol8_enhance", "series:s ds:d y:f5 day_of_week:i is_weekend:i month:i week_of_year:i time_index:i year:i is_labor_week:i weeks_to_christmas:i lag_52:f5 lag_52_avg:f7", f"""
{ctes('weekly')}, {HOL}, {PUBLIC}, {_WEEK_SQL}, u AS (SELECT DISTINCT ds FROM weekly), {_PROX}, f AS (SELECT u.ds, {_WEEK_SELECT} FROM u)
SELECT series, ds, y, {_CAL}, row_number() OVER w - 1 AS time_index, year(ds) AS year, is_labor_week, weeks_to_christmas,
CASE WHEN count(*) OVER (PARTITION BY series) >= 60 THEN lag(y, 52) OVER w END AS lag_52, CASE WHEN count(*) OVER (PARTITION BY series) >= 60 THEN avg(y) OVER (w ROWS BETWEEN 55 PRECEDING AND 52 PRECEDING) END AS lag_52_avg
FROM weekly JOIN px USING (ds) JOIN f USING (ds) WINDOW w AS (PARTITION BY series ORDER BY ds)""")
def _(spark, d):
    return C.enhance(panel(spark, d, "weekly"), K, "weekly")


@query("hol9_future_features", "series:s h:i ds:d day_of_week:i is_weekend:i month:i week_of_year:i time_index:i year:i is_holiday:i lag_364:f4", f"""
{ctes('daily')}, {HOL}, {PUBLIC}, s AS (SELECT series, unnest(generate_series(1, 40)) AS h, max(ds) AS last_ds, count(*) AS n_all FROM daily GROUP BY series),
f AS (SELECT series, h, n_all, last_ds + CAST(h AS INTEGER) AS ds FROM s), r AS (SELECT series, avg(y) AS m FROM (SELECT series, y FROM daily QUALIFY row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 364) GROUP BY series)
SELECT f.series, h, f.ds, isodow(f.ds) - 1 AS day_of_week, CASE WHEN isodow(f.ds) > 5 THEN 1 ELSE 0 END AS is_weekend, month(f.ds) AS month, week(f.ds) AS week_of_year, n_all + h - 1 AS time_index, year(f.ds) AS year,
CAST(f.ds IN (SELECT d FROM pub) AS INTEGER) AS is_holiday, coalesce(p.y, r.m, 0) AS lag_364 FROM f LEFT JOIN daily p ON p.series = f.series AND p.ds = f.ds - 364 LEFT JOIN r ON r.series = f.series""")
def _(spark, d):
    hist = panel(spark, d, "daily")
    return C.future_features(J.future_spine(hist, K, 40, "daily"), hist, K, "daily")
