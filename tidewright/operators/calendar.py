"""Calendar and holiday features.

Everything that depends on the date alone is a column expression: no table is joined and nothing is
shuffled, however many series there are.  Public holidays follow the federal rules; a fixed-date holiday
on a Saturday or Sunday is also observed on the Friday or Monday beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from . import joins as J
from . import windows as WN
from .base import Keys, join_on_keys

# fixed values -----------------------------------------------------------------------------
FIXED = {
    "new_years": (1, 1), "valentines": (2, 14), "july4": (7, 4), "halloween": (10, 31), "christmas_eve": (12, 24),
    "christmas": (12, 25), "new_years_eve": (12, 31),
    "fiscal_q1_end": (3, 31), "fiscal_q2_end": (6, 30), "fiscal_q3_end": (9, 30),
}
WINDOWS = {  # holiday: days before, days after
    "thanksgiving": (-1, 3), "christmas": (-7, 1), "black_friday": (0, 2), "new_years": (-1, 1), "super_bowl": (-1, 0),
    "july4": (-1, 1), "labor_day": (-2, 0), "memorial_day": (-2, 0), "easter": (-1, 1), "valentines": (-2, 0),
    "halloween": (-1, 0), "mothers_day": (-1, 0), "fathers_day": (-1, 0),
}
TRACKED = ("thanksgiving", "christmas", "black_friday", "easter", "super_bowl")
PUBLIC_WEEKS = ("new_years", "mlk", "presidents", "memorial", "july4", "labor", "columbus", "veterans", "thanksgiving", "christmas")
PROXIMITY_WEEKS = 2
FAR_WEEKS = 99
FAR_DAYS = 365
# ------------------------------------------------------------------------------------------


def _fixed(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


# rules of the moving holidays, and of all public ones on their own dates
_MOVING = {
    "thanksgiving": D.thanksgiving, "black_friday": lambda y: F.date_add(D.thanksgiving(y), 1), "easter": D.easter, "super_bowl": D.super_bowl,
    "mothers_day": lambda y: F.date_add(D.first_weekday(y, 5, "SUN"), 7), "fathers_day": lambda y: F.date_add(D.first_weekday(y, 6, "SUN"), 14),
    "memorial_day": lambda y: D.last_monday(y, 5), "labor_day": lambda y: D.first_weekday(y, 9, "MON"),
}
_PUBLIC = {
    "new_years": lambda y: _fixed(y, 1, 1), "mlk": lambda y: F.date_add(D.first_weekday(y, 1, "MON"), 14),
    "presidents": lambda y: F.date_add(D.first_weekday(y, 2, "MON"), 14), "memorial": lambda y: D.last_monday(y, 5),
    "juneteenth": lambda y: F.when(y >= 2021, _fixed(y, 6, 19)), "july4": lambda y: _fixed(y, 7, 4),
    "labor": lambda y: D.first_weekday(y, 9, "MON"), "columbus": lambda y: F.date_add(D.first_weekday(y, 10, "MON"), 7),
    "veterans": lambda y: _fixed(y, 11, 11), "thanksgiving": D.thanksgiving, "christmas": lambda y: _fixed(y, 12, 25),
}
KEY_HOLIDAYS = (*FIXED, *_MOVING)


def key_holiday(name: str, year: Column) -> Column:
    """Date of a key holiday in a year."""
    return _fixed(year, *FIXED[name]) if name in FIXED else _MOVING[name](year)


def public_holiday(name: str, year: Column) -> Column:
    return _PUBLIC[name](year)


def observed(date: Column) -> Column:
    """Weekday on which a fixed-date holiday is observed."""
    wd = F.weekday(date)
    return F.when(wd == 5, F.date_sub(date, 1)).when(wd == 6, F.date_add(date, 1)).otherwise(date)


_OBSERVED = ("new_years", "juneteenth", "july4", "veterans", "christmas")


def years_table(spark: SparkSession, y0: int, y1: int) -> DataFrame:
    return spark.range(y0, y1 + 1).select(F.col("id").cast("int").alias("year"))


def years_of(df: DataFrame, ds: str = "ds", pad: int = 0) -> DataFrame:
    """Years a table touches, widened by ``pad`` either side; one small aggregate."""
    span = df.agg(F.year(F.min(ds)).alias("lo"), F.year(F.max(ds)).alias("hi"))
    return span.select(F.explode(F.sequence(F.col("lo") - pad, F.col("hi") + pad)).alias("year"))


def holiday_dim(years: DataFrame) -> DataFrame:
    """``(year, holiday, ds)`` for each year: at most eighteen rows a year."""
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("holiday"), key_holiday(n, F.col("year")).alias("ds")) for i, n in enumerate(KEY_HOLIDAYS)])
    return years.select("year", F.inline(rows))


def holiday_windows(years: DataFrame, days: bool = True) -> DataFrame:
    """Holidays with their effect windows; with ``days`` one row per affected day and its offset."""
    lower = F.create_map(*[F.lit(x) for n, (lo, _) in WINDOWS.items() for x in (n, lo)])
    upper = F.create_map(*[F.lit(x) for n, (_, hi) in WINDOWS.items() for x in (n, hi)])
    out = holiday_dim(years).where(F.col("holiday").isin(*WINDOWS)).select(
        "year", "holiday", "ds", lower[F.col("holiday")].alias("lower_window"), upper[F.col("holiday")].alias("upper_window"))
    if not days:
        return out
    return out.withColumn("offset", F.explode(F.sequence("lower_window", "upper_window"))).withColumn("day", F.date_add("ds", F.col("offset")))


def holiday_weeks(years: DataFrame) -> DataFrame:
    """Mondays of the weeks holding one of ten public holidays, on the day itself or where observed."""
    parts = []
    for n in PUBLIC_WEEKS:
        day = public_holiday(n, F.col("year"))
        for d in (day, observed(day)) if n in _OBSERVED else (day,):
            parts.append(F.struct(F.lit(n).alias("holiday"), D.week_start(d).alias("week_start")))
    return years.select(F.inline(F.array(*parts))).distinct()


def period_edges(ds: Column) -> list[Column]:
    """Flags of the first and last day of months and quarters, and the week of the month."""
    q0 = F.trunc(ds, "quarter")
    return [
        (F.dayofmonth(ds) == 1).cast("int").alias("is_month_start"), (ds == F.last_day(ds)).cast("int").alias("is_month_end"),
        (ds == q0).cast("int").alias("is_quarter_start"), (F.date_add(ds, 1) == F.add_months(q0, 3)).cast("int").alias("is_quarter_end"),
        D.week_of_month(ds).alias("week_of_month")]


def add_calendar(df: DataFrame, ds: str = "ds", edges: bool = False) -> DataFrame:
    """Weekday (Monday 0), weekend flag, month, quarter, day, ISO week; with ``edges`` the tree model's set."""
    c = F.col(ds)
    cols = {
        "day_of_week": F.weekday(c), "is_weekend": (F.weekday(c) >= 5).cast("int"), "month": F.month(c), "quarter": F.quarter(c),
        "day_of_month": F.dayofmonth(c), "week_of_year": F.weekofyear(c)}
    out = df.select("*", *[v.alias(k) for k, v in cols.items() if k not in df.columns])
    return out.select("*", *period_edges(c)) if edges else out


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def is_public_holiday(ds: Column) -> Column:
    """Is the day a federal holiday or the weekday one is observed on."""
    m, d, wd = F.month(ds), F.dayofmonth(ds), F.weekday(ds)

    def fixed(day: Column) -> Column:
        mm, dd = F.month(day), F.dayofmonth(day)
        return ((mm == 1) & (dd == 1)) | ((mm == 6) & (dd == 19) & (F.year(day) >= 2021)) | ((mm == 7) & (dd == 4)) | (
            (mm == 11) & (dd == 11)) | ((mm == 12) & (dd == 25))

    monday = (wd == 0) & (((m == 1) & d.between(15, 21)) | ((m == 2) & d.between(15, 21)) | ((m == 5) & (d >= 25)) | ((m == 9) & (d <= 7)) | (
        (m == 10) & d.between(8, 14)))
    thursday = (wd == 3) & (m == 11) & d.between(22, 28)
    beside = ((wd == 4) & fixed(F.date_add(ds, 1))) | ((wd == 0) & fixed(F.date_sub(ds, 1)))
    return fixed(ds) | monday | thursday | beside


def days_to(ds: Column, name: str) -> Column:
    """Days to the next occurrence, the day itself counting 0, at most 365."""
    y = F.year(ds)
    here = key_holiday(name, y)
    nxt = F.when(here >= ds, here).otherwise(key_holiday(name, y + 1))
    return F.least(F.datediff(nxt, ds), F.lit(FAR_DAYS))


def days_since(ds: Column, name: str) -> Column:
    y = F.year(ds)
    here = key_holiday(name, y)
    prev = F.when(here <= ds, here).otherwise(key_holiday(name, y - 1))
    return F.least(F.datediff(ds, prev), F.lit(FAR_DAYS))


def holiday_distance(df: DataFrame, ds: str = "ds", names: tuple[str, ...] = TRACKED, tol: int = 3) -> DataFrame:
    """Days to and since each tracked holiday and a flag within ``tol`` days of one."""
    c = F.col(ds)
    df = df.select("*", *[x for n in names for x in (days_to(c, n).alias(f"days_to_{n}"), days_since(c, n).alias(f"days_since_{n}"))])
    return df.select("*", *[_flag((F.col(f"days_to_{n}") <= tol) | (F.col(f"days_since_{n}") <= tol)).alias(f"is_{n}_window") for n in names])


def add_daily_holidays(df: DataFrame, ds: str = "ds") -> DataFrame:
    """Holiday and adjacent-day flags, five period flags, distances and windows of the tracked holidays."""
    c = F.col(ds)
    m, d = F.month(c), F.dayofmonth(c)
    near = is_public_holiday(c) | is_public_holiday(F.date_sub(c, 1)) | is_public_holiday(F.date_add(c, 1))
    out = df.select(
        "*", _flag(is_public_holiday(c)).alias("is_holiday"), _flag(near).alias("is_holiday_adjacent"),
        _flag((m == 1) & (d <= 2)).alias("is_new_years"), _flag((m == 7) & d.between(3, 5)).alias("is_july4"),
        _flag((m == 12) & d.between(24, 26)).alias("is_christmas"), _flag((m == 11) & d.between(22, 28)).alias("is_thanksgiving_period"),
        _flag((m == 2) & (d <= 14) & (F.weekday(c) == 6)).alias("is_super_bowl_period"))
    out = holiday_distance(out, ds)
    return out if "is_weekend" in out.columns else out.withColumn("is_weekend", (F.weekday(c) >= 5).cast("int"))


def _in_week(ds: Column, dates) -> Column:
    """Does a yearly date fall into the Monday week of ds?  The week may touch two years."""
    w = D.week_start(ds)
    hit = None
    for y in (F.year(w), F.year(F.date_add(w, 6)), F.year(F.date_add(w, 7))):
        for date in dates(y):
            h = D.week_start(date) == w
            hit = h if hit is None else hit | h
    return _flag(hit)


def add_weekly_holidays(df: DataFrame, ds: str = "ds") -> DataFrame:
    """One flag per public-holiday week, and the Black Friday and Super Bowl weeks."""
    c = F.col(ds)

    def dates(name: str):
        def of(y: Column):
            day = public_holiday(name, y)
            return [day, observed(day)] if name in _OBSERVED else [day]
        return of

    return df.select(
        "*", *[_in_week(c, dates(n)).alias(f"is_{n}_week") for n in PUBLIC_WEEKS],
        _in_week(c, lambda y: [D.super_bowl(y)]).alias("is_super_bowl_week"),
        _in_week(c, lambda y: [D.thanksgiving(y)]).alias("is_black_friday_week"))


def add_proximity(df: DataFrame, ds: str = "ds") -> DataFrame:
    """Weeks to and after Thanksgiving and Christmas within two weeks (99 is far), with before and after flags."""
    w = D.week_start(F.col(ds))
    out = df
    for name, date in (("thanksgiving", D.thanksgiving), ("christmas", lambda y: _fixed(y, 12, 25))):
        # weeks after Christmas reach into January, so last year's date counts too
        offs = [(F.datediff(w, D.week_start(date(F.year(w) + k))) / 7).cast("int") for k in (0, -1)]
        off = F.coalesce(*[F.when(F.abs(o) <= PROXIMITY_WEEKS, o) for o in offs])
        out = out.withColumn("_off", off)
        out = out.withColumns({
            f"weeks_to_{name}": F.when(F.col("_off") <= 0, -F.col("_off")).otherwise(FAR_WEEKS),
            f"weeks_after_{name}": F.when(F.col("_off") > 0, F.col("_off")).otherwise(FAR_WEEKS),
            f"is_pre_{name}": _flag(F.col("_off") < 0), f"is_post_{name}": _flag(F.col("_off") > 0)}).drop("_off")
    return out


def _add_holidays(df: DataFrame, freq: str) -> DataFrame:
    if freq == "monthly":
        return df
    return add_daily_holidays(df) if freq == "daily" else df.transform(add_weekly_holidays).transform(add_proximity)


def enhance(df: DataFrame, keys: Keys, freq: str, y: str = "y") -> DataFrame:
    """Feature table of history: calendar, time index and year, holidays (not monthly), year-over-year lag."""
    out = add_calendar(df).withColumns({"time_index": WN.position(keys), "year": F.year("ds")})
    return WN.add_yoy(_add_holidays(out, freq), keys, freq, y)


def future_features(fut: DataFrame, hist: DataFrame, keys: Keys, freq: str, y: str = "y") -> DataFrame:
    """Feature table of future dates; the time index continues and lags are looked up by date."""
    n = hist.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = join_on_keys(add_calendar(fut), n, keys, "left")
    out = out.withColumns({"time_index": F.coalesce("_n", F.lit(0)) + WN.position(keys), "year": F.year("ds")}).drop("_n")
    return J.yoy_lookup(_add_holidays(out, freq), hist, keys, freq, y)
