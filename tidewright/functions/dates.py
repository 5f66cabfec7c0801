"""Date parsing and holiday dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import let

# fixed values -----------------------------------------------------------------------------
# accepted text forms, in the order they are tried
FORMATS: dict[str, str] = {
    "iso_time": r"^([0-9]{4})-([0-9]{2})-([0-9]{2})T",
    "iso": r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$",
    "ymd_slash": r"^([0-9]{4})/([0-9]{2})/([0-9]{2})$",
    "mdy_slash": r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$",
    "mdy_dash": r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})$",
    "mdy2_slash": r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})$",
    "mdy2_dash": r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{2})$",
    "month_name": r"^([A-Za-z]{3,9})\s+([0-9]{1,2}),?\s+([0-9]{4})$",
    "day_month_name": r"^([0-9]{1,2})\s+([A-Za-z]{3,9})\s+([0-9]{4})$",
    "week": r"^W([0-9]{1,2})\s+([0-9]{4})$",
    "quarter": r"^Q([1-4])\s+([0-9]{4})$",
    "year_week": r"^([0-9]{4})\s*W([0-9]{1,2})$",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
          "december")
# ------------------------------------------------------------------------------------------


# a time of day after a date of any form
_TIME = r"\s+[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?(\s*[AaPp]\.?[Mm]\.?)?(\s*(Z|UTC|[+-][0-9]{2}:?[0-9]{2}))?$"


def _without_time(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    return F.when(F.contains(s, F.lit(":")), F.regexp_replace(s, _TIME, "")).otherwise(s)


def first_weekday(year: Column, month: int, weekday: str) -> Column:
    """First given weekday of a month."""
    return F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), weekday)


def monday_week(year: Column, week: Column) -> Column:
    """Monday of week w where week 1 starts at the first Monday of the year; weeks above 53 are no dates."""
    return F.when(week <= 53, F.date_add(first_weekday(year, 1, "MON"), (week - 1) * 7))


def date_format(c: Column) -> Column:
    """Name of the first matching text form; a time after a date is left out."""
    s = _without_time(c)
    out = None
    for name, pat in FORMATS.items():
        out = F.when(s.rlike(pat), name) if out is None else out.when(s.rlike(pat), name)
    return out


# rewrites that bring every form to year-month-day, year-W-week or year-Q-quarter: forms of digits, forms with letters
_DIGITS = (
    (r"^([0-9]{1,2})([/-])([0-9]{1,2})\2([0-9]{2})$", "$1-$3-20$4"),
    (r"^([0-9]{1,2})([/-])([0-9]{1,2})\2([0-9]{4})$", "$4-$1-$3"),
    (FORMATS["ymd_slash"], "$1-$2-$3"),
)
_LETTERS = (
    (r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T.*$", "$1"),
    (FORMATS["month_name"], "$3-$1-$2"),
    (FORMATS["day_month_name"], "$3-$2-$1"),
    (FORMATS["week"], "$2-W-$1"),
    (FORMATS["year_week"], "$1-W-$2"),
    (FORMATS["quarter"], "$2-Q-$1"),
)


def _rewrite(s: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, form in rules:
        s = F.regexp_replace(s, pattern, form)
    return s


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date")


def parse_date(c: Column) -> Column:
    """Date of any accepted form, with or without a time after it; month and day change places when the month is impossible."""
    raw = _without_time(c)
    # only the rules a text can need are tried
    s = F.when(raw.rlike("[A-Za-z]"), _rewrite(raw, _LETTERS)).when(raw.rlike("/|^[0-9]{1,2}-"), _rewrite(raw, _DIGITS)).otherwise(raw)
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m[:3], str(i), *((m, str(i)) if len(m) > 3 else ()))])

    def read(p: Column) -> Column:
        y, m, d = p[0], p[1], p[2]
        number = d.try_cast("int")
        return (F.when(m == "W", monday_week(y.try_cast("int"), number))
                .when(m == "Q", F.make_date(y.try_cast("int"), number * 3 - 2, F.lit(1)))
                .when(m.rlike("^[0-9]+$"), F.coalesce(_ymd(y, m, d), _ymd(y, d, m)))
                .otherwise(_ymd(y, F.try_element_at(months, F.lower(m)), d)))

    # other text has no date
    known = "^[0-9]{4}-([0-9]{1,2}|[A-Za-z]{3,9}|W|Q)-[0-9]{1,2}$"
    return let(s, lambda t: let(F.when(t.rlike(known), F.split(t, "-")), read))


def easter(year: Column) -> Column:
    """Western Easter by the Gregorian computus; each step is evaluated once."""
    def div(x: Column, n: int) -> Column:
        return F.floor(x / n).cast("int")

    golden, century, yy = year % 19, div(year, 100), year % 100
    moon = (golden * 19 + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15) % 30

    def serial(epact: Column) -> Column:
        shift = (F.lit(32) + (century % 4) * 2 + div(yy, 4) * 2 - epact - yy % 4) % 7
        return let(shift, lambda s: epact + s - div(golden + epact * 11 + s * 22, 451) * 7 + 114)

    return let(let(moon, serial), lambda k: F.make_date(year, div(k, 31), k % 31 + 1))


def thanksgiving(year: Column) -> Column:
    return F.date_add(first_weekday(year, 11, "THU"), 21)


def super_bowl(year: Column) -> Column:
    """First Sunday of February, second from 2022 on."""
    first = first_weekday(year, 2, "SUN")
    return F.when(year >= 2022, F.date_add(first, 7)).otherwise(first)


def last_monday(year: Column, month: int) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(F.next_day(end, "MON"), 7)


def week_start(ds: Column) -> Column:
    """Monday of the week."""
    return F.trunc(ds, "week")


def week_of_month(ds: Column) -> Column:
    return F.floor((F.dayofmonth(ds) - 1) / 7).cast("int") + 1
