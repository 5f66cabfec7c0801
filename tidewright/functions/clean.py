"""Value cleaning as column expressions; all stay inside generated code, none needs Python rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values -----------------------------------------------------------------------------
CURRENCY = ("$", "€", "£", "¥", "₹", "USD", "EUR", "GBP")
TRUE_WORDS = ("true", "yes", "y", "1", "on", "active", "enabled")
FALSE_WORDS = ("false", "no", "n", "0", "off", "inactive", "disabled")
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
COMMA_NUMBER = r"^-?[0-9,]+[.]?[0-9]*$"
# ------------------------------------------------------------------------------------------


def to_number(c: Column) -> Column:
    """Plain decimal text to double, anything else to NULL."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def clean_numeric(c: Column) -> Column:
    """Drop commas, dollar signs and blanks, then read as a number."""
    return to_number(F.regexp_replace(c.cast("string"), r"[,$ ]", ""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


CURRENCY_PATTERN = "|".join(("[" + "".join(c for c in CURRENCY if len(c) == 1) + "]", *(c for c in CURRENCY if len(c) > 1)))


def _plain(s: Column) -> Column:
    """Text with its separators turned into at most one decimal point."""
    no_comma = F.replace(s, F.lit(","), F.lit(""))
    no_dot = F.replace(s, F.lit("."), F.lit(""))
    return (
        F.when(s.contains(",") & s.contains("."),
               F.when(s.rlike("[.][^,]*$"), no_comma).otherwise(F.replace(no_dot, F.lit(","), F.lit("."))))
        .when(s.rlike(",.*,") | s.rlike(",...$"), no_comma)
        .when(s.contains(","), F.replace(s, F.lit(","), F.lit(".")))
        .when(s.rlike("[.].*[.]"), no_dot)
        .otherwise(s))


def normalize_numeric(c: Column) -> Column:
    """Currency, percent, accounting negatives, and US or European separators."""
    raw = F.trim(c.cast("string"))
    bare = F.trim(F.regexp_replace(raw, CURRENCY_PATTERN, ""))
    share = F.when(bare.endswith("%"), 100.0).otherwise(1.0)
    body = F.regexp_replace(F.trim(F.regexp_replace(bare, "%$", "")), r"^[(](.*)[)]$", "-$1")
    # most values are plain numbers already
    return F.when(raw.rlike(NUMBER), raw.try_cast("double")).otherwise(let(body, lambda s: to_number(F.trim(_plain(s)))) / share)


def normalize_boolean(c: Column) -> Column:
    w = F.lower(F.trim(c.cast("string")))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)


def normalize_string(c: Column) -> Column:
    """Odd spaces and line ends become single blanks, zero-width marks go, empty text becomes NULL."""
    s = F.regexp_replace(c.cast("string"), "[\\u200b\\ufeff]", "")
    s = F.regexp_replace(s, "[\\u00a0\\s]+", " ")
    return F.nullif(F.trim(s), F.lit(""))


def typed_value(c: Column) -> Column:
    """Number of a text field (thousands commas allowed); NULL for text and for codes such as 0123."""
    s = F.trim(c)
    return F.when(~s.rlike("^0[^.]"), to_number(F.replace(s, F.lit(","), F.lit(""))))


def finite(c: Column, default: float | None = 0.0) -> Column:
    """NaN and infinities (and NULL) to a default."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(default).cast("double")).otherwise(c)
