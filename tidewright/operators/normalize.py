"""Whole-table cleaning: date-format census, type vote, normalisation with a failure report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import dates as D
from .columns import is_numeric, kinds, per_column


def date_format_stats(df: DataFrame, col: str) -> DataFrame:
    """Per text form: rows; plus the column's ambiguity, day-first hint and parse rate on every row."""
    s = F.trim(F.col(col))
    two = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})$"
    a, b = (F.regexp_extract(s, two, i).try_cast("int") for i in (1, 2))
    filled = F.col(col).isNotNull() & (F.col(col) != "")
    rows = df.select(
        F.when(D.parse_date(s).isNotNull(), D.date_format(s)).alias("format"), D.parse_date(s).isNotNull().alias("ok"),
        (filled & s.rlike(two) & (a <= 12) & (b <= 12)).alias("ambiguous"),
        (filled & (F.regexp_extract(F.col(col), "^([0-9]{1,2})[/-]", 1).try_cast("int") > 12)).alias("day_first"))
    per = rows.groupBy("format").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok"), F.count_if("ambiguous").alias("amb"),
        F.coalesce(F.bool_or("day_first"), F.lit(False)).alias("df"))
    total = per.agg(F.sum("n").alias("rows"), F.sum("ok").alias("ok_all"), F.sum("amb").alias("amb_all"), F.bool_or("df").alias("likely_dayfirst"))
    return per.where("format IS NOT NULL").crossJoin(F.broadcast(total)).select(
        "format", "n", (F.col("amb_all") > F.col("rows") * 0.5).alias("is_ambiguous"), "likely_dayfirst",
        (F.col("ok_all") / F.col("rows")).alias("parse_rate"))


def infer_column_types(df: DataFrame) -> DataFrame:
    """Vote of all filled values of each text column; typed columns answer for themselves."""
    types = kinds(df)

    def native(kind: str) -> str | None:
        if kind in ("date", "timestamp", "timestamp_ntz"):
            return "datetime"
        if kind == "boolean":
            return "boolean"
        return "numeric" if is_numeric(kind) else None

    def rates(c: str) -> dict[str, Column]:
        n = F.count(c).cast("double")
        kind = native(types[c])
        v = F.col(c)
        if kind or types[c] != "string":
            one = F.lit(kind or "string")
            return {"native": one, "n": n, "date_rate": F.lit(0.0), "bool_rate": F.lit(0.0), "numeric_rate": F.lit(0.0),
                    "has_currency": F.lit(False), "has_percent": F.lit(False)}
        def rate(x: Column) -> Column:
            return F.coalesce(F.try_divide(F.count(x).cast("double"), n), F.lit(0.0))

        return {"native": F.lit(None).cast("string"), "n": n, "date_rate": rate(D.parse_date(v)),
                "bool_rate": rate(C.normalize_boolean(v)), "numeric_rate": rate(C.normalize_numeric(v)),
                "has_currency": F.coalesce(F.bool_or(v.rlike(C.CURRENCY_PATTERN)), F.lit(False)),
                "has_percent": F.coalesce(F.bool_or(v.contains("%")), F.lit(False))}

    out = per_column(df, df.columns, rates)
    kind = (F.when(F.col("n") == 0, "empty").when(F.col("native").isNotNull(), F.col("native"))
            .when(F.col("date_rate") > 0.8, "datetime").when(F.col("bool_rate") > 0.9, "boolean")
            .when(F.col("numeric_rate") > 0.8, "numeric").otherwise("string"))
    out = out.withColumn("type", kind)
    sub = F.when((F.col("type") == "numeric") & F.col("native").isNull(),
                 F.when(F.col("has_currency"), "currency").when(F.col("has_percent"), "percentage").otherwise("number"))
    best = F.greatest("date_rate", "bool_rate", "numeric_rate")
    conf = (F.when((F.col("n") == 0) | F.col("native").isNotNull(), 1.0).when(F.col("type") == "datetime", F.col("date_rate"))
            .when(F.col("type") == "boolean", F.col("bool_rate")).when(F.col("type") == "numeric", F.col("numeric_rate"))
            .otherwise(1.0 - best))
    return out.select("column", "type", sub.alias("subtype"), conf.alias("confidence"))


def _normalizer(kind: str):
    return {"datetime": D.parse_date, "numeric": C.normalize_numeric, "boolean": C.normalize_boolean}.get(kind, C.normalize_string)


def normalize_table(df: DataFrame, date_cols: Sequence[str] = (), numeric_cols: Sequence[str] = (),
                    types: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cleaned table and a report of values that could not be read.  Types come from the vote unless given."""
    if types is None:
        types = {r["column"]: r["type"] for r in infer_column_types(df).collect()}  # one row per column
    types = {**types, **{c: "datetime" for c in date_cols}, **{c: "numeric" for c in numeric_cols}}
    have = kinds(df)

    def value(c: str) -> Column:
        return _normalizer(types[c])(F.col(c)) if have[c] == "string" else F.col(c)

    report = per_column(df, df.columns, lambda c: {
        "type": F.lit(types[c]), "failed": F.count_if(value(c).isNull() & F.col(c).isNotNull())})
    return df.select(*[value(c).alias(c) for c in df.columns]), report


def coerce_numeric_columns(df: DataFrame) -> DataFrame:
    """Text columns whose every value looks like a number with commas become double."""
    text = [c for c, k in df.dtypes if k == "string"]
    if not text:
        return df
    row = df.agg(*[F.bool_and(F.col(c).rlike(C.COMMA_NUMBER)).alias(c) for c in text]).first()
    return df.withColumns({c: C.clean_numeric(F.col(c)) for c in text if row[c]})


def sanitize(df: DataFrame, cols: Sequence[str] | Mapping[str, float]) -> DataFrame:
    """NaN and infinite values become a default (0, or 100 for error columns)."""
    if not isinstance(cols, Mapping):
        cols = {c: 100.0 if "mape" in c.lower() else 0.0 for c in cols}
    return df.withColumns({c: C.finite(F.col(c), v) for c, v in cols.items()})
