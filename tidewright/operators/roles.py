"""Which column is what: date, target, frequency, dimensions, covariates, slices, events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from .base import Keys, bands, median, ordered
from .columns import few_valued, is_numeric, kinds, per_column, value_counts

# fixed values -----------------------------------------------------------------------------
DATE_NAMES = ("date", "ds", "time", "timestamp", "period", "week", "month", "day", "week_start", "week_end",
              "week_starting", "week_ending", "report_date", "transaction_date", "order_date")
TARGET_NAMES = ("revenue", "sales", "quantity", "amount", "volume", "demand", "orders", "target", "actual", "value",
                "total", "count", "tot_sub", "tot_vol", "subtotal", "subscription")
TARGET_EXACT = ("y", "Y")
NOT_TARGET = ("id", "index", "row", "year", "month", "day", "week", "quarter", "day_of_week", "is_weekend", "is_holiday")
COVARIATE_NAMES = ("spend", "cost", "expense", "rate", "margin", "percent", "pct", "ratio", "flag", "indicator", "is_",
                   "has_", "avg_", "average", "mean", "median", "fee", "discount", "price", "budget", "marketing")
HOLIDAY_NAME = (r"(?i)valentine|patrick|mother|father|easter|christmas|thanksgiving|halloween|july.?4|independence|memorial|"
                r"labor|veterans|mlk|president|black.?friday|cyber|super.?bowl|cinco|new.?year|holiday|eve$")
DATE_NAME = (r"(?i)^date$|^ds$|^time$|^week$|^month$|^period$|^year$|_date$|_time$|_week$|_month$|^datetime|timestamp|^dt$")
SKIP_SLICE = r"(?i)date|time|ds|week|month|day|year|period"
SLICE_KINDS = {
    "region": r"(?i)region|area|territory|zone|location|geo|country|state|city",
    "product": r"(?i)product|item|sku|brand",
    "category": r"(?i)category|cat|type|class|group|segment",
    "customer": r"(?i)customer|client|account|buyer",
    "channel": r"(?i)channel|source|medium|platform|store|outlet",
}
COVARIATE_KINDS = {
    "holiday": (r"(?i)holiday|easter|christmas|thanksgiving|halloween|new.?year|memorial|labor|independence|veterans|"
                r"black.?friday|cyber|super.?bowl|cinco|valentine|mother|father|mlk|president"),
    "pricing": r"(?i)price|cost|fee|rate|discount|margin",
    "promotion": r"(?i)promo|campaign|marketing|ad|event",
    "external": r"(?i)weather|temp|econ|gdp|index|rate|competitor",
}
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
# ------------------------------------------------------------------------------------------


def _one(df: DataFrame, column: str, rule: str, rate: float | None = None) -> DataFrame:
    return df.sparkSession.createDataFrame([(column, rule, rate)], "column string, rule string, score double")


def detect_date_column(df: DataFrame) -> DataFrame:
    """One row ``(column, rule, score)``: exact name, name part, over 90 % readable dates, then native date type."""
    for c in df.columns:
        if c.lower() in DATE_NAMES:
            return _one(df, c, "name")
    for c in df.columns:
        if any(p in c.lower() for p in DATE_NAMES):
            return _one(df, c, "name_part")
    types = kinds(df)
    native = [c for c in df.columns if types[c] in ("date", "timestamp", "timestamp_ntz")]
    text = [c for c in df.columns if types[c] == "string" or c in native]
    if text:
        n = F.count(F.lit(1))
        rates = per_column(df, text, lambda c: {"score": F.try_divide(
            F.count(F.col(c) if c in native else D.parse_date(F.col(c))).cast("double"), n)}).collect()
        found = {r["column"]: r["score"] for r in rates}
        for c in text:
            if (found[c] or 0) > 0.9:
                return _one(df, c, "parsed", found[c])
    if native:
        return _one(df, native[0], "native")
    raise ValueError("no date column found")


def detect_target_column(df: DataFrame, ds: str) -> DataFrame:
    """One row ``(column, rule, score)``: exact name, known names, name parts, else the largest variance."""
    types = kinds(df)
    numeric = [c for c in df.columns if is_numeric(types[c]) and c != ds and c.lower() not in NOT_TARGET]
    if not numeric:
        raise ValueError("no numeric column found")
    covariate_like = [c for c in numeric if any(p in c.lower() for p in COVARIATE_NAMES)]
    targets = [c for c in numeric if c not in covariate_like]
    line = targets + covariate_like
    for rule, test in (
        ("exact", lambda c: c in TARGET_EXACT),
        ("name", lambda c: c.lower() in TARGET_NAMES),
        ("name_part", lambda c: any(p in c.lower() for p in TARGET_NAMES)),
    ):
        for c in line:
            if test(c):
                return _one(df, c, rule)
    pool = targets or numeric
    var = per_column(df, pool, lambda c: {"rule": F.lit("variance"), "score": F.var_samp(F.col(c).cast("double")),
                                          "place": F.lit(pool.index(c))})
    return var.orderBy(F.desc_nulls_last("score"), "place").limit(1).drop("place")


def detect_frequency(df: DataFrame, keys: Keys, rule: str = "profile") -> DataFrame:
    """Frequency of each series from the gap between dates.

    ``profile`` and ``analysis`` use the median gap (of distinct dates, of rows), ``first50`` the upper
    median of the first gaps.
    """
    rows = df.select(*keys, F.col("ds").cast("date").alias("ds")).where("ds IS NOT NULL")
    if rule == "profile":
        rows = rows.distinct()
    gap = F.datediff("ds", F.lag("ds").over(ordered(keys)))
    rows = rows.select(*keys, gap.alias("gap"), F.row_number().over(ordered(keys)).alias("i"))
    if rule == "first50":
        first = rows.where("i <= 50").groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.when(F.col("i") > 1, F.col("gap")))).alias("gaps"))  # at most 49 values
        mid = F.try_element_at("gaps", (F.floor(F.size("gaps") / 2) + 1).cast("int"))
        freq = F.when(mid.isNull(), "monthly").otherwise(bands(mid, [(1.5, "daily"), (8, "weekly")], "monthly", "le"))
        return first.select(*keys, mid.cast("double").alias("median_gap"), freq.alias("frequency"))
    out = rows.groupBy(*keys).agg(F.floor(median(F.col("gap"))).cast("double").alias("median_gap"))
    m = F.col("median_gap")
    if rule == "profile":
        freq = F.when(m.isNull(), "daily").otherwise(bands(m, [(1, "daily"), (8, "weekly")], "monthly", "le"))
    elif rule == "analysis":
        freq = (F.when(m.isNull(), "unknown").when(m <= 1, "daily").when(m.between(5, 9), "weekly").when(m.between(25, 35), "monthly")
                .when(m.between(85, 95), "quarterly").when(m.between(350, 380), "yearly").otherwise("irregular"))
    else:
        raise ValueError(rule)
    return out.withColumn("frequency", freq)


def week_anchor(df: DataFrame, keys: Keys) -> DataFrame:
    """Most frequent weekday of each series (earliest weekday on ties) as a weekly frequency code."""
    days = df.groupBy(*keys, F.weekday("ds").alias("wd")).agg(F.count(F.lit(1)).alias("n"))
    best = days.groupBy(*keys).agg(F.max_by("wd", F.struct("n", -F.col("wd"))).alias("weekday"))
    names = F.array(*[F.lit(w) for w in WEEKDAYS])
    return best.withColumn("anchor", F.concat(F.lit("W-"), F.element_at(names, F.col("weekday") + 1)))


def detect_dimensions(df: DataFrame, ds: str, y: str, exclude: Sequence[str] = (), limit: int = 100) -> DataFrame:
    """One row per other column: dimension kind or numeric measure, distinct and NULL counts, five values."""
    types = kinds(df)
    cols = [c for c in df.columns if c not in (ds, y, *exclude)]
    small = few_valued(df, cols, limit)
    schema = "column string, n_unique bigint, type string, samples array<string>, null_count bigint"
    measures = [c for c in cols if c not in small and is_numeric(types[c])]
    rest = df.sparkSession.createDataFrame([(c, None, "measure", None, None) for c in measures], schema)
    if not small:
        return rest
    per = value_counts(df, small).groupBy("column").agg(
        F.count("value").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.array_sort(F.collect_list("value")).alias("all_values"))  # bounded by few_valued

    def kind(c: str) -> Column:
        if types[c] in ("string", "boolean"):
            return F.lit("categorical")
        if is_numeric(types[c]):
            return F.when(F.col("n_unique") <= 10, "flag/code").otherwise("numeric_categorical")
        return F.lit("other")

    label = F.coalesce(*[F.when(F.col("column") == c, kind(c)) for c in small])
    numeric = F.col("column").isin([c for c in small if is_numeric(types[c])])
    fits = F.col("n_unique") <= limit
    out = per.where(fits | numeric).select(
        "column", F.when(fits, F.col("n_unique")).alias("n_unique"), F.when(fits, label).otherwise("measure").alias("type"),
        F.when(fits, F.slice("all_values", 1, 5)).alias("samples"), F.when(fits, F.col("null_count")).alias("null_count"))
    return out.unionByName(rest)


def find_covariates(df: DataFrame, ds: str, y: str) -> DataFrame:
    """Numeric columns with at most 20 values or more than half filled."""
    types = kinds(df)
    cols = [c for c in df.columns if c not in (ds, y) and is_numeric(types[c])]
    out = per_column(df, cols, lambda c: {"filled": F.count(c) / F.count(F.lit(1))})
    small = few_valued(df, cols, 20)
    few = [r["column"] for r in value_counts(df, small).groupBy("column").agg(F.count("value").alias("k")).where("k <= 20").collect()] if small else []
    return out.withColumn("low_cardinality", F.col("column").isin(few) if few else F.lit(False)).where("low_cardinality OR filled > 0.5")


def classify_columns(df: DataFrame) -> DataFrame:
    """Kind of every column: holiday (name, or all 0/1), date (name or values), numeric, categorical."""
    types = kinds(df)

    def look(c: str) -> dict[str, Column]:
        v = F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string")))
        date_like = D.parse_date(v).isNotNull() & (F.length(v) >= 8) & v.rlike("[-/]")
        binary = v.isin("0", "1", "true", "false")
        leading = v.rlike(r"^[+-]?([0-9]|[.][0-9])")
        return {"binary": F.coalesce(F.bool_and(binary), F.lit(False)),
                "dates": F.lit(True) if types[c] in ("date", "timestamp", "timestamp_ntz") else F.coalesce(
                    F.bool_and(F.when(v.isNotNull(), date_like)), F.lit(False)),
                "numeric_rate": F.coalesce(F.try_divide(F.count_if(leading).cast("double"), F.count(v)), F.lit(1.0))}

    out = per_column(df, df.columns, look)
    name = F.col("column")
    date_name = name.rlike(DATE_NAME)
    kind = (F.when(name.rlike(HOLIDAY_NAME) | (F.col("binary") & ~date_name), "holiday").when(date_name, "date")
            .when(F.col("dates"), "date").when(F.col("numeric_rate") >= 0.8, "numeric").otherwise("categorical"))
    return out.select("column", kind.alias("kind"), (kind.isin("numeric") | ((kind == "holiday") & F.col("binary"))).alias("is_numeric"))


def _first_kind(name: Column, table: dict[str, str], otherwise: Column) -> Column:
    out = None
    for kind, pat in table.items():
        out = F.when(name.rlike(pat), kind) if out is None else out.when(name.rlike(pat), kind)
    return out.otherwise(otherwise)


def detect_slices(df: DataFrame) -> DataFrame:
    """Columns with 2 to 50 values that are mostly text (or very few numbers), known kinds first."""
    import re

    cols = [c for c in df.columns if not re.search(SKIP_SLICE, c)]
    small = few_valued(df, cols, 50)
    vals = value_counts(df, small).where("value IS NOT NULL AND trim(value) <> ''")
    out = vals.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("value").rlike(r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$")).alias("numeric"),
        F.array_sort(F.collect_list("value")).alias("values"))  # bounded by few_valued
    out = out.where("count BETWEEN 2 AND 50 AND (numeric < count * 0.3D OR count <= 10)")
    out = out.withColumn("kind", _first_kind(F.lower("column"), SLICE_KINDS, F.lit("other")))
    return out.select("column", "kind", "count", F.slice("values", 1, 5).alias("samples"), "values").orderBy(
        F.col("kind") == "other", "count", "column")


def categorize_covariates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Category of each covariate by name, else holiday for flags and numeric for the rest."""
    def look(c: str) -> dict[str, Column]:
        v = F.trim(F.col(c).cast("string"))
        return {"binary": F.coalesce(F.bool_and(F.when(v.isNotNull(), v.isin("0", "1", "", "0.0", "1.0"))), F.lit(True))}

    out = per_column(df, cols, look)
    return out.select("column", _first_kind(F.col("column"), COVARIATE_KINDS, F.when(F.col("binary"), "holiday").otherwise("numeric")).alias("category"))


def detect_event_columns(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Columns holding only 0 and 1 with at least one 1, and how often they are on."""
    cols = [c for c in df.columns if c not in exclude]

    def look(c: str) -> dict[str, Column]:
        v = F.lower(F.trim(F.col(c).cast("string")))
        num = F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))
        return {"only_flags": ~F.coalesce(F.bool_or(num.isNotNull() & ~num.isin(0.0, 1.0)), F.lit(False)),
                "n_on": F.count_if(num == 1)}

    return per_column(df, cols, look).where("only_flags AND n_on > 0").select("column", "n_on")


def filterable_columns(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Columns with 2 to 20 distinct values and their sorted values."""
    cols = few_valued(df, [c for c in df.columns if c not in exclude], 20)
    vals = value_counts(df, cols).where("value IS NOT NULL")
    out = vals.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("value")).alias("values"))
    return out.where("n BETWEEN 2 AND 20")


