"""Closed-form cases of values, dates, holidays and roles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright.functions import clean as C
from tidewright.functions import dates as D
from tidewright.functions import stats as ST
from tidewright.operators import calendar as CAL
from tidewright.operators import normalize as N
from tidewright.operators import quality as Q
from tidewright.operators import roles as R


def one(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_numeric_forms(spark):
    got = one(spark, ["1,000.50", "1.000,50", "$1,000", "50%", "(100)", "1,5", "1.234.567", "€ 7", "abc", "", None, "1d", "nan"], C.normalize_numeric)
    assert got == [1000.5, 1000.5, 1000.0, 0.5, -100.0, 1.5, 1234567.0, 7.0, None, None, None, None, None]
    assert one(spark, ["29,031", "$1,234", " 12 ", "x"], C.clean_numeric) == [29031.0, 1234.0, 12.0, None]


def test_dates(spark):
    got = one(spark, ["2024-01-15", "2024/01/15", "1/15/2024", "01-15-2024", "12/8/25", "January 15, 2024", "15 Jan 2024", "W01 2024", "2024 W02", "Q3 2024",
                      "2024-01-15T10:00:00", "25/12/2024", "2024-02-30", "W60 2024", "1/2-2024", "hello", None], D.parse_date)
    d = dt.date
    assert got == [d(2024, 1, 15)] * 4 + [d(2025, 12, 8), d(2024, 1, 15), d(2024, 1, 15), d(2024, 1, 1), d(2024, 1, 8), d(2024, 7, 1), d(2024, 1, 15), d(2024, 12, 25), None, None, None, None, None]


def test_times_after_dates(spark):
    got = one(spark, ["2024-01-05 10:20:30", "01/05/2024 10:00", "Jan 5, 2024 9:05 PM", "2024/01/05 10:20:30.123", "2024-01-05 10:20:30+02:00", "2024-01-05 25", "10:20"], D.parse_date)
    assert got == [dt.date(2024, 1, 5)] * 5 + [None, None]


def test_strings_and_codes(spark):
    assert one(spark, ["  a   b ", "x y", "﻿bom", "a\r\nb", "   ", None], C.normalize_string) == ["a b", "x y", "bom", "a b", None, None]
    assert one(spark, ["0123", "0", "0.5", "1,000", "abc"], C.typed_value) == [None, 0.0, 0.5, 1000.0, None]
    assert one(spark, ["Yes", " off ", "1", "maybe"], C.normalize_boolean) == [True, False, True, None]


def test_holiday_dates(spark):
    years = spark.createDataFrame([(y,) for y in range(2019, 2027)], "year int")
    h = {(r.year, r.holiday): r.ds for r in CAL.holiday_dim(years).collect()}
    assert [h[y, "thanksgiving"] for y in (2023, 2024, 2025, 2026)] == [dt.date(2023, 11, 23), dt.date(2024, 11, 28), dt.date(2025, 11, 27), dt.date(2026, 11, 26)]
    assert [h[y, "easter"] for y in (2021, 2022, 2023, 2024)] == [dt.date(2021, 4, 4), dt.date(2022, 4, 17), dt.date(2023, 4, 9), dt.date(2024, 3, 31)]
    assert h[2021, "super_bowl"] == dt.date(2021, 2, 7) and h[2024, "super_bowl"] == dt.date(2024, 2, 11)
    assert h[2024, "memorial_day"] == dt.date(2024, 5, 27) and h[2024, "labor_day"] == dt.date(2024, 9, 2)
    assert len(h) == 8 * 18


def test_observed_days(spark):
    df = spark.createDataFrame([(dt.date(2021, 12, 31),), (dt.date(2022, 12, 26),), (dt.date(2020, 6, 19),), (dt.date(2021, 6, 18),)], "ds date")
    assert [r[0] for r in df.select(CAL.is_public_holiday(F.col("ds"))).collect()] == [True, True, False, True]


def test_critical_values():
    assert ST.t_critical(0.95, 5) == pytest.approx(2.570582, abs=1e-5)
    assert ST.t_critical(0.95, 10) == pytest.approx(2.228139, abs=1e-5)
    assert ST.t_critical(0.99, 1) == pytest.approx(63.6567, abs=1e-3)
    assert ST.z_critical(0.95) == pytest.approx(1.959964, abs=1e-6)


def test_chi2_tail(spark):
    got = spark.range(1).select(ST.chi2_tail_even(F.lit(18.307), 10)).first()[0]
    assert got == pytest.approx(0.05, abs=1e-4)


def test_type_vote_and_table(spark):
    df = spark.createDataFrame([("1,000", "2024-01-01", "yes", "a"), ("2,000", "2024-01-02", "no", "b"), ("bad", "2024-01-03", "yes", None)] * 4, "n string, d string, f string, s string")
    types = {r["column"]: r["type"] for r in N.infer_column_types(df).collect()}
    assert types == {"n": "string", "d": "datetime", "f": "boolean", "s": "string"}
    out, rep = N.normalize_table(df, numeric_cols=["n"])
    assert dict(out.dtypes) == {"n": "double", "d": "date", "f": "boolean", "s": "string"}
    assert {r["column"]: r["failed"] for r in rep.collect()}["n"] == 4


@pytest.mark.parametrize("shift,code", [(0, "W-MON"), (6, "W-SUN"), (1, "W-TUE")])
def test_week_anchor(spark, shift, code):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=7 * i + shift),) for i in range(20)]
    assert R.week_anchor(spark.createDataFrame(rows, "ds date"), []).first()["anchor"] == code


def test_covariates_that_never_change(spark):
    # 49 rows a part: sums of parts put the mean of 49 ones a last digit beside 1
    rows = spark.range(0, 490, 1, 10).select(
        F.col("id").cast("double").alias("y"), F.lit(1).alias("flag"), F.lit(0.1).alias("rate"), (F.col("id") * 3 + 1).alias("twin"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") > 480, 5).alias("short"))
    got = {r["column"]: r for r in Q.leaky_covariates(rows, "y", ["flag", "rate", "twin", "none", "short"]).collect()}
    assert list(got) == ["twin"] and got["twin"].correlation == pytest.approx(1) and got["twin"].is_leaky
    assert Q.leaky_covariates(rows.withColumn("y", F.lit(2.5)), "y", ["flag", "twin"]).count() == 0
    risk = {r["column"]: (r["corr"], r["risk"], r["reasons"]) for r in Q.leak_risk(rows, "y", ["flag", "rate"]).collect()}
    assert risk == {"flag": (None, "low", []), "rate": (None, "low", [])}
