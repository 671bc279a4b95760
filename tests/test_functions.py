from pyspark.sql import functions as F

from conftest import D, d
from tillroll.functions import (
    currency_text,
    date_plus_time,
    hour_of,
    hour_window_label,
    iso_week_label,
    pg_asc,
    pg_desc,
    year_month_label,
)


def test_currency_text(spark):
    df = spark.createDataFrame([(D("0.125"),), (D("1234567.895"),), (D("-5.50"),), (None,)],
                               "x decimal(12,3)")
    got = [r[0] for r in df.select(currency_text("x")).collect()]
    assert got == ["$0.13", "$1,234,567.90", "$-5.50", None]


def test_iso_week_label_year_ends(spark):
    df = spark.createDataFrame([(d("2021-01-01"),), (d("2018-12-31"),), (d("2020-12-31"),),
                                (d("2024-01-08"),)], "d date")
    got = [r[0] for r in df.select(iso_week_label("d")).collect()]
    assert got == ["2020-W53", "2019-W01", "2020-W53", "2024-W02"]


def test_year_month_and_hour_window_labels(spark):
    df = spark.createDataFrame([(d("2021-12-31"), 9, 11)], "d date, a int, b int")
    r = df.select(year_month_label("d"), hour_window_label("a", "b")).first()
    assert tuple(r) == ("2021-12", "09:00-11:00")


def test_null_order_helpers(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r.x for r in df.orderBy(pg_asc("x")).collect()] == [1, 3, None]
    assert [r.x for r in df.orderBy(pg_desc("x")).collect()] == [None, 3, 1]


def test_hour_of_text_and_timestamp(spark):
    df = spark.createDataFrame([("07:59:59", d("2024-01-01"))], "t string, dd date").withColumn(
        "stamp", F.to_timestamp_ntz(F.lit("2024-01-01 23:00:00")))
    r = df.select(hour_of(df, "t"), hour_of(df, "stamp")).first()
    assert tuple(r) == (7, 23)


def test_date_plus_time(spark):
    df = spark.createDataFrame([(d("2024-01-01"), "12:34:56"), (None, "01:00:00")], "dd date, t string")
    got = [r[0] for r in df.select(date_plus_time(df, "dd", "t").cast("string")).collect()]
    assert got == ["2024-01-01 12:34:56", None]


def test_time_type_columns(spark):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    try:
        df = spark.sql("SELECT DATE'2024-01-01' AS dd, CAST('12:34:56' AS TIME) AS t")
        r = df.select(hour_of(df, "t"), date_plus_time(df, "dd", "t").cast("string")).first()
        assert tuple(r) == (12, "2024-01-01 12:34:56")
    finally:
        spark.conf.unset("spark.sql.timeType.enabled")
