import datetime as dt


from fareshift.functions.calendar import holiday_calendar, missing_days, with_service_type
from fareshift.functions.timefns import (between_days, parse_report_date, parse_report_timestamp,
                                         service_day, service_seconds, time_gap_seconds)
from conftest import rows

T = dt.datetime
D = dt.date


def test_service_day_boundaries(spark):
    df = spark.createDataFrame([(T(2019, 11, 1, 2, 59, 59),), (T(2019, 11, 1, 3, 0, 0),), (T(2019, 11, 1, 0, 0, 0),)],
                               "ts timestamp_ntz")
    got = [r[0] for r in df.select(service_day("ts")).collect()]
    assert got == [D(2019, 10, 31), D(2019, 11, 1), D(2019, 10, 31)]


def test_service_seconds_past_midnight(spark):
    df = spark.createDataFrame([(T(2019, 11, 2, 1, 0, 0),)], "ts timestamp_ntz")
    r = df.select(service_day("ts").alias("d"), service_seconds("ts").alias("s")).first()
    assert r.d == D(2019, 11, 1) and r.s == 90000.0


def test_gap_elapsed_vs_clock(spark):
    df = spark.createDataFrame([(T(2019, 11, 2, 0, 0, 30), T(2019, 11, 1, 23, 59, 30))],
                               "t timestamp_ntz, p timestamp_ntz")
    r = df.select(time_gap_seconds("t", "p").alias("e"), time_gap_seconds("t", "p", clock=True).alias("c")).first()
    assert r.e == 60.0 and r.c == -86340.0


def test_parse_report_text(spark):
    df = spark.createDataFrame([("11/2/2019 13:05:09",), ("11/2/2019 1:05:09 PM",), ("13/45/2019 99:00:00",)], "s string")
    got = [r[0] for r in df.select(parse_report_timestamp("s")).collect()]
    assert got == [T(2019, 11, 2, 13, 5, 9), T(2019, 11, 2, 13, 5, 9), None]
    d = spark.createDataFrame([("2/29/2020",), ("Total",)], "s string").select(parse_report_date("s")).collect()
    assert [r[0] for r in d] == [D(2020, 2, 29), None]


def test_between_days(spark):
    df = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 1, 31),), (D(2020, 2, 1),)], "d date")
    half = df.where(between_days("d", "2020-01-01", "2020-01-31")).count()
    incl = df.where(between_days("d", "2020-01-01", "2020-01-31", inclusive=True)).count()
    assert (half, incl) == (1, 2)


def test_holiday_dates(spark):
    cal = {(r.holiday, r.year): r.holiday_date for r in holiday_calendar(spark, 2019, 2021).collect()}
    assert cal[("Martin Luther King Jr. Day", 2020)] == D(2020, 1, 20)
    assert cal[("Memorial Day", 2021)] == D(2021, 5, 31)
    assert cal[("Labor Day", 2019)] == D(2019, 9, 2)
    assert cal[("Thanksgiving Day", 2019)] == D(2019, 11, 28)
    assert cal[("Independence Day", 2020)] == D(2020, 7, 4)
    assert len(cal) == 21


def test_service_type_cases(spark):
    days = [D(2019, 11, 28), D(2020, 1, 20), D(2019, 11, 29), D(2019, 11, 30), D(2019, 12, 1), D(2020, 7, 4),
            D(2021, 11, 25), D(2021, 1, 18), D(1999, 5, 31), D(2050, 9, 5)]
    df = spark.createDataFrame([(d,) for d in days], "service_day date")
    got = dict(rows(with_service_type(df), "service_day", "service_type"))
    assert [got[d] for d in days] == ["Sunday", "Saturday", "Weekday", "Saturday", "Sunday", "Sunday",
                                       "Sunday", "Saturday", "Sunday", "Sunday"]


def test_service_type_equals_the_calendar(spark):
    """Every day of 40 years against the generated holiday list."""
    from pyspark.sql import functions as F

    from fareshift.functions.calendar import date_spine, holiday_service
    days = date_spine(spark, "1995-01-01", "2034-12-31", "d").withColumn("s", holiday_service("d"))
    cal = holiday_calendar(spark, 1995, 2034).select("holiday_date", "service")
    j = days.join(cal, days["d"] == cal["holiday_date"], "left")
    assert j.where(~F.col("s").eqNullSafe(F.col("service"))).count() == 0


def test_missing_days(spark):
    df = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 1, 3),)], "service_day date")
    assert rows(missing_days(df, "2020-01-01", "2020-01-04")) == [(D(2020, 1, 2),), (D(2020, 1, 4),)]


def test_wall_clock_kept_in_any_session_zone(spark):
    from fareshift.operators.asof import asof_join
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Indiana/Indianapolis")
    try:
        df = spark.createDataFrame([("3/10/2024 2:30:00",), ("11/3/2024 1:30:00 AM",)], "s string")
        got = [r[0] for r in df.select(parse_report_timestamp("s")).collect()]
        assert got == [T(2024, 3, 10, 2, 30), T(2024, 11, 3, 1, 30)]
        from fareshift.functions.timefns import clock_text
        c = spark.createDataFrame([(T(2024, 3, 10, 2, 30, 5),)], "t timestamp_ntz").select(clock_text("t")).first()[0]
        assert c == "02:30:05"
        # a position inside the spring-forward hour still matches by wall clock
        p = spark.createDataFrame([("1", T(2024, 3, 10, 2, 30), 1)], "vehicle_id string, pos_time timestamp_ntz, a long")
        t = spark.createDataFrame([(1, "1", T(2024, 3, 10, 2, 45)), (2, "1", T(2024, 3, 10, 2, 15))],
                                  "txn_id long, vehicle_id string, txn_time timestamp_ntz")
        m = asof_join(t, p, by=["vehicle_id"], left_time="txn_time", right_time="pos_time", right_cols=["a"])
        assert rows(m, "txn_id", "a") == [(1, 1), (2, None)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
