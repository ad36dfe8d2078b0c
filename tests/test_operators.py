import datetime as dt

from pyspark.sql import functions as F


from fareshift.functions.classify import in_fleet, local_route, pass_type, repair_vehicle
from fareshift.operators.control import combine_totals, combine_totals_wide, scale_to_control
from fareshift.operators.quality import quality_flags, questionable_pct
from fareshift.operators.ridership import (reconcile, ridership_only, sort_route_numeric, unused_transactions,
                                           used_unused_counts)
from fareshift.operators.summary import service_summary
from conftest import rows

D = dt.date
T = dt.datetime


def test_local_route_boundaries(spark):
    df = spark.createDataFrame([(39.877512,), (39.877513,), (39.709467,), (39.709468,), (None,)], "lat double")
    assert [r[0] for r in df.select(local_route("lat")).collect()] == ["90", "901", "902", "90", "90"]


def test_fleet_and_repair(spark):
    df = spark.createDataFrame([("1899",), ("1970",), ("1999",), ("2000",), ("0",), ("x",), (None,)], "v string")
    got = [r[0] for r in df.select(in_fleet("v")).collect()]
    assert got == [True, True, True, False, False, False, False]
    assert [r[0] for r in df.select(repair_vehicle("v")).collect()][4] == "1970"


def test_pass_types(spark):
    df = spark.createDataFrame([("31 FULL",), ("Single Ride Full Fare",), ("10 TRIP FULL",), ("Free",), ("Transfer",)],
                               "d string")
    assert [r[0] for r in df.select(pass_type("d")).collect()] == [
        "Period Pass", "Single Ride", "Stored Ride", "Free Key", None]


def _td(spark):
    return spark.createDataFrame(
        [(1, "100 FARE", "A1", "87"), (2, "118 TRANSFER", "ZZ", "87"), (3, "100 FARE", "ZZ", "87"),
         (4, "100 FARE", "A1", "25"), (5, None, None, "25")],
        "txn_id long, type string, description string, route string")


def test_ridership_used_unused(spark):
    td = _td(spark)
    rules = spark.createDataFrame([("A1", "x"), ("A1", "dup")], "code string, description string")
    assert rows(ridership_only(td, rules), "txn_id") == [(1,), (2,), (4,)]
    a = rows(unused_transactions(td, rules), "txn_id")
    b = rows(unused_transactions(td, rules, method="anti_join"), "txn_id")
    assert a == b == [(3,), (5,)]
    r = used_unused_counts(td, rules).first()
    assert (r.n_all, r.n_used, r.n_unused, r.counts_agree) == (5, 3, 2, True)


def test_reconcile_and_route_sort(spark):
    td = _td(spark)
    rules = spark.createDataFrame([("A1", "x")], "code string, description string")
    rs = spark.createDataFrame([("87", 3)], "route string, ridership long")
    got = rows(reconcile(td, rules, rs, how="left"), "route", "ridership_td", "ridership_diff", "percent_disagree")
    assert got == [("25", 1, None, None), ("87", 2, -1, -33.333)]
    df = spark.createDataFrame([("100",), ("9",), ("90",), ("X",)], "route string")
    assert [r[0] for r in sort_route_numeric(df).collect()] == ["9", "90", "100", "X"]


def test_scale_up_and_no_scale(spark):
    local = spark.createDataFrame([(D(2019, 9, 1), 32, 91), (D(2019, 9, 2), 32, 91), (D(2019, 9, 3), 0, 0)],
                                  "service_day date, ridership_901 long, ridership_902 long")
    totals = spark.createDataFrame([(D(2019, 9, 1), 927), (D(2019, 9, 2), 100), (D(2019, 9, 3), 5)],
                                   "service_day date, ridership long")
    got = rows(scale_to_control(local, totals), "service_day", "final_901", "final_902")
    assert got == [(D(2019, 9, 1), 241, 685), (D(2019, 9, 2), 32, 91), (D(2019, 9, 3), 0, 0)]


def test_combine_totals_wide_order(spark):
    a = spark.createDataFrame([("901", "Weekday", 10), ("902", "Sunday", 1)], "local_route string, service_type string, ridership long")
    b = spark.createDataFrame([("901", "Weekday", 5), ("901", "Saturday", 2)], "local_route string, service_type string, ridership long")
    w = combine_totals_wide(combine_totals(a, b))
    assert w.columns == ["local_route", "Weekday", "Saturday", "Sunday"]
    assert rows(w) == [("901", 15, 2, None), ("902", None, None, 1)]


def test_half_even_mean(spark):
    daily = spark.createDataFrame([("W", 2), ("W", 3), ("S", 3), ("S", 4)], "service_type string, ridership long")
    got = dict(rows(service_summary(daily), "service_type", "average_daily_ridership"))
    assert got == {"W": 2.0, "S": 4.0}


def test_questionable_counts_per_fault(spark):
    t0 = T(2020, 1, 1, 10, 0)
    m = spark.createDataFrame(
        [(t0 + dt.timedelta(minutes=30), t0, t0 + dt.timedelta(minutes=20), None),   # after last + bad GPS
         (t0 + dt.timedelta(minutes=1), t0, t0 + dt.timedelta(minutes=20), 2),
         (t0 + dt.timedelta(seconds=30), t0, t0 + dt.timedelta(minutes=20), 2),
         (t0 + dt.timedelta(seconds=60), t0, t0 + dt.timedelta(minutes=20), 2)],
        "txn_time timestamp_ntz, pos_time timestamp_ntz, maxtime timestamp_ntz, gps_status int")
    r = questionable_pct(quality_flags(m)).first()
    assert (r.questionable_pct, r.questionable_pct_distinct) == (50.0, 25.0)


def test_top_differences_and_report_order(spark):
    from fareshift.operators.ridership import largest_differences
    from fareshift.operators.summary import order_for_report
    rec = spark.createDataFrame([("1", 5), ("2", 9), ("3", 9), ("4", -1)], "route string, ridership_diff long")
    assert [r.route for r in largest_differences(rec, 2).collect()] == ["2", "3"]
    st = spark.createDataFrame([("Saturday", 1), ("Weekday", 2), ("Sunday", 3)], "service_type string, n long")
    assert [r.service_type for r in order_for_report(st).collect()] == ["Weekday", "Sunday", "Saturday"]


def test_iso_parse_and_last_position_join(spark):
    from fareshift.functions.timefns import parse_iso_timestamp
    from fareshift.operators.asof import with_last_position
    df = spark.createDataFrame([("2019-12-03T05:01:02",), ("2019-12-03 05:01:02",), ("junk",)], "s string")
    got = [r[0] for r in df.select(parse_iso_timestamp("s")).collect()]
    assert got == [T(2019, 12, 3, 5, 1, 2), T(2019, 12, 3, 5, 1, 2), None]
    pos = spark.createDataFrame([("1", D(2019, 12, 3), T(2019, 12, 3, 5)), ("1", D(2019, 12, 3), T(2019, 12, 3, 9))],
                                "vehicle_id string, service_day date, pos_time timestamp_ntz")
    td = spark.createDataFrame([("1", D(2019, 12, 3)), ("2", D(2019, 12, 3))], "vehicle_id string, service_day date")
    assert rows(with_last_position(td, pos), "vehicle_id", "maxtime") == [("1", T(2019, 12, 3, 9)), ("2", None)]


def test_empty_and_zero_denominators_give_null(spark):
    from fareshift.operators.control import compare_daily
    empty = spark.createDataFrame([], "txn_time timestamp_ntz, pos_time timestamp_ntz, maxtime timestamp_ntz, gps_status int")
    r = questionable_pct(quality_flags(empty)).first()
    assert r.n_rows == 0 and r.questionable_pct is None
    daily = spark.createDataFrame([(D(2020, 1, 1), 5)], "service_day date, n long")
    totals = spark.createDataFrame([(D(2020, 1, 1), 0)], "service_day date, ridership long")
    assert compare_daily(daily, totals).first().pct_diff is None


def test_reconcile_pairs_months_by_key(spark):
    td = spark.createDataFrame(
        [("Dec", 1, "A1", "90"), ("Dec", 2, "A1", "90"), ("Jan", 3, "A1", "90"), ("Jan", 4, "A1", "901")],
        "period string, txn_id long, description string, route string").withColumn("type", F.lit("100 FARE"))
    rules = spark.createDataFrame([("A1", "x")], "code string, description string")
    rs = spark.createDataFrame([("Jan", "90", 4), ("Dec", "90", 2)], "period string, route string, ridership long")
    got = rows(reconcile(td, rules, rs, by=("period", "route")), "period", "route", "ridership_td", "ridership_diff")
    assert got == [("Dec", "90", 2, 0), ("Jan", "90", 1, -3)]
