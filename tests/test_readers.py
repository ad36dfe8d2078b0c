import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from fareshift.sources.reports import (numbered_lines, parse_daily_totals, parse_routesum, parse_rules,
                                       parse_transactions, read_routesum, read_rules, read_transactions,
                                       rejected_transactions, report_files, routesum_total)
from fareshift.sources.sinks import write_summary
from conftest import rows

RULES = """Monthly Summary Report
Ridership is defined as the following fare codes:
"A1","10 TRIP, FULL",""

"B2","31 FULL",""
"C3","Single Ride Full Fare",""
Fares not listed above are excluded.
"Z9","Never","" 
"""

ROUTESUM = """Event Summary
Ridership By Route
Route,Ridership,Token Count,Ticket Count,Preset Preset1,X
8,100,0,0,0,

90,"1,250",0,0,0,
TOTAL,1350,0,0,0,
Average,675,0,0,0,
"""

DAILY = """Local Route
Ridership By Route
Date,Ridership
9/1/2019,804
9/2/2019,900
TOTAL,1704
"""

TD = """Transaction Detail
Printed 12/4/2019 8:00:00
Type,Date and Time,Bus,Route,Run,Driver,Description,Value,Amount,Direction,Fareset,Stop,Trip,Longitude,Latitude
100 FARE,12/3/2019 5:01:02,1976,90,12,345,A1,1.75,1.75,N,1,10,3,-86.1,39.9

118 TRANSFER,12/3/2019 23:59:59,0,90,12,345,"XFER, LOCAL",0,0,N,1,10,3,,
100 FARE,13/45/2019 99:00:00,1976,90,12,345,A1,1.75,1.75,N,1,10,3,-86.1,39.9
Number of Transactions: 3
"""


def _write(tmp, name, text):
    with open(os.path.join(tmp, name), "w") as f:
        f.write(text)


def _lines(spark, text, file="f"):
    df = spark.createDataFrame([(file, text)], "file string, value string")
    return numbered_lines(df)


def test_rules_v2_keeps_commas(spark):
    got = rows(parse_rules(_lines(spark, RULES)), "code", "description")
    assert got == [("A1", "10 TRIP, FULL"), ("B2", "31 FULL"), ("C3", "Single Ride Full Fare")]


def test_rules_v1(spark):
    plain = RULES.replace("10 TRIP, FULL", "10 TRIP FULL")
    got = rows(parse_rules(_lines(spark, plain), version=1), "code", "description")
    assert got == [("A1", "10 TRIP FULL"), ("B2", "31 FULL"), ("C3", "Single Ride Full Fare")]
    # v1 splits on every comma, so a comma inside a description shifts the pairing
    shifted = rows(parse_rules(_lines(spark, RULES), version=1), "code", "description")
    assert ("A1", "10 TRI") in shifted and len(shifted) == 4


def test_routesum_and_total(spark):
    lines = _lines(spark, ROUTESUM)
    assert rows(parse_routesum(lines), "route", "ridership") == [("8", 100), ("90", 1250)]
    assert routesum_total(lines).first().total_ridership == 1350


def test_daily_totals(spark):
    got = rows(parse_daily_totals(_lines(spark, DAILY)), "service_day", "ridership")
    assert got == [(dt.date(2019, 9, 1), 804), (dt.date(2019, 9, 2), 900)]


def test_transactions_by_header_name(spark):
    lines = spark.createDataFrame([("td", l) for l in TD.splitlines()], "file string, line string")
    got = parse_transactions(lines).orderBy("txn_time").collect()
    assert len(got) == 2
    assert got[0].vehicle_id == "1976" and got[0].latitude == 39.9 and got[0].description == "A1"
    assert got[1].description == "XFER, LOCAL" and got[1].latitude is None
    assert got[1].txn_time == dt.datetime(2019, 12, 3, 23, 59, 59)
    assert rejected_transactions(lines).first().rejected == 1


def test_files_by_kind_period_year(spark):
    tmp = tempfile.mkdtemp(prefix="fareshift-test-")
    _write(tmp, "MONTHLY SUMMARY May 2020.txt", RULES)
    _write(tmp, "EVENT SUMMARY (December 1, 2020).csv", ROUTESUM)
    _write(tmp, "EVENT SUMMARY (November 1, 2020).csv", ROUTESUM)
    os.makedirs(os.path.join(tmp, "TD"))
    _write(os.path.join(tmp, "TD"), "TRANSACTION DETAIL DECEMBER 1, 2020.csv", TD)
    assert report_files(spark, tmp, "routesum").count() == 2
    assert report_files(spark, tmp, "routesum", period="december", year=2020).count() == 1
    rs = read_routesum(spark, tmp, period="December")
    assert rows(rs, "period", "route") == [("Dec 2020", "8"), ("Dec 2020", "90")]
    assert read_rules(spark, tmp).count() == 3
    td = read_transactions(spark, os.path.join(tmp, "TD"))
    assert td.count() == 2 and td.first().period == "DECEMBER 1"


def test_write_summary_roundtrip(spark):
    tmp = tempfile.mkdtemp(prefix="fareshift-test-")
    df = spark.createDataFrame([("901", 3), ("902", 4)], "local_route string, ridership long")
    out = os.path.join(tmp, "by_type")
    write_summary(df, out)
    write_summary(df, out, mode="append")
    back = spark.read.csv(out, header=True, schema="local_route string, ridership long")
    assert back.count() == 4


def test_read_delimited_and_write_detail(spark):
    from fareshift.sources.reports import read_delimited
    from fareshift.sources.sinks import write_detail
    tmp = tempfile.mkdtemp(prefix="fareshift-test-")
    _write(tmp, "vmh.csv", "Time,Vehicle_ID\n2019-12-03 05:00:00,1976\n2019-12-03 06:00:00,1977\n")
    df = read_delimited(spark, os.path.join(tmp, "vmh.csv"), "time timestamp_ntz, vehicle_id string")
    assert df.count() == 2 and dict(df.dtypes)["time"] == "timestamp_ntz"
    out = os.path.join(tmp, "detail")
    write_detail(df.withColumn("service_day", F.to_date("time")), out)
    assert spark.read.parquet(out).where(F.col("service_day") == "2019-12-03").count() == 2


def test_read_positions_options(spark):
    import datetime as dt
    from fareshift.sources.positions import read_positions
    T = dt.datetime
    vmh = spark.createDataFrame(
        [(1, T(2020, 1, 1, 2, 0), "90", 1976, 7), (2, T(2020, 1, 1, 4, 0), "8", 1980, 7),
         (3, T(2020, 1, 1, 5, 0), "8", 12, 7), (4, T(2020, 1, 2, 2, 30), "901", 5, 8),
         (4, T(2020, 1, 2, 2, 30), "901", 5, 8)],
        "avl_history_id long, time timestamp_ntz, route string, vehicle_id long, trip int")
    avl = spark.createDataFrame([(1, 39.9, 2), (2, 39.8, 0)], "avl_history_id long, latitude double, gps_status int")
    by_day = read_positions(vmh, avl, "2020-01-01", "2020-01-01")
    # service day 2020-01-01 runs from 03:00 to 03:00 next day; route 9% or bus 1970-1999
    assert sorted(r.vehicle_id for r in by_day.collect()) == ["1980", "5"]  # the message sent twice collapses
    midnight = read_positions(vmh, avl, "2020-01-01", "2020-01-01", by_service_day=False, distinct=False)
    assert sorted(r.vehicle_id for r in midnight.collect()) == ["1976", "1980"]


def test_reports_to_matched_table(spark):
    """Report files -> readers -> ridership -> as-of match -> local route, end to end."""
    import datetime as dt
    from fareshift.plans.period import matched_table
    tmp = tempfile.mkdtemp(prefix="fareshift-test-")
    _write(tmp, "MONTHLY SUMMARY December 2019.txt", RULES)
    os.makedirs(os.path.join(tmp, "TD"))
    _write(os.path.join(tmp, "TD"), "TRANSACTION DETAIL DECEMBER 1, 2019.csv", TD)
    rules = read_rules(spark, tmp)
    td = read_transactions(spark, os.path.join(tmp, "TD"))
    pos = spark.createDataFrame(
        [(10, dt.datetime(2019, 12, 3, 5, 0), "1976", 39.95, 2), (11, dt.datetime(2019, 12, 3, 23, 0), "1970", 39.60, 2)],
        "avl_history_id long, pos_time timestamp_ntz, vehicle_id string, latitude double, gps_status int")
    m = matched_table(td, pos, rules, route_pattern="^90", repair={"0": "1970"})
    got = rows(m, "vehicle_id", "avl_history_id", "local_route", "service_type")
    assert got == [("1970", 11, "902", "Weekday"), ("1976", 10, "901", "Weekday")]


def test_half_month_files_reconcile_by_month_key(spark):
    from fareshift.operators.ridership import reconcile
    from fareshift.sources.reports import with_month_key
    tmp = tempfile.mkdtemp(prefix="fareshift-test-")
    _write(tmp, "MONTHLY SUMMARY December 2019.txt", RULES)
    _write(tmp, "EVENT SUMMARY (December 1, 2019).csv", ROUTESUM)
    os.makedirs(os.path.join(tmp, "TD"))
    _write(os.path.join(tmp, "TD"), "TRANSACTION DETAIL DECEMBER 1, 2019.csv", TD)
    _write(os.path.join(tmp, "TD"), "TRANSACTION DETAIL DECEMBER 16, 2019.csv", TD)
    td = with_month_key(read_transactions(spark, os.path.join(tmp, "TD")))
    assert rows(td.select("period").distinct()) == [("DECEMBER 1",), ("DECEMBER 16",)]
    rs = with_month_key(read_routesum(spark, tmp))
    rec = reconcile(td, read_rules(spark, tmp), rs, by=("month", "route"))
    # two half-month files, two ridership rows each on route 90, against the December total
    assert rows(rec, "month", "route", "ridership_td", "ridership") == [("Dec", "90", 4, 1250)]


def test_position_columns_and_missing_id(spark):
    import datetime as dt

    import pytest
    from fareshift.operators.matching import match_positions
    from fareshift.sources.positions import read_positions
    T = dt.datetime
    vmh = spark.createDataFrame([(1, T(2020, 1, 1, 4, 0), "90", 1976, 7, 3, 1, "I")],
                                "avl_history_id long, time timestamp_ntz, route string, vehicle_id long, trip int, "
                                "boards int, alights int, inbound_outbound string")
    avl = spark.createDataFrame([(1, T(2020, 1, 1, 4, 0), 39.9, -86.1, 2), (1, T(2020, 3, 1), 1.0, 1.0, 0)],
                                "avl_history_id long, time timestamp_ntz, latitude double, longitude double, gps_status int")
    out = read_positions(vmh, avl, "2020-01-01", "2020-01-01")
    assert out.columns == ["avl_history_id", "pos_time", "vehicle_id", "route", "inbound_outbound", "trip", "boards",
                           "alights", "latitude", "longitude", "gps_status"]
    # a position is found however far its time lies from the message's; an id listed twice gives two
    assert sorted(tuple(r)[-3:] for r in out.collect()) == [(1.0, 1.0, 0), (39.9, -86.1, 2)]
    with pytest.raises(ValueError):
        read_positions(vmh.drop("avl_history_id"), avl)
    td = spark.createDataFrame([(1, "1976", T(2020, 1, 1, 5, 0))], "txn_id long, vehicle_id string, txn_time timestamp_ntz")
    with pytest.raises(ValueError):
        match_positions(td, out.drop("avl_history_id"))


def test_positions_of_one_sided_periods_and_far_history(spark):
    import datetime as dt
    from fareshift.sources.positions import read_positions
    T = dt.datetime
    vmh = spark.createDataFrame([(i, T(2020, 1, i, 4, 0), "90", 1976) for i in range(1, 6)],
                                "avl_history_id long, time timestamp_ntz, route string, vehicle_id long")
    avl = spark.createDataFrame([(i, T(2020, 1, i, 4, 0) + dt.timedelta(days=2 if i == 3 else 0), float(i)) for i in range(1, 6)],
                                "avl_history_id long, time timestamp_ntz, latitude double")
    ids = lambda *a, **k: rows(read_positions(vmh, avl, *a, **k), "avl_history_id", "latitude")
    assert ids("2020-01-03", None) == [(3, 3.0), (4, 4.0), (5, 5.0)]
    assert ids(None, "2020-01-03") == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert ids("2020-01-03", "2020-01-03") == [(3, 3.0)]  # its position is dated two days later
    assert len(ids()) == 5
    assert ids("2021-01-01", None) == []


def test_history_is_read_between_the_kept_ids(spark, tmp_path):
    from fareshift.sources.positions import read_positions
    spark.range(0, 10_000, 1, 1).selectExpr(
        "id AS avl_history_id", "TIMESTAMP_NTZ'2020-01-01 03:00:00' + make_dt_interval(0, 0, CAST(id AS INT)) AS time", "'90' AS route",
        "1976L AS vehicle_id").write.parquet(str(tmp_path / "vmh"))
    spark.range(10_000).selectExpr("id AS avl_history_id", "CAST(id AS DOUBLE) AS latitude").write.parquet(str(tmp_path / "avl"))
    out = read_positions(spark.read.parquet(str(tmp_path / "vmh")), spark.read.parquet(str(tmp_path / "avl")), "2020-01-04", None)
    got = out.collect()
    assert len(got) == 10_000 - 3 * 1440 and all(r.latitude == r.avl_history_id for r in got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    history = next(x for x in plan.splitlines() if "FileScan parquet" in x and "latitude" in x)
    assert "scalar-subquery" in history or "ReusedSubquery" in history or "Subquery" in history


def test_report_files_are_written_by_name(spark, tmp_path):
    from fareshift.sources.sinks import write_report_files
    lines = [("TRANSACTION DETAIL MAY 1, 2020.csv", i, f"line {i}") for i in range(50)] + [("a=b (c).txt", 1, "x"), ("a=b (c).txt", 2, "")]
    d = spark.createDataFrame(lines, "file string, line_no int, line string").repartition(7)
    write_report_files(d, str(tmp_path / "r"))
    assert sorted(x for x in os.listdir(tmp_path / "r") if not x.startswith(".")) == ["TRANSACTION DETAIL MAY 1, 2020.csv", "a=b (c).txt"]
    assert (tmp_path / "r" / "TRANSACTION DETAIL MAY 1, 2020.csv").read_text() == "".join(f"line {i}\n" for i in range(50))
    assert (tmp_path / "r" / "a=b (c).txt").read_text() == "x\n\n"


def test_summaries_of_a_period_replace_its_own(spark, tmp_path):
    import pytest
    path = str(tmp_path / "s")
    a = spark.createDataFrame([("Weekday", 5), ("Sunday", 2), ("Saturday", 3)], "service_type string, n long")
    b = spark.createDataFrame([("Weekday", 7)], "service_type string, n long")
    order = (F.col("service_type").desc(),)
    for df, period in ((a, "2020-01"), (b, "2020-02"), (a, "2020-01"), (a.where("n > 2"), "2020-03"), (b, "2020-03")):
        write_summary(df, path, mode="append", order_by=order, period=period)
    back = spark.read.csv(path, header=True, schema="service_type string, n long, period string")
    assert rows(back, "period", "service_type", "n") == [("2020-01", "Saturday", 3), ("2020-01", "Sunday", 2),
                                                         ("2020-01", "Weekday", 5), ("2020-02", "Weekday", 7), ("2020-03", "Weekday", 7)]
    # one file a period, in report order
    files = [x for x in os.listdir(f"{path}/period=2020-01") if x.startswith("part-")]
    assert len(files) == 1
    with open(f"{path}/period=2020-01/{files[0]}") as f:
        assert f.read() == "service_type,n\nWeekday,5\nSunday,2\nSaturday,3\n"
    write_summary(b, path, period="2020-02")  # overwrite: the whole folder
    assert rows(spark.read.csv(path, header=True, schema=back.schema), "period") == [("2020-02",)]
    with pytest.raises(ValueError):
        write_summary(a.withColumn("period", F.lit("x")), path, period="y")


def test_file_without_header_is_reported(spark):
    lines = [("good", x) for x in TD.splitlines()] + [("bare", x) for x in TD.splitlines() if "Date and Time" not in x]
    df = spark.createDataFrame(lines, "file string, line string")
    assert rows(parse_transactions(df).select("file").distinct()) == [("good",)]
    bad = {r.file: (r.rejected, r.no_header) for r in rejected_transactions(df).collect()}
    assert bad["good"] == (1, False)
    assert bad["bare"][0] >= 3 and bad["bare"][1]


def test_decembers_of_two_years_stay_apart(spark):
    import datetime as dt
    from fareshift.operators.ridership import reconcile_by_month
    from fareshift.operators.summary import local_by_month
    T = dt.datetime
    td = spark.createDataFrame([(T(y, 12, 3, 9), "90", "A", "100") for y in (2019, 2019, 2020)],
                               "txn_time timestamp_ntz, route string, description string, type string")
    rules = spark.createDataFrame([("A", 2019, "Dec"), ("B", 2020, "Dec")], "code string, year int, month string")
    rs = spark.createDataFrame([("90", 5, "Dec", 2019), ("90", 7, "Dec", 2020)], "route string, ridership long, month string, year int")
    assert rows(reconcile_by_month(td, rules, rs), "year", "ridership_td", "ridership") == [(2019, 2, 5)]  # A is no 2020 rule
    always = rules.withColumn("year", F.lit(None).cast("int"))
    assert rows(reconcile_by_month(td, always, rs), "year", "ridership_td", "ridership") == [(2019, 2, 5), (2020, 1, 7)]
    m = td.select(F.to_date("txn_time").alias("service_day"), F.lit("901").alias("local_route"))
    assert rows(local_by_month(m), "year", "month", "ridership") == [(2019, "December", 2), (2020, "December", 1)]
