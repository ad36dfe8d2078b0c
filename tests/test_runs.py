"""End-to-end runs: season, scale-up, and the command line over report files."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fareshift.plans import roles
from fareshift.plans.season import run_scaleup, run_season

SF = "/root/testdata/sf0.001"
KW = dict(north=60.0, south=20.0)


def test_run_season(spark, tmp_path):
    td, pos, rules = roles.td(spark, SF), roles.positions(spark, SF), roles.rules(spark)
    out = run_season(td, pos, rules, str(tmp_path), start="2024-01-10", end="2024-01-31",
                     control=roles.daily_totals(spark, SF), control_start="2024-01-01",
                     season_until="2024-01-20", **KW)
    days = out["daily"].select("service_day").distinct().count()
    assert days == out["daily"].count() > 20  # one row per day and type
    assert out["missing_days"].count() + days == 30
    assert (tmp_path / "season_monthly").exists()


def test_run_scaleup(spark, tmp_path):
    td, pos, rules = roles.td(spark, SF), roles.positions(spark, SF), roles.rules(spark)
    other = spark.createDataFrame([("901", "Weekday", 5), ("902", "Sunday", 7)],
                                  "local_route string, service_type string, ridership long")
    out = run_scaleup(td, pos, rules, roles.daily_totals(spark, SF), str(tmp_path), start="2024-01-01",
                      end="2024-01-31", other_totals=other, **KW)
    sc = out["scaled_daily"]
    assert sc.where((F.col("final_901") < F.col("ridership_901")) | (F.col("final_902") < F.col("ridership_902"))).count() == 0
    assert out["totals_wide"].columns == ["local_route", "Weekday", "Saturday", "Sunday"]
    assert (tmp_path / "scaleup_totals_wide").exists()


def _write_lines(df, folder, numbered):
    os.makedirs(folder, exist_ok=True)
    rows = df.collect()
    files = {}
    for r in rows:
        files.setdefault(r.file, []).append(((r.line_no if numbered else 0), r.line))
    for name, lines in files.items():
        lines.sort(key=lambda x: x[0]) if numbered else None
        with open(os.path.join(folder, name), "w") as f:
            f.write("\n".join(l for _, l in lines) + "\n")


def test_command_line(spark, tmp_path):
    from fareshift.__main__ import main
    reports = str(tmp_path / "reports")
    td_lines = roles.td_report_lines(spark, SF)
    # header and preamble first, footer last, as in a printed report
    order = (F.when(F.col("line").startswith("Transaction"), 0).when(F.col("line").startswith("Printed"), 1)
             .when(F.col("line").startswith("Type,"), 2).when(F.col("line").startswith("Number of"), 4).otherwise(3))
    _write_lines(td_lines.withColumn("line_no", order), os.path.join(reports, "TD"), numbered=True)
    _write_lines(roles.rules_report_lines(spark, SF), reports, numbered=True)
    _write_lines(roles.daily_report_lines(spark, SF), reports, numbered=True)
    _write_lines(roles.routesum_report_lines(spark, SF).where("line NOT LIKE '25,%'"), reports, numbered=True)
    pos_path = str(tmp_path / "positions")
    roles.positions(spark, SF).write.parquet(pos_path)
    common = ["--reports", reports, "--positions", pos_path, "--north", "60", "--south", "20", "--fleet", "all"]
    for run, option in (("scaleup", "--gap-seconds=90"), ("scaleup", "--no-null-gap"), ("scaleup", "--percent"),
                        ("scaleup", "--store=x"), ("period", "--store=x"), ("period", "--other-totals=x"),
                        ("season", "--other-totals=x"), ("period", "--season-until=2024-01-20")):
        with pytest.raises(SystemExit):
            main([run, "--start", "2024-01-01", "--end", "2024-01-31", "--out", "x", option, *common], spark=spark)
    out = main(["period", "--start", "2023-12-31", "--end", "2024-02-01", "--out", str(tmp_path / "p")] + common,
               spark=spark)
    assert out["by_type_long"].count() > 0
    # every code is a rule here, so each route's rides equal its RouteSum; route 25 is not in it and stays
    rec = out["reconcile"].collect()
    assert {r.route for r in rec if r.ridership is None} == {"25"}
    assert len(rec) == 5 and all((r.year, r.month) == (2024, "Jan") and r.ridership in (None, r.ridership_td) for r in rec)
    assert (tmp_path / "p" / "period_rejected").exists()
    out = main(["scaleup", "--start", "2024-01-01", "--end", "2024-01-31", "--out", str(tmp_path / "s")] + common,
               spark=spark)
    assert out["scaled_daily"].count() > 0
    out = main(["season", "--start", "2024-01-10", "--end", "2024-01-31", "--control-start", "2024-01-01",
                "--out", str(tmp_path / "m")] + common, spark=spark)
    # the control series fills every day before the matched period; later gaps are days without local rides
    assert out["missing_days"].where(F.col("service_day") < F.lit("2024-01-10").cast("date")).count() == 0
    assert (tmp_path / "m" / "season_monthly").exists()


def test_command_line_over_two_months(spark, tmp_path):
    """Exact numbers: month pairing, fleet, rolled ends, missing gap, fraction."""
    from fareshift.__main__ import main
    folder = tmp_path / "reports"
    folder.mkdir()
    head = roles.TD_HEADER + "\n"
    ride = "100 FARE,{t},{bus},90,1,0,A1,1.75,1.75,,1,,,,\n"
    jan = [("1/5/2020 08:00:00", 1976), ("1/5/2020 09:00:00", 1976), ("1/5/2020 09:30:00", 55)]
    feb = [("2/5/2020 08:00:00", 1976)] * 2
    for name, rides in (("JANUARY", jan), ("FEBRUARY", feb)):
        (folder / f"TRANSACTION DETAIL {name} 1, 2020.csv").write_text(
            head + "".join(ride.format(t=t, bus=b) for t, b in rides) + "Number of Transactions: x\n")
        (folder / f"MONTHLY SUMMARY {name.title()} 1, 2020.txt").write_text(
            'Monthly\nRidership is defined as:\n"A1","Single Ride Full Fare",""\nAll other is excluded.\n')
        (folder / f"EVENT SUMMARY ({name.title()} 1, 2020).txt").write_text(
            f"Event Summary\nRidership By Route\nRoute,Ridership\n90,{3 if name == 'JANUARY' else 50}\nTOTAL,1\n")
    (folder / "TRANSACTION DETAIL MARCH 1, 2020.csv").write_text(ride.format(t="3/1/2020 08:00:00", bus=1976))
    pos = str(tmp_path / "pos")
    import datetime as dt
    spark.createDataFrame([(1, dt.datetime(2020, 1, 5, 8, 30), "1976", 61.0, 2), (2, dt.datetime(2020, 1, 5, 9, 30), "1976", 10.0, 2)],
                          "avl_history_id long, pos_time timestamp_ntz, vehicle_id string, latitude double, gps_status int") \
        .write.parquet(pos)
    args = ["period", "--reports", str(folder), "--positions", pos, "--start", "2020-01-01", "--end", "2020-01-31",
            "--north", "60", "--south", "20", "--out", str(tmp_path / "out")]
    out = main(args, spark=spark)
    assert [tuple(r)[:5] for r in out["reconcile"].collect()] == [(2020, "Jan", "90", 3, 3)]  # not 3 + 50
    # bus 55 is no corridor bus; the ride before the first position takes it (rolled), no gap
    assert [tuple(r) for r in out["by_type_long"].collect()] == [("Sunday", "901", 2)]
    q = out["questionable"].first()
    assert (q.n_rows, q.n_in_gap, q.questionable_pct) == (2, 1, 0.5)
    assert {r.file: r.rejected for r in out["rejected"].collect()} == {"TRANSACTION DETAIL MARCH 1, 2020.csv": 1}
    out = main([*args[:-1], str(tmp_path / "all"), "--fleet", "all", "--no-roll-ends", "--no-null-gap", "--percent"], spark=spark)
    q = out["questionable"].first()
    assert (q.n_rows, q.n_in_gap, q.n_bad_gps, q.questionable_pct) == (3, 1, 2, 100.0)


def test_scale_up_keeps_days_of_either_side(spark):
    import datetime as dt

    from fareshift.operators.control import scale_to_control
    d = [dt.date(2020, 1, i) for i in (1, 2, 3)]
    local = spark.createDataFrame([(d[0], 3, 1), (d[1], 5, 2)], "service_day date, ridership_901 long, ridership_902 long")
    control = spark.createDataFrame([(d[0], 8), (d[2], 4)], "service_day date, ridership long")
    got = {r.service_day: (r.ridership, r.final_901, r.final_902) for r in scale_to_control(local, control).collect()}
    assert got == {d[0]: (8, 6, 2), d[1]: (None, 5, 2), d[2]: (4, 0, 0)}


def test_season_in_increments_equals_one_run(spark, tmp_path):
    td, pos, rules = roles.td(spark, SF), roles.positions(spark, SF), roles.rules(spark)
    kw = dict(control=roles.daily_totals(spark, SF), control_start="2024-01-01", season_until="2024-01-25", **KW)
    whole = run_season(td, pos, rules, str(tmp_path / "a"), start="2024-01-10", end="2024-01-31", **kw)
    store = str(tmp_path / "store")
    for start, end in (("2024-01-10", "2024-01-18"), ("2024-01-18", "2024-01-31"), ("2024-01-18", "2024-01-31")):
        parts = run_season(td, pos, rules, str(tmp_path / "b"), start=start, end=end, store=store, **kw)
    assert sorted(whole) == sorted(parts)
    for name, df in whole.items():
        assert rows(df) == rows(parts[name]), name
    # a month run again under other options replaces its days
    again = run_season(td, pos, rules, str(tmp_path / "c"), start="2024-01-18", end="2024-01-31", store=store,
                       gap_seconds=120.0, null_is_gap=True, roll_ends=True, scale=1.0, **kw)
    q = again["questionable_by_month"].first()
    assert q.n_rows == whole["questionable_by_month"].first().n_rows
    assert q.questionable_pct == (q.n_after_last + q.n_in_gap + q.n_bad_gps) / q.n_rows


def test_season_quality_counts_what_the_matched_table_has(spark, tmp_path):
    """From daily counts, and straight from the matched rows."""
    from fareshift.operators.quality import (bad_gps_by_month_route, quality_flags, quality_report, questionable_by_month)
    from fareshift.operators.summary import service_summary_distinct
    from fareshift.plans.period import matched_table
    td, pos, rules = roles.td(spark, SF), roles.positions(spark, SF), roles.rules(spark)
    out = run_season(td, pos, rules, str(tmp_path), start="2024-01-10", end="2024-01-31", repair=None, gap_seconds=120.0, **KW)
    flagged = quality_flags(matched_table(td, pos, rules, start="2024-01-10", end="2024-01-31", route_pattern="^90", **KW),
                            gap_seconds=120.0)
    assert rows(out["questionable_by_month"]) == rows(questionable_by_month(flagged).select(out["questionable_by_month"].columns))
    assert rows(out["bad_gps_by_month_route"]) == rows(bad_gps_by_month_route(flagged))
    assert rows(out["quality"]) == rows(quality_report(pos, flagged))
    assert rows(out["by_route"]) == rows(service_summary_distinct(flagged))


def test_a_period_appended_twice_counts_once(spark, tmp_path):
    from fareshift.plans.period import run_period
    td, pos, rules = roles.td(spark, SF), roles.positions(spark, SF), roles.rules(spark)
    out = str(tmp_path)
    for start, end in (("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20"), ("2024-01-01", "2024-01-10")):
        got = run_period(td, pos, rules, out, start=start, end=end, fleet=None, label="p", mode="append", **KW)
    back = spark.read.csv(f"{out}/p_by_type_long", header=True,
                          schema="service_type string, local_route string, ridership long, period string")
    first = back.where("period = '2024-01-01_2024-01-10'").drop("period")
    assert rows(first) == rows(got["by_type_long"])
    assert {r.period for r in back.collect()} == {"2024-01-01_2024-01-10", "2024-01-11_2024-01-20"}
