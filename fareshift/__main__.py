"""Command line: the three analysis runs over report folders and position data.

  python -m fareshift period  --reports DIR --start 2020-12-01 --end 2020-12-31 --positions P --out OUT
  python -m fareshift season  --reports DIR --start 2019-10-27 --end 2020-03-01 --positions P --out OUT
                              [--control-start 2019-09-01 --season-until 2019-12-31] [--store DIR]
  python -m fareshift scaleup --reports DIR --start 2019-09-01 --end 2019-10-27 --positions P --out OUT
                              [--other-totals CSV]

``--reports`` holds the rules, route summary, daily totals ("Local") and
transaction detail files (searched recursively). Positions are Parquet with
(avl_history_id, pos_time, vehicle_id, latitude, gps_status), or message and
position histories (``--vmh``, ``--avl``) joined by the positions reader.

An option that a run has no use for is refused. What is not given has the run's own default: the period
run takes the corridor's fleet, rolls both ends, counts a missing gap as a gap and gives fractions; the others
take every vehicle and roll nothing; the season counts no missing gap and gives percent.
"""

from __future__ import annotations

import argparse

from fareshift.functions.classify import NORTH_BOUNDARY, SOUTH_BOUNDARY
from fareshift.operators.quality import DEFAULT_GAP_SECONDS


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fareshift")
    p.add_argument("run", choices=["period", "season", "scaleup"])
    p.add_argument("--reports", required=True)
    p.add_argument("--start", required=True)
    p.add_argument("--end", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--positions")
    p.add_argument("--vmh")
    p.add_argument("--avl")
    p.add_argument("--period", help="month name in the report file names (all kinds)")
    p.add_argument("--year", help="year in the report file names (all kinds)")
    either = argparse.BooleanOptionalAction
    p.add_argument("--fleet", help="vehicles, as 1899,1970-1999 or 'all'")
    p.add_argument("--roll-ends", action=either, help="match rides before a vehicle's first position to it")
    p.add_argument("--null-gap", action=either, help="a missing gap is a gap (period, season)")
    p.add_argument("--gap-seconds", type=float, help=f"a longer gap is questionable, {DEFAULT_GAP_SECONDS:g} (period, season)")
    p.add_argument("--percent", action=either, help="questionable share in percent, else as a fraction (period, season)")
    p.add_argument("--repair", help="vehicle ids to replace before matching, as 0=1970,12=1981")
    p.add_argument("--append", action="store_true", help="replace this period's rows in the output folders, keep others'")
    p.add_argument("--north", type=float, default=NORTH_BOUNDARY)
    p.add_argument("--south", type=float, default=SOUTH_BOUNDARY)
    p.add_argument("--control-start", help="first day of the control series (season)")
    p.add_argument("--season-until", help="last day of the season summary (season)")
    p.add_argument("--store", help="folder of daily counts that this run's days are added to (season)")
    p.add_argument("--other-totals", help="CSV of another period's totals (scaleup)")
    p.add_argument("--master")
    return p


#: Options that only some runs have a use for.
ONLY = {"null_gap": ("period", "season"), "gap_seconds": ("period", "season"), "percent": ("period", "season"),
        "control_start": ("season",), "season_until": ("season",), "store": ("season",), "other_totals": ("scaleup",)}


def _fleet(text: str):
    """'1899,1970-1999' as (ids, ranges); 'all' as None."""
    if text == "all":
        return None
    parts = [x.split("-") for x in text.split(",")]
    return [int(x[0]) for x in parts if len(x) == 1], [(int(x[0]), int(x[1])) for x in parts if len(x) == 2]


def main(argv=None, spark=None) -> dict:
    from fareshift.session import get_session
    from fareshift.sources import reports
    from fareshift.sources.positions import read_positions

    parser = _parser()
    a = parser.parse_args(argv)
    for option, runs in ONLY.items():
        if getattr(a, option) is not None and a.run not in runs:
            parser.error(f"--{option.replace('_', '-')} has no meaning in the {a.run} run")
    spark = spark or get_session(a.master)
    chosen = {"period": a.period, "year": a.year}
    rules = reports.with_month_key(reports.read_rules(spark, a.reports, **chosen))
    td = reports.read_transactions(spark, a.reports, **chosen)
    if a.positions:
        positions = spark.read.parquet(a.positions)
    elif a.vmh and a.avl:
        positions = read_positions(spark.read.parquet(a.vmh), spark.read.parquet(a.avl), a.start, a.end)
    else:
        raise SystemExit("give --positions, or --vmh and --avl")
    kw = dict(north=a.north, south=a.south, start=a.start, end=a.end, label=a.run,
              mode="append" if a.append else "overwrite",
              rejected=reports.rejected_transactions(reports.transaction_lines(spark, a.reports, **chosen)))
    if a.repair:
        kw["repair"] = dict(x.split("=") for x in a.repair.split(","))
    if a.fleet:
        kw["fleet"] = _fleet(a.fleet)
    given = {"roll_ends": a.roll_ends, "null_is_gap": a.null_gap, "gap_seconds": a.gap_seconds,
             "scale": None if a.percent is None else 100.0 if a.percent else 1.0}
    kw |= {k: v for k, v in given.items() if v is not None}
    routesum = reports.with_month_key(reports.read_routesum(spark, a.reports, **chosen))
    if a.run == "period":
        from fareshift.plans.period import run_period
        return run_period(td, positions, rules, a.out, routesum=routesum, **kw)
    control = reports.read_daily_totals(spark, a.reports, **chosen)
    if a.run == "season":
        from fareshift.plans.season import run_season
        return run_season(td, positions, rules, a.out, control=control, control_start=a.control_start,
                          season_until=a.season_until, routesum=routesum, store=a.store, **kw)
    from fareshift.plans.season import run_scaleup
    other = None
    if a.other_totals:
        other = spark.read.csv(a.other_totals, header=True,
                               schema="local_route string, service_type string, ridership long")
    return run_scaleup(td, positions, rules, control, a.out, other_totals=other, **kw)


if __name__ == "__main__":
    main()
