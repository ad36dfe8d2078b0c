"""Several months end to end: daily local ridership, a control series for the
months before the matched data, completeness checks, season and monthly
summaries. And the circulator run: daily comparison with control totals,
proportional scale-up, combination with another period's totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareshift.functions.calendar import date_spine, missing_days, with_service_type
from fareshift.functions.classify import VEHICLE_REPAIRS
from fareshift.operators.control import (combine_totals, combine_totals_wide, compare_daily,
                                         compare_daily_overall, scale_to_control, scaled_by_service_type)
from fareshift.operators.quality import (COUNTS, DEFAULT_GAP_SECONDS, bad_gps_from_counts, fault_counts, quality_flags,
                                         quality_report_from_counts, shares_from_counts)
from fareshift.operators.ridership import count_by, reconcile_by_month, route_order
from fareshift.operators.summary import (LOCAL_ROUTES, daily_from_counts, local_wide, service_summary,
                                         service_summary_from_counts, with_month)
from fareshift.plans.period import materialize, matched_table, used_transactions, write_outputs


def type_order():
    """Service types in report order (text, descending)."""
    return F.col("service_type").desc()


def daily_counts(flagged: DataFrame, start, end) -> DataFrame:
    """Flagged rows (``quality_flags`` of the matched table) as counts by day, service type and local route.

    Every summary of the season run is a sum of these counts, so they are what a run keeps. Each
    day of [start, end) has a row more with counts of 0 and no type: a day that was run and had no
    rides differs from one that was not run.
    """
    by = ["service_day", "service_type", "local_route"]
    counts = flagged.groupBy(*by).agg(*fault_counts())
    days = date_spine(flagged.sparkSession, start, _date_text(end, -1))
    return counts.unionByName(days.select("service_day", *[F.lit(0).cast("long").alias(c) for c in COUNTS]),
                              allowMissingColumns=True)


def store_daily_counts(counts: DataFrame, path: str) -> DataFrame:
    """Write daily counts below ``path``, replacing the days they hold (dynamic partition overwrite by
    day) and no others, and read the whole store. The season grows by later months without matching earlier
    ones again, and a month run again counts once."""
    (counts.repartition("service_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("service_day").parquet(path))
    return counts.sparkSession.read.schema(counts.schema).parquet(path)


def run_season(td: DataFrame, positions: DataFrame, rules: DataFrame, out_dir: str, *, start, end,
               control: DataFrame | None = None, control_start=None, season_until=None,
               route_pattern: str | None = "^90", label: str = "season", routesum: DataFrame | None = None,
               rejected: DataFrame | None = None, repair: dict[str, str] | None = VEHICLE_REPAIRS,
               null_is_gap: bool = False, gap_seconds: float = DEFAULT_GAP_SECONDS, scale: float = 100.0,
               store: str | None = None, mode: str = "overwrite", period: str | None = None,
               **kw) -> dict[str, DataFrame]:
    """Matched daily series for [start, end) plus, optionally, a control series
    (service_day, ridership) from ``control_start`` to the first matched day; then the completeness
    check, the season summary (up to ``season_until``), the per-month
    summaries by service type, the summary by local route, the quality report, bad GPS by month and
    by month and route, the questionable share by month (``scale`` 1.0 for fractions), and with a ``routesum``
    (month and year) the monthly reconciliation, written as CSV.
    ``repair`` fixes vehicle ids before the match; ``gap_seconds`` (one analysis took 120), ``null_is_gap``,
    ``fleet``, ``roll_ends`` and ``ties`` are as in the period run.

    The match is kept as daily counts only. With a ``store`` (a folder) these are added to the days already
    there and the summaries are of all stored days: months can be run one after another.
    """
    matched = quality_flags(matched_table(
        td, positions, rules, start=start, end=end, route_pattern=route_pattern, repair=repair,
        position_cols=("avl_history_id", "latitude", "gps_status"), columns=(), **kw),
        null_is_gap=null_is_gap, gap_seconds=gap_seconds)
    counts = daily_counts(matched, start, end)
    counts = store_daily_counts(counts, store) if store else materialize(counts, f"{label}-daily", partition_by=None)
    days = counts.agg(F.min("service_day").alias("first"), F.max("service_day").alias("last")).first()
    counts = counts.where("n_rows > 0")
    daily = daily_from_counts(counts)
    series, first_day = daily, days["first"]
    if control is not None:
        ctl = control.where(F.col("service_day") < F.lit(first_day))
        if control_start is not None:
            ctl = ctl.where(F.col("service_day") >= F.lit(control_start).cast("date"))
            first_day = control_start
        ctl = with_service_type(ctl, "service_day").select("service_day", "service_type", "ridership")
        series = ctl.unionByName(daily)
    until = F.lit(season_until).cast("date") if season_until else F.lit(days["last"])
    by_month = with_month(counts)
    outputs = {
        "daily": (series, ("service_day",)),
        "missing_days": (missing_days(series, first_day, days["last"]), ("service_day",)),
        "season": (service_summary(series.where(F.col("service_day") <= until), ["service_type"]), (type_order(),)),
        "monthly": (service_summary(with_month(series), ["year", "month", "service_type"]),
                    ("year", "month", type_order())),
        "by_route": (service_summary_from_counts(counts), (type_order(), "local_route")),
        "quality": (quality_report_from_counts(positions, counts), ()),
        "bad_gps_by_month": (bad_gps_from_counts(by_month, ["year", "month"]), ("year", "month")),
        "bad_gps_by_month_route": (bad_gps_from_counts(by_month, ["year", "month", "local_route"]),
                                   ("year", "month", "local_route")),
        "questionable_by_month": (shares_from_counts(by_month, ["year", "month"], scale), ("year", "month")),
    }
    if routesum is not None:
        outputs["reconcile"] = (reconcile_by_month(td, rules, routesum, how="left"), ("year", "month", *route_order()))
    if rejected is not None:
        outputs["rejected"] = (rejected, ("file",))
    return write_outputs(outputs, out_dir, label, mode, period or f"{start}_{end}")


def run_scaleup(td: DataFrame, positions: DataFrame, rules: DataFrame, control: DataFrame, out_dir: str, *,
                start, end, other_totals: DataFrame | None = None, route_pattern: str = "^90",
                label: str = "scaleup", rejected: DataFrame | None = None, mode: str = "overwrite",
                period: str | None = None, **kw) -> dict[str, DataFrame]:
    """Daily count against the control series, and the matched local count against it;
    901/902 scaled up to it per day, totals per service type (long), optionally added to another
    period's (local_route, service_type, ridership) totals, long and wide, as CSV. ``fleet``, ``repair``,
    ``roll_ends`` and ``ties`` are those of the match; gaps play no part here.
    """
    used = used_transactions(td, rules, start=start, end=end, route_pattern=route_pattern)
    bound = (F.col("service_day") >= F.lit(start).cast("date")) & (F.col("service_day") < F.lit(end).cast("date"))
    control = control.where(bound)
    compared = compare_daily(count_by(used, "service_day", out="n"), control)
    matched = matched_table(td, positions, rules, start=start, end=end, route_pattern=route_pattern,
                            position_cols=("avl_history_id", "latitude"), columns=(), **kw)
    wide = materialize(local_wide(matched, ["service_day"], "local_route", LOCAL_ROUTES, "ridership_"),
                       f"{label}-local-daily")
    local = wide.select("service_day", (F.coalesce("ridership_901", F.lit(0)) + F.coalesce("ridership_902", F.lit(0)))
                        .alias("n"))
    compared_local = compare_daily(local, control)
    scaled = scale_to_control(wide, control)
    by_type = scaled_by_service_type(with_service_type(scaled, "service_day"))
    combined = combine_totals(by_type, other_totals) if other_totals is not None else by_type
    day = ("service_day",)
    outputs = {
        "compare_daily": (compared, day),
        "compare_overall": (compare_daily_overall(compared), ()),
        "compare_local_daily": (compared_local, day),
        "compare_local_overall": (compare_daily_overall(compared_local), ()),
        "scaled_daily": (scaled, day),
        "totals": (combined, ("local_route", type_order())),
        "totals_wide": (combine_totals_wide(combined), ("local_route",)),
    }
    if rejected is not None:
        outputs["rejected"] = (rejected, ("file",))
    return write_outputs(outputs, out_dir, label, mode, period or f"{start}_{end}")


def _date_text(day, shift: int) -> str:
    import datetime as dt
    d = dt.date.fromisoformat(str(day)) + dt.timedelta(days=shift)
    return d.isoformat()
