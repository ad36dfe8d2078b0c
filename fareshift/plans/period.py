"""One analysis period end to end (the parameterised monthly run).

rules + transactions -> ridership -> service day and period -> as-of match to
positions -> last position, quality flags -> service type, local route ->
summaries. Every step is a lazy DataFrame transformation; one job runs per sink.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareshift.functions.calendar import with_service_type
from fareshift.functions.classify import (FLEET_IDS, FLEET_RANGES, NORTH_BOUNDARY, SOUTH_BOUNDARY, in_fleet,
                                          repair_vehicle, route_like)
from fareshift.operators.matching import match_positions, transactions_in_period
from fareshift.operators.quality import DEFAULT_GAP_SECONDS, quality_flags, questionable_pct
from fareshift.operators.ridership import reconcile, reconcile_by_month, ridership_only, route_order
from fareshift.operators.summary import SERVICE_TYPES, local_counts, local_wide, with_local_route
from fareshift.sources.sinks import write_detail, write_summary


# Transaction columns dropped before matching.
TD_NOT_CARRIED = ("driver", "value", "amount", "longitude", "latitude")


def used_transactions(td: DataFrame, rules: DataFrame, *, start=None, end=None, inclusive: bool = False,
                      route_pattern: str | None = None, fleet: tuple[Iterable[int], Iterable[tuple[int, int]]] | None = None,
                      repair: dict[str, str] | None = None) -> DataFrame:
    """Ridership transactions of the period, with their service day.

    ``route_pattern`` (FLT-2, e.g. '^90') and ``fleet`` (FLT-4, (ids, ranges))
    select the corridor's transactions by route or by vehicle; ``repair``
    (FIX-1) fixes vehicle ids before matching.
    """
    t = ridership_only(td, rules)
    # the reference's clean step: farebox amounts and the farebox's own
    # coordinates are not carried into the match (positions supply them)
    t = t.drop(*[c for c in TD_NOT_CARRIED if c in t.columns])
    if route_pattern:
        t = t.where(route_like("route", route_pattern))
    if fleet is not None:
        ids, ranges = fleet
        t = t.where(in_fleet("vehicle_id", ids, ranges))
    if repair:
        t = t.withColumn("vehicle_id", repair_vehicle("vehicle_id", repair))
    return transactions_in_period(t, start, end, inclusive)


def matched_table(td: DataFrame, positions: DataFrame, rules: DataFrame, *, start=None, end=None,
                  inclusive: bool = False, route_pattern: str | None = None, fleet=None,
                  repair: dict[str, str] | None = None, roll_ends: bool = False,
                  north: float = NORTH_BOUNDARY, south: float = SOUTH_BOUNDARY,
                  bucket_unit: str = "minute", ties: str = "last",
                  position_cols: tuple[str, ...] = ("avl_history_id", "latitude", "gps_status", "trip"),
                  columns: Sequence[str] | None = None) -> DataFrame:
    """The matched table: every used transaction with its position, the
    vehicle-day's last position time (``maxtime``), service type and local route.

    ``position_cols`` names the position columns carried through the match;
    a summary that needs only the latitude passes ``("latitude",)`` so the
    other position columns are neither read nor shuffled. ``columns`` does the same for
    the transactions (None: all); vehicle, time and service day are always carried.
    """
    used = used_transactions(td, rules, start=start, end=end, inclusive=inclusive,
                             route_pattern=route_pattern, fleet=fleet, repair=repair)
    if columns is not None:
        used = used.select(*dict.fromkeys(["vehicle_id", "service_day", "txn_time", *columns]))
    pos = positions
    if start is not None or end is not None:
        # Positions bounded by service day too (not by calendar midnight), so
        # the tail of the last service day is kept.
        pos = transactions_in_period(pos, start, end, inclusive, time_col="pos_time")
    m = match_positions(used, pos, roll_ends=roll_ends, bucket_unit=bucket_unit, position_cols=position_cols,
                        ties=ties)
    m = with_service_type(m, "service_day")
    return with_local_route(m, "latitude", north, south)


def materialize(df: DataFrame, name: str, partition_by: str | None = "service_day") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    This cuts the lineage of an expensive intermediate that several sinks
    read (the matched table): each sink then scans the written files
    instead of re-running the as-of join, and a lost executor costs a
    re-read, not a recomputation. The folder is the cluster's
    ``spark.checkpoint.dir`` (set locally only when absent).
    """
    import uuid

    from fareshift.session import ensure_checkpoint_dir

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/fareshift/{name}-{uuid.uuid4().hex}"
    if partition_by and partition_by in df.columns:
        write_detail(df, path, partition_by)
    else:
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


DEFAULT_FLEET = (FLEET_IDS, FLEET_RANGES)


def run_period(td: DataFrame, positions: DataFrame, rules: DataFrame, out_dir: str, *, start, end,
               inclusive: bool = True, label: str = "period", routesum: DataFrame | None = None,
               rejected: DataFrame | None = None, fleet=DEFAULT_FLEET, roll_ends: bool = True, ties: str = "all",
               null_is_gap: bool = True, gap_seconds: float = DEFAULT_GAP_SECONDS, scale: float = 1.0,
               mode: str = "overwrite", period: str | None = None, **kw) -> dict[str, DataFrame]:
    """Entry point for one analysis period: match once, then every summary.

    By default as the parameterised script runs it: the corridor's fleet only, both ends
    of a vehicle-day rolled, every position at exactly a transaction's time, a missing
    gap counted as a gap, the questionable share as a fraction (``scale=100`` for percent).

    The matched table is written once (``materialize``); the quality share,
    the three local-route summaries of the period (by day, by service type
    long and wide) are computed from the written table and saved as CSV
    (SNK-1) under ``out_dir``, rows in report order. With a ``routesum`` the route
    reconciliation of the period's transactions is written too: by month where it has
    month and year (``with_month_key``), else by route; routes without a control keep their row. ``rejected`` (file, rejected)
    is written as it is. Each folder has a column ``period`` (default start_end); ``mode="append"`` replaces
    that period's rows and keeps the others'. Returns the summaries (lazy, read from disk).
    """
    matched = matched_table(td, positions, rules, start=start, end=end, inclusive=inclusive, fleet=fleet,
                            roll_ends=roll_ends, ties=ties, **kw)
    matched = materialize(quality_flags(matched, null_is_gap=null_is_gap, gap_seconds=gap_seconds), f"{label}-matched")
    outputs = {
        "questionable": (questionable_pct(matched, scale), ()),
        "by_day": (local_wide(matched, ["service_day"], "local_route", ("901", "902"), "ridership_"), ("service_day",)),
        "by_type_wide": (local_wide(matched, ["local_route"], "service_type", SERVICE_TYPES), ("local_route",)),
        "by_type_long": (local_counts(matched, ["service_type", "local_route"]),
                         (F.col("service_type").desc(), "local_route")),
    }
    if routesum is not None:
        own = transactions_in_period(td, start, end, inclusive)
        if {"year", "month"} <= set(routesum.columns):
            found, keys = reconcile_by_month(own, rules, routesum, how="left"), ("year", "month")
        else:
            whole = routesum.groupBy("route").agg(F.sum("ridership").alias("ridership"))
            found, keys = reconcile(own, rules, whole, how="left"), ()
        outputs["reconcile"] = (found, (*keys, *route_order()))
    if rejected is not None:
        outputs["rejected"] = (rejected, ("file",))
    return write_outputs(outputs, out_dir, label, mode, period or f"{start}_{end}")


def write_outputs(outputs: dict, out_dir: str, label: str, mode: str, period: str) -> dict[str, DataFrame]:
    """Write each (frame, order) as a CSV folder with the period; returns the frames."""
    for name, (df, order) in outputs.items():
        write_summary(df, f"{out_dir.rstrip('/')}/{label}_{name}", mode=mode, order_by=order, period=period)
    return {name: df for name, (df, _) in outputs.items()}
