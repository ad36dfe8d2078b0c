"""Matching transactions to vehicle positions (DOM-4, DOM-10, QLT-5)."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareshift.functions.classify import outside_corridor, NORTH_BOUNDARY, SOUTH_BOUNDARY
from fareshift.functions.timefns import between_days, service_day, SERVICE_DAY_START_HOUR
from fareshift.operators.asof import asof_both, asof_join

POSITION_COLS = ("avl_history_id", "latitude", "gps_status", "trip")


def with_service_day(df: DataFrame, time_col: str, out: str = "service_day",
                     start_hour: int = SERVICE_DAY_START_HOUR) -> DataFrame:
    """DT-3 as a column of ``df`` (kept when already present)."""
    if out in df.columns:
        return df
    return df.withColumn(out, service_day(time_col, start_hour))


def transactions_in_period(td: DataFrame, start=None, end=None, inclusive: bool = False,
                           time_col: str = "txn_time") -> DataFrame:
    """Add the service day and keep ``start <= day < end`` (``<= end`` if inclusive); a bound that is
    None is open.

    The day filter is written on the timestamp as well, so the parquet scan
    can skip row groups outside the period (the day is a shifted timestamp).
    """
    out = with_service_day(td, time_col)
    if start is not None:
        first = F.lit(start).cast("date")
        out = out.where((F.col("service_day") >= first) & (F.col(time_col) >= first.cast("timestamp_ntz")))
    if end is not None:
        out = out.where(between_days("service_day", "0001-01-01", end, inclusive))
        hi_day = F.date_add(F.lit(end).cast("date"), 2 if inclusive else 1)
        out = out.where(F.col(time_col) < hi_day.cast("timestamp_ntz"))
    return out


def match_positions(td: DataFrame, positions: DataFrame, *, by: Sequence[str] = ("vehicle_id", "service_day"),
                    txn_time: str = "txn_time", pos_time: str = "pos_time",
                    position_cols: Sequence[str] = POSITION_COLS, tie: str | None = "avl_history_id",
                    roll_ends: bool = False, last_time: str | None = "maxtime",
                    bucket_unit: str = "minute", ties: str = "last", direction: str = "backward",
                    tolerance: float | None = None, how: str = "left", stored: int | None = None) -> DataFrame:
    """DOM-4: each transaction with its vehicle's last position of that service day.

    Both sides get their service day (if missing) and meet in one as-of join
    keyed by (vehicle, service day). Also carries ``last_time`` (the latest
    position of the vehicle-day, JOI-7) without a second join. The row count
    equals the transaction count (``ties="last"``, ``how="left"``). ``tie`` orders
    positions of one time and must be a column of ``positions``; pass ``None``
    where times are unique. ``stored`` as in ``asof_join``. Select the transaction columns you want
    first: all of them travel through the match.
    """
    if tie is not None and tie not in positions.columns:
        raise ValueError(f"tie column {tie!r} is not among the positions' columns")
    if "service_day" not in by:
        warnings.warn("matching without service_day: each key's whole history forms one carry-in "
                      "window group; pass a coarser bucket_unit for long histories", stacklevel=2)
    left = with_service_day(td, txn_time) if "service_day" in by else td
    right = with_service_day(positions, pos_time) if "service_day" in by else positions
    cols = [c for c in position_cols if c in right.columns and c not in by]
    return asof_join(left, right, by=list(by), left_time=txn_time, right_time=pos_time,
                     right_cols=cols, tie=tie, roll_ends=roll_ends, last_time=last_time, bucket_unit=bucket_unit,
                     ties=ties, direction=direction, tolerance=tolerance, how=how, stored=stored)


def asof_comparison(td: DataFrame, positions: DataFrame, tolerance_seconds: float = 120.0,
                    north: float = NORTH_BOUNDARY, south: float = SOUTH_BOUNDARY,
                    by: Sequence[str] = ("vehicle_id", "service_day")) -> DataFrame:
    """DOM-10: local (outside-corridor) counts by the exact backward match and
    by the forward match within ``tolerance_seconds`` (unmatched dropped).

    Both matches come from one as-of pass (``asof_both``), then one aggregate.
    """
    left = with_service_day(td, "txn_time").select(*by, "txn_time")
    right = with_service_day(positions, "pos_time")
    both = asof_both(left, right, by=list(by), left_time="txn_time", right_time="pos_time",
                     right_cols=["latitude"], tie="avl_history_id", after=tolerance_seconds)
    fuzzy = F.col("next_pos_time").isNotNull()
    return both.agg(
        F.count(F.when(outside_corridor("prev_latitude", north, south), 1)).alias("local_exact_match"),
        F.count(F.when(fuzzy & outside_corridor("next_latitude", north, south), 1)).alias("local_fuzzy_match"),
        F.count(F.lit(1)).alias("n_exact"),
        F.count(F.when(fuzzy, 1)).alias("n_fuzzy"))


def match_count_check(matched: DataFrame, td: DataFrame,
                      by: Sequence[str] = ("vehicle_id", "service_day")) -> DataFrame:
    """QLT-5: per (vehicle, day), transactions before and after matching.

    ``diff = td_count - roll_count`` must be 0 everywhere: the as-of join
    neither loses nor adds rows. The two counts meet in a left join on keys
    named differently on each side (JOI-8), null-safe on the vehicle.
    """
    by = list(by)
    rolled = matched.groupBy(*by).agg(F.count(F.lit(1)).alias("roll_count"))
    src = with_service_day(td, "txn_time") if "service_day" in by else td
    tdc = src.groupBy(*[F.col(k).alias(f"td_{k}") for k in by]).agg(F.count(F.lit(1)).alias("td_count"))
    cond = None
    for k in by:
        e = rolled[k].eqNullSafe(tdc[f"td_{k}"])
        cond = e if cond is None else cond & e
    j = rolled.join(tdc, cond, "left")
    return j.select(*by, "roll_count", "td_count",
                    (F.col("td_count") - F.col("roll_count")).alias("diff"))
