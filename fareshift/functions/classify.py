"""Row classifiers and predicates (FLT-2..9, FIX-1..2, CLS-1, CLS-3, CLS-4)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fareshift.functions import as_col

# Fixed values from the agency analysis.
# Corridor boundaries (latitude): north of NORTH is local route 901, south of
# SOUTH is local route 902, anything else (including no position) trunk 90.
NORTH_BOUNDARY = 39.877512
SOUTH_BOUNDARY = 39.709468
LOCAL_NORTH = "901"
LOCAL_SOUTH = "902"
TRUNK = "90"
# A transaction whose Type contains "118" is a transfer and counts as ridership.
TRANSFER_TYPE = "118"
# GPSStatus 2 is a good fix.
GOOD_GPS = 2
# The fleet of the corridor: bus 1899 and buses 1970 to 1999.
FLEET_IDS = (1899,)
FLEET_RANGES = ((1970, 1999),)
# Vehicle 0 on the transaction side is bus 1970.
VEHICLE_REPAIRS = {"0": "1970"}

# Pass types by fare description.
PERIOD_PASSES = (
    "31 HALF", "31 FULL", "7 DAY FULL", "ALL DAY FULL", "7 DAY HALF", "ALL DAY HALF",
    "31 DAY S PASS", "Comp Day Pass", "Comp 31 day pass", "LA1 Issue Day Pass",
    "RA1 Issue Day Half",
)
SINGLE_RIDE_PASSES = (
    "Single Ride Full Fare", "Single Ride Half Fare", "LA2 Single Full", "RA2 Single Half",
    "RA3 UnderPayment", "*1 COURTESY ISSUED",
)
STORED_RIDE_CARDS = ("10 TRIP FULL", "Comp 10 Trip Pass")
FREE_DESCRIPTION = "Free"
TRANSFER_DESCRIPTION = "Transfer"


def local_route(latitude, north: float = NORTH_BOUNDARY, south: float = SOUTH_BOUNDARY) -> Column:
    """CLS-1: '901' north of the corridor, '902' south of it, else '90'.

    Strict inequalities; a null latitude falls to '90'.
    """
    lat = as_col(latitude)
    return (F.when(lat > F.lit(north), F.lit(LOCAL_NORTH))
            .when(lat < F.lit(south), F.lit(LOCAL_SOUTH))
            .otherwise(F.lit(TRUNK)))


def outside_corridor(latitude, north: float = NORTH_BOUNDARY, south: float = SOUTH_BOUNDARY) -> Column:
    """FLT-7: latitude north of ``north`` or south of ``south`` (null is false)."""
    lat = as_col(latitude)
    return F.coalesce((lat > F.lit(north)) | (lat < F.lit(south)), F.lit(False))


def is_transfer(type_col) -> Column:
    """Type contains '118' (null is false)."""
    return F.coalesce(as_col(type_col).contains(TRANSFER_TYPE), F.lit(False))


def bad_gps(status) -> Column:
    """FLT-8: GPS status is missing or not 2."""
    s = as_col(status)
    return s.isNull() | (s != F.lit(GOOD_GPS))


def gps_flag(status) -> Column:
    """CLS-4: 0 when the status is 0, else 1 (counts rows whose status is not 0)."""
    return F.when(as_col(status) == 0, F.lit(0)).otherwise(F.lit(1))


def route_like(route, pattern: str = "^90") -> Column:
    """FLT-2: route matches a regular expression (null is false)."""
    return F.coalesce(as_col(route).rlike(pattern), F.lit(False))


def in_fleet(vehicle, ids: Iterable[int] = FLEET_IDS,
             ranges: Iterable[tuple[int, int]] = FLEET_RANGES) -> Column:
    """FLT-4: vehicle number is one of ``ids`` or inside one of ``ranges``.

    The vehicle may be text; it is compared as a number. The intended set is
    built (1899 and 1970-1999), not the variant that can never admit 1899.
    """
    v = as_col(vehicle).try_cast("long")
    cond = F.lit(False)
    ids = list(ids)
    if ids:
        cond = cond | v.isin(ids)
    for lo, hi in ranges:
        cond = cond | v.between(lo, hi)
    return F.coalesce(cond, F.lit(False))


def repair_vehicle(vehicle, mapping: dict[str, str] | None = None) -> Column:
    """FIX-1: replace listed vehicle ids (default '0' -> '1970')."""
    mapping = VEHICLE_REPAIRS if mapping is None else mapping
    v = as_col(vehicle)
    out = v
    for bad, good in mapping.items():
        out = F.when(v == F.lit(bad), F.lit(good)).otherwise(out)
    return out


def label_transfers(description, type_col) -> Column:
    """FIX-2: the description of a transfer (Type contains '118') becomes 'Transfer'."""
    return F.when(is_transfer(type_col), F.lit(TRANSFER_DESCRIPTION)).otherwise(as_col(description))


def pass_type(description) -> Column:
    """CLS-3: pass type from the fare description; unmapped stays null."""
    d = as_col(description)
    return (F.when(d == F.lit(FREE_DESCRIPTION), F.lit("Free Key"))
            .when(d.isin(list(SINGLE_RIDE_PASSES)), F.lit("Single Ride"))
            .when(d.isin(list(PERIOD_PASSES)), F.lit("Period Pass"))
            .when(d.isin(list(STORED_RIDE_CARDS)), F.lit("Stored Ride")))
