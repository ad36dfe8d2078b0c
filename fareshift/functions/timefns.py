"""Date and time functions on the agency wall clock (TIMESTAMP_NTZ).

All functions return Columns built from Spark built-ins, so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fareshift.functions import as_col

# The service day starts at 03:00 (a clock time before 03:00:00
# belongs to the previous day), and the report date-time layouts.
SERVICE_DAY_START_HOUR = 3
REPORT_DATE_FORMAT = "M/d/yyyy"


def service_day(ts, start_hour: int = SERVICE_DAY_START_HOUR) -> Column:
    """DT-3: the 03:00-to-03:00 service day of a timestamp.

    02:59:59 falls on the previous date, 03:00:00 on the same date.
    """
    return F.to_date(as_col(ts) - F.make_dt_interval(hours=F.lit(start_hour)))


def day_start(day) -> Column:
    """Midnight of a date as TIMESTAMP_NTZ."""
    return as_col(day).cast("timestamp_ntz")


def elapsed_seconds(start, end) -> Column:
    """Exact elapsed seconds ``end - start`` (double, microsecond precision).

    Whole-second differences would truncate and accept 7,200.9 s under a
    7,200 s limit, so the difference is taken in microseconds.
    """
    return F.timestamp_diff("MICROSECOND", as_col(start), as_col(end)) / 1e6


def service_seconds(ts, day=None, start_hour: int = SERVICE_DAY_START_HOUR) -> Column:
    """DT-4: seconds since midnight of the service day (may pass 86,400)."""
    d = as_col(day) if day is not None else service_day(ts, start_hour)
    return elapsed_seconds(day_start(d), ts)


def clock_seconds(ts) -> Column:
    """Whole seconds since midnight of the calendar date (time of day)."""
    c = as_col(ts)
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c)).cast("int")


def time_gap_seconds(txn_time, pos_time, clock: bool = False) -> Column:
    """DT-8: seconds from the matched position to the transaction.

    By default the elapsed time. ``clock=True`` gives the reference's
    difference of clock times, where a match across midnight is about
    -86,000 s (kept only for parity checks).
    """
    if clock:
        return (clock_seconds(txn_time) - clock_seconds(pos_time)).cast("double")
    return elapsed_seconds(pos_time, txn_time)


_REPORT_TS = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?\s*$"
_ISO_TS = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})[ T](\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?))?\s*$"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_report_timestamp(text) -> Column:
    """DT-1: month-day-year report text to TIMESTAMP_NTZ; bad text gives null.

    24-hour ('11/2/2019 13:05:09') and AM/PM ('11/2/2019 1:05:09 PM') layouts
    are accepted; seconds are optional. The parts are assembled with
    ``try_make_timestamp_ntz``, so the wall-clock text is kept as written in
    any session time zone, and impossible dates give null.
    """
    c = F.trim(as_col(text))

    def assemble(p: Column) -> Column:
        num = lambda i: F.try_element_at(p, F.lit(i)).try_cast("int")
        hour, ampm = num(4), F.upper(F.element_at(p, -1))
        hour24 = (F.when(~ampm.isin("AM", "PM"), hour)
                  .when(hour.between(1, 12), hour % 12 + F.when(ampm == "PM", 12).otherwise(0)))
        secs = F.coalesce(num(6), F.lit(0)).cast("decimal(16,6)")
        return F.try_make_timestamp_ntz(num(3), num(1), num(2), hour24, num(5), secs)

    # One match and one split; the parts are a lambda's variable, so they are made once.
    parts = F.split(c, r"[/:\s]+|(?<=\d)(?=[AaPp])")
    return F.when(c.rlike(_REPORT_TS), F.element_at(F.transform(F.array(parts), assemble), 1))


def parse_report_date(text) -> Column:
    """DT-1 (date only): ``M/d/yyyy`` text to DATE; bad text gives null."""
    return F.try_to_date(F.trim(as_col(text)), REPORT_DATE_FORMAT)


def parse_iso_timestamp(text) -> Column:
    """DT-2: ISO text (space or ``T`` separator) to TIMESTAMP_NTZ; bad text gives null."""
    c = as_col(text)
    num = lambda g: _part(c, _ISO_TS, g).try_cast("int")
    secs = F.coalesce(_part(c, _ISO_TS, 6).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
    return F.try_make_timestamp_ntz(num(1), num(2), num(3), num(4), num(5), secs)


def clock_text(ts) -> Column:
    """DT-5: ``HH:mm:ss`` clock text, from the wall-clock fields (``date_format``
    would route a TIMESTAMP_NTZ through the session time zone)."""
    c = as_col(ts)
    return F.format_string("%02d:%02d:%02d", F.hour(c), F.minute(c), F.second(c))


def month_name(day) -> Column:
    """DT-5: English month name."""
    return F.date_format(as_col(day), "MMMM")


def weekday_name(day) -> Column:
    """DT-7: English weekday name."""
    return F.date_format(as_col(day), "EEEE")


def between_days(day, start, end, inclusive: bool = False) -> Column:
    """FLT-5 / FLT-6: ``start <= day < end`` (half-open) or ``<= end``."""
    d = as_col(day)
    lo = F.lit(start).cast("date") if not isinstance(start, Column) else start
    hi = F.lit(end).cast("date") if not isinstance(end, Column) else end
    return (d >= lo) & ((d <= hi) if inclusive else (d < hi))
