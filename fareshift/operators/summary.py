"""Local-route ridership summaries (DOM-5, DOM-6, DOM-11, AGG-5, AGG-6, RSH-2, WIN-2, WIN-3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareshift.functions.calendar import SATURDAY, SUNDAY, WEEKDAY
from fareshift.functions.classify import (LOCAL_NORTH, LOCAL_SOUTH, NORTH_BOUNDARY, SOUTH_BOUNDARY,
                                          TRUNK, label_transfers, local_route, pass_type)
from fareshift.functions.timefns import month_name

LOCAL_ROUTES = (LOCAL_NORTH, LOCAL_SOUTH)
SERVICE_TYPES = (WEEKDAY, SATURDAY, SUNDAY)


def with_local_route(df: DataFrame, lat_col: str = "latitude", north: float = NORTH_BOUNDARY,
                     south: float = SOUTH_BOUNDARY, out: str = "local_route") -> DataFrame:
    """CLS-1 as a column."""
    return df.withColumn(out, local_route(lat_col, north, south))


def _local(df: DataFrame) -> DataFrame:
    return df.where(F.col("local_route") != F.lit(TRUNK))


def local_counts(matched: DataFrame, by: Sequence[str]) -> DataFrame:
    """DOM-5 (long): ridership of the local routes (not '90') by ``by``."""
    return _local(matched).groupBy(*by).agg(F.count(F.lit(1)).alias("ridership"))


def local_wide(matched: DataFrame, row_keys: Sequence[str], col_key: str, values: Sequence[str],
               prefix: str = "") -> DataFrame:
    """RSH-2: pivot local ridership, one column per value of ``col_key``.

    The values are listed, so Spark needs no extra job to find them; an
    absent cell is null.
    """
    p = _local(matched).groupBy(*row_keys).pivot(col_key, list(values)).agg(F.count(F.lit(1)))
    return p.select(*row_keys, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def local_by_month(matched: DataFrame, day_col: str = "service_day") -> DataFrame:
    """DOM-5 by month: local ridership per year and month name."""
    return local_counts(with_month(matched, day_col), ["year", "month"])


def with_month(df: DataFrame, day_col: str = "service_day") -> DataFrame:
    """Add ``year`` and ``month`` (English name): the key of a month; the name alone would add
    the same month of different years."""
    return df.withColumn("year", F.year(day_col)).withColumn("month", month_name(day_col))


def daily_series(matched: DataFrame, by: Sequence[str] = ("service_day", "service_type")) -> DataFrame:
    """Local ridership per day (one row per day and key): the input of the summaries."""
    return local_counts(matched, list(by))


def service_summary(daily: DataFrame, by: Sequence[str] = ("service_type",),
                    value_col: str = "ridership") -> DataFrame:
    """AGG-5: from daily counts, per group: total, number of days and the
    rounded (half-even) mean daily ridership.
    """
    return daily.groupBy(*by).agg(
        F.sum(value_col).alias("total_ridership"),
        F.count(F.lit(1)).alias("service_days"),
        F.bround(F.avg(value_col), 0).alias("average_daily_ridership"))


def service_summary_distinct(matched: DataFrame, by: Sequence[str] = ("service_type", "local_route"),
                             day_col: str = "service_day") -> DataFrame:
    """AGG-6: local rows per group over the group's distinct days, rounded half-even."""
    g = _local(matched).groupBy(*by).agg(F.count(F.lit(1)).alias("total_ridership"),
                                         F.countDistinct(day_col).alias("service_days"))
    return g.withColumn("average_daily_ridership",
                        F.bround(F.try_divide(F.col("total_ridership"), F.col("service_days")), 0))


def season_summary(daily: DataFrame, by: Sequence[str] = ("service_type",), until=None,
                   day_col: str = "service_day") -> DataFrame:
    """DOM-6: service summary over a combined daily series, optionally up to
    ``until`` (inclusive), and per month as one grouped query.
    """
    d = daily
    if until is not None:
        d = d.where(F.col(day_col) <= F.lit(until).cast("date"))
    return service_summary(d, by)


def daily_from_counts(counts: DataFrame, by: Sequence[str] = ("service_day", "service_type")) -> DataFrame:
    """DOM-5 / DOM-6 from stored daily counts (``plans.season.daily_counts``): what ``daily_series`` gives for
    the rows behind them."""
    return _local(counts).groupBy(*by).agg(F.sum("n_rows").alias("ridership"))


def service_summary_from_counts(counts: DataFrame, by: Sequence[str] = ("service_type", "local_route"),
                                day_col: str = "service_day") -> DataFrame:
    """AGG-6 from stored daily counts."""
    g = _local(counts).groupBy(*by).agg(F.sum("n_rows").alias("total_ridership"),
                                        F.countDistinct(day_col).alias("service_days"))
    return g.withColumn("average_daily_ridership",
                        F.bround(F.try_divide(F.col("total_ridership"), F.col("service_days")), 0))


def pass_mix(td_used: DataFrame, rules: DataFrame, day_col: str = "service_day") -> DataFrame:
    """DOM-11: pass-type mix by day.

    Every used transaction looks up its rule description (JOI-6, a left join
    from the transactions); transfers are relabelled 'Transfer' (FIX-2); the
    description maps to a pass type (CLS-3). Per (day, pass type): count,
    the day's total over typed passes (WIN-2) and the share (WIN-3). The
    windows run over the aggregated (day, type) rows.
    """
    r = rules.select(F.col("code").alias("_code"), F.col("description").alias("_rule_description"))
    r = r.groupBy("_code").agg(F.max("_rule_description").alias("_rule_description"))
    j = td_used.join(r, F.col("description") == F.col("_code"), "left")
    typed = j.withColumn("pass_type", pass_type(label_transfers("_rule_description", "type")))
    g = (typed.where(F.col("pass_type").isNotNull())
         .groupBy(day_col, "pass_type").agg(F.count(F.lit(1)).alias("number_of_passes")))
    w = Window.partitionBy(day_col)
    return (g.withColumn("daily_sum", F.sum("number_of_passes").over(w))
            .withColumn("share", F.try_divide(F.col("number_of_passes"), F.col("daily_sum"))))


PASS_TYPES = ("Single Ride", "Period Pass", "Stored Ride", "Free Key")


def pass_mix_wide(mix: DataFrame, day_col: str = "service_day") -> DataFrame:
    """RSH-2: one row per day, one count column per pass type (null when absent)."""
    p = mix.groupBy(day_col).pivot("pass_type", list(PASS_TYPES)).agg(F.sum("number_of_passes"))
    return p.select(day_col, *[F.col(f"`{v}`").alias(v.lower().replace(" ", "_")) for v in PASS_TYPES])


def order_for_report(df: DataFrame, *keys: str) -> DataFrame:
    """SRT-2: report order, service type as text descending (Weekday, Sunday,
    Saturday) as the reference's ``order(-Service_Type)``, then ``keys``.
    Apply at the sink only; no operator depends on row order.
    """
    cols = [F.col("service_type").desc()] if "service_type" in df.columns else []
    return df.orderBy(*cols, *keys)
