"""Holiday calendar, service type and date spine (DT-6, DT-7, DT-9, CLS-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareshift.functions import as_col
from fareshift.functions.timefns import weekday_name

# Fixed values (the agency's service rules):
#   Saturday service on: Martin Luther King Jr. Day (third Monday in January).
#   Sunday service on: New Year's Day (1 Jan), Memorial Day (last Monday in May),
#   Independence Day (4 Jul), Labor Day (first Monday in September),
#   Thanksgiving Day (fourth Thursday in November), Christmas Day (25 Dec).
#   Holidays fall on their actual date; there is no observed-day shift.
#   The reference builds the list for 2000 to 2020; the range is an argument here.
DEFAULT_FIRST_YEAR = 2000
DEFAULT_LAST_YEAR = 2020
SATURDAY = "Saturday"
SUNDAY = "Sunday"
WEEKDAY = "Weekday"


def _first_on_or_after(d: Column, dow: str) -> Column:
    """First ``dow`` (e.g. 'Mon') on or after date ``d``."""
    return F.next_day(F.date_sub(d, 1), dow)


def _holidays_of_year(y: Column) -> Column:
    """Array of (holiday, service, holiday_date) structs for year ``y``."""
    def h(name: str, service: str, day: Column) -> Column:
        return F.struct(F.lit(name).alias("holiday"), F.lit(service).alias("service"),
                        day.alias("holiday_date"))

    return F.array(
        h("New Year's Day", SUNDAY, F.make_date(y, F.lit(1), F.lit(1))),
        h("Martin Luther King Jr. Day", SATURDAY,
          F.date_add(_first_on_or_after(F.make_date(y, F.lit(1), F.lit(1)), "Mon"), 14)),
        h("Memorial Day", SUNDAY, _first_on_or_after(F.make_date(y, F.lit(5), F.lit(25)), "Mon")),
        h("Independence Day", SUNDAY, F.make_date(y, F.lit(7), F.lit(4))),
        h("Labor Day", SUNDAY, _first_on_or_after(F.make_date(y, F.lit(9), F.lit(1)), "Mon")),
        h("Thanksgiving Day", SUNDAY,
          F.date_add(_first_on_or_after(F.make_date(y, F.lit(11), F.lit(1)), "Thu"), 21)),
        h("Christmas Day", SUNDAY, F.make_date(y, F.lit(12), F.lit(25))),
    )


def holiday_calendar(spark: SparkSession, first_year: int = DEFAULT_FIRST_YEAR,
                     last_year: int = DEFAULT_LAST_YEAR, years: DataFrame | None = None) -> DataFrame:
    """DT-6: (holiday_date, holiday, service, year), seven rows per year.

    Years come from the range, or from a one-column DataFrame ``years``
    (e.g. the distinct years of the data). A list for reports; the service type
    of a day needs none of it (``holiday_service``).
    """
    if years is None:
        years = spark.range(1).select(
            F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("year"))
    else:
        years = years.select(F.col(years.columns[0]).cast("int").alias("year")).distinct()
    return (years
            .select("year", F.explode(_holidays_of_year(F.col("year"))).alias("h"))
            .select(F.col("h.holiday_date").alias("holiday_date"), F.col("h.holiday").alias("holiday"),
                    F.col("h.service").alias("service"), "year"))


def holiday_service(day) -> Column:
    """The service a holiday runs ('Saturday', 'Sunday'), null on other days; read off the date itself,
    so it holds for any year."""
    d = as_col(day)
    month, dom, dow = F.month(d), F.dayofmonth(d), F.dayofweek(d)  # 1 = Sunday
    monday, thursday = dow == 2, dow == 5
    mlk = (month == 1) & monday & dom.between(15, 21)
    sunday = (((month == 1) & (dom == 1)) | ((month == 5) & monday & (dom >= 25)) | ((month == 7) & (dom == 4))
              | ((month == 9) & monday & (dom <= 7)) | ((month == 11) & thursday & dom.between(22, 28))
              | ((month == 12) & (dom == 25)))
    return F.when(mlk, F.lit(SATURDAY)).when(sunday, F.lit(SUNDAY))


def service_type_of(day, holiday: Column | None = None) -> Column:
    """CLS-2: Saturday holiday, then Sunday holiday, then Monday-Friday 'Weekday', else the weekday
    name ('Saturday' / 'Sunday'). ``holiday`` overrides the day's own holiday service."""
    d = as_col(day)
    hs = holiday_service(day) if holiday is None else as_col(holiday)
    return (F.when(hs == SATURDAY, F.lit(SATURDAY))
            .when(hs == SUNDAY, F.lit(SUNDAY))
            .when(F.dayofweek(d).between(2, 6), F.lit(WEEKDAY))
            .otherwise(weekday_name(d)))


def with_service_type(df: DataFrame, day_col: str = "service_day", out: str = "service_type") -> DataFrame:
    """CLS-2: add the service type of ``day_col`` (no join, any year)."""
    return df.withColumn(out, service_type_of(day_col))


def date_spine(spark: SparkSession, start, end, name: str = "service_day") -> DataFrame:
    """All dates from ``start`` to ``end`` inclusive, one row each."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(name))


def missing_days(daily: DataFrame, start, end, day_col: str = "service_day") -> DataFrame:
    """DT-9: dates in [start, end] that have no row in ``daily``.

    The spine is one row per calendar day of the range; the daily series is
    reduced to its distinct days before the anti join.
    """
    spine = date_spine(daily.sparkSession, start, end, day_col)
    present = daily.select(day_col).distinct()
    return spine.join(present, on=day_col, how="left_anti")
