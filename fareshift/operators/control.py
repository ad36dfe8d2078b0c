"""Control totals: comparison, proportional scale-up, combination (DOM-7..9, RSH-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareshift.functions.calendar import SATURDAY, SUNDAY, WEEKDAY


def compare_daily(daily: DataFrame, totals: DataFrame, day_col: str = "service_day",
                  count_col: str = "n", digits: int = 3) -> DataFrame:
    """DOM-7: own daily count against the control series, by day (full outer).

    ``diff = n - ridership`` and ``pct_diff`` rounded half-even; a day missing
    on one side keeps its row with nulls.
    """
    j = daily.select(day_col, count_col).join(totals.select(day_col, "ridership"), on=day_col, how="full")
    return (j.withColumn("diff", F.col(count_col) - F.col("ridership"))
            .withColumn("pct_diff", F.bround(F.try_divide(F.col("diff"), F.col("ridership")) * 100, digits)))


def compare_daily_overall(compared: DataFrame) -> DataFrame:
    """DOM-7 overall: sum of differences over sum of control (days on both sides)."""
    both = compared.where(F.col("diff").isNotNull())
    return both.agg(F.sum("diff").alias("sum_diff"), F.sum("ridership").alias("sum_ridership"),
                    F.try_divide(F.sum("diff"), F.sum("ridership")).alias("overall_ratio"))


def scale_to_control(local_daily: DataFrame, totals: DataFrame, day_col: str = "service_day",
                     north_col: str = "ridership_901", south_col: str = "ridership_902") -> DataFrame:
    """DOM-8: scale the matched 901/902 counts up to the day's control total.

    Where the matched sum ``r1 + r2`` is below the control, each route gets
    ``int(r_k / (r1 + r2) * (control - (r1 + r2)) + r_k)`` (truncated toward
    zero); otherwise it keeps ``r_k``. Missing counts are 0; a day with
    ``r1 + r2 = 0`` cannot be split and stays 0. Days are matched by key, and
    days of either side stay: without a control total the counts are kept, without
    matched counts the control is listed beside zeros.
    """
    r1 = F.coalesce(F.col(north_col), F.lit(0)).cast("long")
    r2 = F.coalesce(F.col(south_col), F.lit(0)).cast("long")
    j = (local_daily.select(day_col, r1.alias(north_col), r2.alias(south_col))
         .join(totals.select(day_col, "ridership"), on=day_col, how="full")
         .select(day_col, r1.alias(north_col), r2.alias(south_col), "ridership"))
    rj = F.col(north_col) + F.col(south_col)
    gap = F.col("ridership") - rj
    rj_nz = F.when(rj != 0, rj)

    def scaled(rk):
        return F.coalesce((F.col(rk) / rj_nz * gap + F.col(rk)).cast("long"), F.col(rk))

    scale = F.coalesce(rj < F.col("ridership"), F.lit(False))
    return j.select(day_col, north_col, south_col, rj.alias("ridershiprj"), "ridership",
                    F.when(scale, scaled(north_col)).otherwise(F.col(north_col)).alias("final_901"),
                    F.when(scale, scaled(south_col)).otherwise(F.col(south_col)).alias("final_902"))


def scaled_by_service_type(scaled_typed: DataFrame) -> DataFrame:
    """DOM-8 -> RSH-3: per service type, the scaled totals, unpivoted to
    (service_type, local_route, ridership).
    """
    wide = scaled_typed.groupBy("service_type").agg(F.sum("final_901").alias("901"),
                                                   F.sum("final_902").alias("902"))
    return wide.unpivot("service_type", ["901", "902"], "local_route", "ridership")


def combine_periods(scaled_typed: DataFrame, cut, day_col: str = "service_day") -> DataFrame:
    """DOM-9 over one daily table: scaled counts before ``cut``, matched counts from it on, summed
    per (local_route, service_type). One pass, so the match behind the table runs once."""
    before = F.col(day_col) < F.lit(cut).cast("date")
    s = scaled_typed.withColumns({f"final_{k}": F.when(before, F.col(f"final_{k}")).otherwise(F.col(f"ridership_{k}"))
                                  for k in ("901", "902")})
    return scaled_by_service_type(s).select("local_route", "service_type", F.col("ridership").cast("long").alias("ridership"))


def combine_totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """DOM-9: add two periods' (local_route, service_type) totals."""
    u = a.select("local_route", "service_type", F.col("ridership").cast("long").alias("ridership")) \
        .unionByName(b.select("local_route", "service_type", F.col("ridership").cast("long").alias("ridership")))
    return u.groupBy("local_route", "service_type").agg(F.sum("ridership").alias("ridership"))


def combine_totals_wide(combined: DataFrame) -> DataFrame:
    """DOM-9 wide: one row per local route, columns Weekday, Saturday, Sunday."""
    types = [WEEKDAY, SATURDAY, SUNDAY]
    p = combined.groupBy("local_route").pivot("service_type", types).agg(F.sum("ridership"))
    return p.select("local_route", *types)
