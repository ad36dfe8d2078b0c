"""Match quality (QLT-1..4, AGG-4, AGG-8, AGG-9, CLS-4, SET-4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareshift.functions.classify import bad_gps, gps_flag
from fareshift.functions.timefns import time_gap_seconds
from fareshift.operators.summary import with_month

# A transaction more than 90 s after its matched position is in
# a gap (some analyses used 120 s; the threshold is an argument).
DEFAULT_GAP_SECONDS = 90.0


def quality_flags(matched: DataFrame, *, txn_time: str = "txn_time", pos_time: str = "pos_time",
                  last_time: str = "maxtime", gps_col: str = "gps_status",
                  gap_seconds: float = DEFAULT_GAP_SECONDS, null_is_gap: bool = False,
                  clock: bool = False) -> DataFrame:
    """QLT-1..3 as columns of the matched table.

    * ``timediffs``: seconds from the matched position to the transaction
      (elapsed time; ``clock=True`` for the clock-time difference).
    * ``after_last``: the transaction is later than the vehicle-day's last
      position (null last position is false).
    * ``in_gap``: before the last position and more than ``gap_seconds`` after
      the matched one; ``null_is_gap`` also counts a missing difference.
    * ``bad_gps``: GPS status missing or not 2 (an unmatched row has none).
    * ``before_first``: matched to a later position (only with rolled ends).
    """
    diff = time_gap_seconds(txn_time, pos_time, clock=clock)
    t, lt = F.col(txn_time), F.col(last_time)
    gap = F.coalesce((t < lt) & (diff > F.lit(gap_seconds)), F.lit(False))
    if null_is_gap:
        gap = gap | diff.isNull()
    return matched.withColumns({
        "timediffs": diff,
        "after_last": F.coalesce(t > lt, F.lit(False)),
        "in_gap": gap,
        "bad_gps": bad_gps(gps_col),
        "before_first": F.coalesce(F.col(pos_time) > t, F.lit(False)),
    })


def over_whole(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    """Groups of ``by`` with ``aggs`` (one of them called ``n_rows``) and ``n_whole``, the ``n_rows`` of the
    whole table.

    Groups and whole are grouping sets of one aggregate; the whole is one row that the groups meet in
    a broadcast join, so no task gathers all groups. The level is compared with an aggregate's
    value beside it: a filter on the level alone would be pushed below the aggregate, and
    the two readers could not share its exchange.
    """
    by = list(by)
    sets = df.groupingSets([by, []], *by).agg(*aggs, F.grouping_id().alias("_level"))
    sets = sets.withColumn("_any", F.col("n_rows") >= 0).withColumn("_level", F.when(F.col("_any"), F.col("_level")))
    whole = sets.where(F.col("_level") == 2 ** len(by) - 1).select("_any", F.col("n_rows").alias("n_whole"))
    return sets.where(F.col("_level") == 0).join(F.broadcast(whole), "_any").drop("_any", "_level")


def fault_counts() -> list[Column]:
    """QLT-1..4 as additive counts of flagged rows: ``n_rows``, one count per fault, ``n_questionable``
    (rows with any fault)."""
    faults = {"after_last": F.col("after_last"), "in_gap": F.col("in_gap"), "bad_gps": F.col("bad_gps")}
    anyf = faults["after_last"] | faults["in_gap"] | faults["bad_gps"]
    return [F.count(F.lit(1)).alias("n_rows"), *[F.count(F.when(c, 1)).alias(f"n_{k}") for k, c in faults.items()],
            F.count(F.when(anyf, 1)).alias("n_questionable")]


def questionable_shares(counts: DataFrame, whole: str, scale: float = 100.0, own: str | None = None) -> DataFrame:
    """QLT-4 from ``fault_counts``: shares of the column ``whole``, and of ``own`` as ``group_`` columns."""
    faults = F.col("n_after_last") + F.col("n_in_gap") + F.col("n_bad_gps")
    out = {"questionable_pct": F.try_divide(faults, F.col(whole)) * scale,
           "questionable_pct_distinct": F.try_divide(F.col("n_questionable"), F.col(whole)) * scale}
    if own:
        out |= {"group_questionable_pct": F.try_divide(faults, F.col(own)) * scale,
                "group_questionable_pct_distinct": F.try_divide(F.col("n_questionable"), F.col(own)) * scale}
    return counts.withColumns(out).drop("n_questionable", *([whole] if own else []))


#: What ``fault_counts`` gives, to be added up again over days or periods.
COUNTS = ("n_rows", "n_after_last", "n_in_gap", "n_bad_gps", "n_questionable")


def shares_from_counts(counts: DataFrame, by: Sequence[str], scale: float = 100.0) -> DataFrame:
    """``questionable_pct(by=...)`` of the rows behind stored counts."""
    added = over_whole(counts, by, *[F.sum(c).alias(c) for c in COUNTS])
    return questionable_shares(added, "n_whole", scale, own="n_rows")


def bad_gps_from_counts(counts: DataFrame, by: Sequence[str], out: str = "bad_td_gps_pct") -> DataFrame:
    """AGG-4 of the rows behind stored counts: bad-GPS rows of each group over all rows."""
    g = over_whole(counts, by, F.sum("n_rows").alias("n_rows"), F.sum("n_bad_gps").alias("_hit"))
    return g.select(*by, (F.try_divide(F.col("_hit"), F.col("n_whole")) * 100).alias(out))


def questionable_pct(flagged: DataFrame, scale: float = 100.0, by: Sequence[str] = ()) -> DataFrame:
    """QLT-4: share of questionable transactions, in one aggregate over all rows.

    ``questionable_pct`` counts a row once per fault (after the last
    position, in a gap, bad GPS), as the reference's stacked sets do;
    ``questionable_pct_distinct`` counts each row once. With ``by`` (e.g. year and month) there is
    a row per group: its faults over the rows of the whole table, the
    reference's denominator, and beside it over the group's own (``group_`` columns).
    """
    if not by:
        return questionable_shares(flagged.agg(*fault_counts()), "n_rows", scale)
    return questionable_shares(over_whole(flagged, by, *fault_counts()), "n_whole", scale, own="n_rows")


def quality_report(positions: DataFrame, flagged: DataFrame, gps_col: str = "gps_status",
                   digits: int = 3) -> DataFrame:
    """AGG-9: one row: bad-GPS share of positions and of transactions, the
    questionable share, and both row counts (percent, rounded half-even).
    """
    return quality_report_from_counts(positions, flagged.agg(*fault_counts()), gps_col, digits)


def quality_report_from_counts(positions: DataFrame, counts: DataFrame, gps_col: str = "gps_status",
                               digits: int = 3) -> DataFrame:
    """AGG-9 with the transactions as ``fault_counts``, of all rows or by day.

    Both inputs are added up in one pass (no join of one-row frames).
    """
    p = positions.select(F.lit(1).cast("long").alias("_v"), bad_gps(gps_col).cast("long").alias("_bad_v"))
    faults = F.col("n_after_last") + F.col("n_in_gap") + F.col("n_bad_gps")
    t = counts.select(F.col("n_rows").alias("_t"), F.col("n_bad_gps").alias("_bad_t"), faults.alias("_faults"))
    u = p.unionByName(t, allowMissingColumns=True).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_v", "_bad_v", "_t", "_bad_t", "_faults")])
    share = lambda hit, n: F.bround(F.try_divide(F.col(hit), F.col(n)) * 100, digits)
    return u.select(share("_bad_v", "_v").alias("bad_vmh_pct"), F.col("_v").alias("count_vmh"),
                    share("_bad_t", "_t").alias("bad_td_pct"), share("_faults", "_t").alias("questionable_td_pct"),
                    F.col("_t").alias("count_td"))


def pct_of_rows(df: DataFrame, cond, by: Sequence[str] = (), out: str = "pct") -> DataFrame:
    """AGG-4: rows meeting ``cond`` as a percent of ALL rows of ``df``.

    With ``by``, each group's count is divided by the whole-table count (the
    reference's denominator), which comes from the same aggregate (``over_whole``).
    """
    counts = [F.count(F.when(cond, 1)).alias("_hit"), F.count(F.lit(1)).alias("n_rows")]
    if not by:
        return df.agg(*counts).select((F.try_divide(F.col("_hit"), F.col("n_rows")) * 100).alias(out))
    g = over_whole(df, by, *counts)
    return g.select(*by, (F.try_divide(F.col("_hit"), F.col("n_whole")) * 100).alias(out))


def bad_gps_by_month(matched: DataFrame, day_col: str = "service_day", gps_col: str = "gps_status") -> DataFrame:
    """AGG-4 by month: bad-GPS transactions per year and month over all transactions."""
    return pct_of_rows(with_month(matched, day_col), bad_gps(gps_col), by=["year", "month"], out="bad_td_gps_pct")


def bad_gps_by_month_route(matched: DataFrame, day_col: str = "service_day", gps_col: str = "gps_status") -> DataFrame:
    """AGG-4 by month and local route: bad-GPS transactions over all transactions."""
    return pct_of_rows(with_month(matched, day_col), bad_gps(gps_col), by=["year", "month", "local_route"],
                       out="bad_td_gps_pct")


def questionable_by_month(flagged: DataFrame, scale: float = 100.0, day_col: str = "service_day") -> DataFrame:
    """QLT-4 by year and month."""
    return questionable_pct(with_month(flagged, day_col), scale, by=["year", "month"])


def gps_by_trip(positions: DataFrame, by: Sequence[str] = ("service_day", "trip"),
                gps_col: str = "gps_status") -> DataFrame:
    """AGG-8 / CLS-4: per (day, trip) the number of positions whose status is not 0."""
    return positions.groupBy(*by).agg(F.sum(gps_flag(gps_col)).alias("missingcount"))


def gps_profile(positions: DataFrame, gps_col: str = "gps_status") -> DataFrame:
    """AGG-1 by GPS status."""
    return positions.groupBy(gps_col).agg(F.count(F.lit(1)).alias("n"))
