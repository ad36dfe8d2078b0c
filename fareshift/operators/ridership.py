"""Ridership rules and reconciliation (FLT-1, JOI-5/6/9/10, DOM-1..3, AGG-1, AGG-3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareshift.functions.classify import is_transfer


def _rule_codes(rules: DataFrame) -> DataFrame:
    return rules.select(F.col("code")).where(F.col("code").isNotNull())


def is_ridership(rules: DataFrame, description_col: str = "description", type_col: str = "type",
                 with_transfers: bool = True):
    """FLT-1 as a Column: the description is one of the rule codes, or (with
    transfers) the Type contains '118'. Never null.

    ``description IN (rule codes)`` is an IN subquery; Spark plans it as an
    existence join, so a code listed twice cannot multiply transactions and
    no distinct is needed.
    """
    flag = F.coalesce(F.col(description_col).isin(_rule_codes(rules)), F.lit(False))
    if with_transfers:
        flag = flag | is_transfer(type_col)
    return flag


def with_ridership_flag(td: DataFrame, rules: DataFrame, out: str = "is_ridership",
                        description_col: str = "description", type_col: str = "type",
                        with_transfers: bool = True) -> DataFrame:
    """Add the FLT-1 flag as a column. Rules with the columns ``year`` and ``month`` (``with_month_key``)
    hold in their month only, by the transaction's own time; a null year or month holds in all."""
    if not {"year", "month"} <= set(rules.columns):
        return td.withColumn(out, is_ridership(rules, description_col, type_col, with_transfers))
    # One row for each code, so no transaction is multiplied.
    periods = (rules.where(F.col("code").isNotNull()).groupBy(F.col("code").alias("_code"))
               .agg(F.collect_set(F.struct(F.col("year"), F.col("month"))).alias("_periods")))
    year, month = F.year("txn_time"), F.date_format("txn_time", "MMM")
    holds = F.exists("_periods", lambda p: (p["year"].isNull() | (p["year"] == year))
                     & (p["month"].isNull() | (p["month"] == month)))
    flag = F.coalesce(holds, F.lit(False))
    if with_transfers:
        flag = flag | is_transfer(type_col)
    return (td.join(periods, F.col(description_col) == F.col("_code"), "left")
            .select(*td.columns, flag.alias(out)))


def ridership_only(td: DataFrame, rules: DataFrame, with_transfers: bool = True, **kw) -> DataFrame:
    """FLT-1: keep the transactions that count as ridership.

    A left semi join on one key, the description or, for a transfer, a mark that is listed beside
    the codes: duplicate codes multiply nothing, and unlike the existence join of an
    ``IN`` under ``OR`` its exchange can be reused by the as-of join.
    """
    if {"year", "month"} <= set(rules.columns):
        return with_ridership_flag(td, rules, "_rides", with_transfers=with_transfers, **kw).where("_rides").drop("_rides")
    return _semi(td, _rule_codes(rules), with_transfers, **kw)


def _semi(td: DataFrame, codes: DataFrame, with_transfers: bool, description_col: str = "description",
          type_col: str = "type") -> DataFrame:
    transfer = is_transfer(type_col) if with_transfers else F.lit(False)
    mark = codes.sparkSession.sql("SELECT * FROM VALUES (true, '') AS v(_transfer, _code)")
    listed = mark.unionAll(codes.select(F.lit(False), F.col("code")))
    key = F.when(transfer, F.lit("")).otherwise(F.col(description_col))
    return td.join(listed, (key == F.col("_code")) & (transfer == F.col("_transfer")), "left_semi")


def unused_transactions(td: DataFrame, rules: DataFrame, method: str = "filter",
                        key: Sequence[str] | None = None) -> DataFrame:
    """DOM-2: transactions that are not ridership.

    ``method="filter"`` negates the ridership predicate in one pass (no
    join). ``method="anti_join"`` (JOI-9 / SET-5) removes the used rows with a
    left anti join that is null-safe on every column (or on ``key``), as the
    reference computes it; it costs a shuffle of both sides and serves as a
    cross-check.
    """
    if method == "filter":
        return td.where(~is_ridership(rules))
    used = ridership_only(td, rules)
    cols = list(key) if key else td.columns
    cond = None
    for c in cols:
        e = td[c].eqNullSafe(used[c])
        cond = e if cond is None else cond & e
    return td.join(used, cond, "left_anti")


def used_unused_counts(td: DataFrame, rules: DataFrame) -> DataFrame:
    """DOM-2 / AGG-3: one row with all, used and unused counts and their check."""
    f = with_ridership_flag(td, rules, "_used")
    return (f.agg(F.count(F.lit(1)).alias("n_all"),
                  F.count(F.when(F.col("_used"), 1)).alias("n_used"),
                  F.count(F.when(~F.col("_used"), 1)).alias("n_unused"))
            .withColumn("counts_agree", F.col("n_used") + F.col("n_unused") == F.col("n_all")))


def unused_by(td: DataFrame, rules: DataFrame, by: str = "description") -> DataFrame:
    """AGG-1: count the unused transactions by description (or type)."""
    return td.where(~is_ridership(rules)).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def count_by(df: DataFrame, *keys: str, out: str = "n") -> DataFrame:
    """AGG-1: row count by group (partial + final hash aggregate)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def reconcile(td: DataFrame, rules: DataFrame, routesum: DataFrame, by: Sequence[str] = ("route",),
              how: str = "inner", digits: int = 3) -> DataFrame:
    """DOM-1: own ridership count per route against the RouteSum control.

    ``ridership_diff = ridership_td - ridership`` and ``percent_disagree``
    rounded half-even to ``digits``. ``how="inner"`` keeps routes in both;
    ``how="left"`` (JOI-6) keeps every route of the transactions, with a null
    control where RouteSum has none. Months are paired by keys when ``by``
    holds them (``reconcile_by_month``), never by list position.
    """
    by = list(by)
    mine = count_by(ridership_only(td, rules), *by, out="ridership_td")
    ctl = routesum.select(*by, "ridership")
    j = mine.join(ctl, on=by, how=how)
    return (j.withColumn("ridership_diff", F.col("ridership_td") - F.col("ridership"))
            .withColumn("percent_disagree",
                        F.bround(F.try_divide(F.col("ridership_diff"), F.col("ridership")) * 100, digits)))


def reconcile_by_month(td: DataFrame, rules: DataFrame, routesum: DataFrame, digits: int = 3,
                       how: str = "inner") -> DataFrame:
    """DOM-1 / SET-1: each month's count per route against the RouteSum of that month.

    ``routesum`` has route, ridership, month ('Dec') and year (``with_month_key``); a report whose
    name holds no year is paired by month alone. Months of one name in different years stay apart.
    ``how="left"`` keeps every route of the transactions, with a null control where RouteSum has none.
    """
    mine = (ridership_only(td, rules)
            .groupBy(F.year("txn_time").alias("year"), F.date_format("txn_time", "MMM").alias("month"), "route")
            .agg(F.count(F.lit(1)).alias("ridership_td")))
    ctl = routesum.groupBy(F.col("year").alias("_year"), F.col("month").alias("_month"), F.col("route").alias("_route")) \
        .agg(F.sum("ridership").alias("ridership"))
    same = ((F.col("month") == F.col("_month")) & (F.col("route") == F.col("_route"))
            & (F.col("_year").isNull() | (F.col("_year") == F.col("year"))))
    j = mine.join(ctl, same, how)
    diff = F.col("ridership_td") - F.col("ridership")
    return j.select("year", "month", "route", "ridership_td", "ridership", diff.alias("ridership_diff"),
                    F.bround(F.try_divide(diff, F.col("ridership")) * 100, digits).alias("percent_disagree"))


def reconcile_transfers(td: DataFrame, rules: DataFrame, routesum: DataFrame,
                        by: Sequence[str] = ("route",)) -> DataFrame:
    """DOM-3: effect of transfers on the difference, in one aggregate pass.

    ``ridership_mine`` counts rule matches only, ``mine_xfer`` adds transfers;
    both are compared with the control (inner join on the route).
    """
    by = list(by)
    f = with_ridership_flag(td, rules, "_rule", with_transfers=False)
    mine = f.groupBy(*by).agg(
        F.count(F.when(F.col("_rule"), 1)).alias("ridership_mine"),
        F.count(F.when(F.col("_rule") | is_transfer("type"), 1)).alias("mine_xfer"),
        F.count(F.when(is_transfer("type"), 1)).alias("transfers"))
    j = mine.join(routesum.select(*by, "ridership"), on=by, how="inner")
    return (j.withColumn("ridership_diff", F.col("ridership_mine") - F.col("ridership"))
            .withColumn("xfer_diff", F.col("mine_xfer") - F.col("ridership"))
            .withColumn("nonzero_xfer_diff", F.col("xfer_diff") != 0))


def sort_route_numeric(df: DataFrame, route_col: str = "route") -> DataFrame:
    """SRT-1: sort text routes by their number (text routes without a number last)."""
    return df.orderBy(*route_order(route_col))


def route_order(route_col: str = "route") -> tuple:
    """SRT-1 as sort columns."""
    return F.col(route_col).try_cast("int").asc_nulls_last(), F.col(route_col).asc()


def largest_differences(reconciled: DataFrame, n: int = 6, diff_col: str = "ridership_diff",
                        route_col: str = "route") -> DataFrame:
    """LIM-1 / SRT-2: the ``n`` routes with the largest difference (a top-k
    report; ties broken by route so the rows are deterministic).

    Spark plans ``orderBy().limit()`` as TakeOrderedAndProject: each task keeps
    its own top ``n`` and only those reach the final merge.
    """
    return reconciled.orderBy(F.col(diff_col).desc_nulls_last(), F.col(route_col)).limit(n)
