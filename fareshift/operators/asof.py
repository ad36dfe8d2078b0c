"""As-of join (JOI-1..3, JOI-7) as a composition of DataFrame operations.

Spark SQL has no as-of join. This one is built from a union, windows, one aggregate
and one equi join, so that no group is ever larger than one key's
rows inside one time bucket. All windows that look for a match are running
frames (from the partition's start to the current row): the forward direction
sorts the other way round instead of looking ahead, so both are linear.

Plan, for keys ``by`` (e.g. vehicle and service day):

1. Both sides are unioned and hashed once on ``(by, bucket)``, where ``bucket`` is
   the time truncated to ``bucket_unit`` (a minute by default). A window over
   each ``(by, bucket)`` finds the match inside the bucket (last right row at or
   before the left row for ``backward``, first at or after it for ``forward``).
   A hot key (one vehicle-day holding a third of all rows) is thus split over
   up to 1,440 buckets instead of one task.
2. The same exchange is read a second time (Spark plans it as a reused exchange:
   each side is scanned and shuffled once) and aggregated where it lies to one
   row per bucket: its last and first right row, its latest right time, and how
   many left rows it has.
3. A window over those summaries per ``by``, ordered by bucket, gives each
   bucket the carry-in from earlier (or later) buckets, the first right row of
   the key (rolled ends) and the latest right time (``last_time``). A window
   group here has at most one row per bucket of one key: bounded by the
   number of buckets in the key's time span, not by the data volume.
4. Left rows join their bucket's carry-in on ``(by, bucket)``; the left side
   is already hashed on those keys, so only the small summary moves.

Two things keep the exchange shared. Each side's columns travel as one struct,
so no branch prunes columns the other one needs: select the columns you want
before the join, not after it. And keys are never null inside (a filter on nulls
would go to one branch only). An ``IN`` subquery under an ``OR`` in the inputs
makes an existence join, which Spark never reuses: then each side is read twice.

Ties (several right rows at the matched time) take the right row with the
largest ``tie`` value. With ``ties="all"`` a left row whose own time equals the
matched time takes all of them; a match rolled from another time stays one row. The
right rows of one key and time that a left row meets are one array meanwhile: as many
elements as that left row gives rows, so the array is as large as the answer for it.
Left rows with a null key or time get no match and keep their row.

``stored=n`` says that ``right`` reads a table which ``sources.sinks.write_bucketed`` wrote
with ``n`` buckets of ``(by, bucket)``: the right side is then not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

_NULL_TIE = -(2 ** 62)
#: Left rows without a key or time lie in buckets from here on, below any real one.
_NO_BUCKET, _SPREAD = -(2 ** 62), 1024
_RESERVED = {"_b", "_t", "_k", "_l", "_r"}

_UNITS = {"second": "SECOND", "minute": "MINUTE", "hour": "HOUR", "day": "DAY"}


def time_bucket(t: Column, unit: str) -> Column:
    """Whole ``unit``s since 1970-01-01 on the wall clock (pure TIMESTAMP_NTZ
    arithmetic, so the session time zone never moves a bucket)."""
    if unit not in _UNITS:
        raise ValueError(f"bucket_unit must be one of {sorted(_UNITS)}")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff(_UNITS[unit], epoch, t)


def _interval_seconds(seconds: float) -> Column:
    return F.make_dt_interval(secs=F.lit(float(seconds)).cast("decimal(18,6)"))


def _never_null(name: str, kind: DataType) -> Column:
    """A key column with a stand-in for null, where the type has one. Such rows are kept apart by their bucket."""
    if isinstance(kind, StringType):
        stand_in = F.lit("")
    elif isinstance(kind, NumericType):
        stand_in = F.lit(0).cast(kind)
    elif isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        stand_in = F.lit("1970-01-01").cast(kind)
    elif isinstance(kind, BooleanType):
        stand_in = F.lit(False)
    else:
        return F.col(name)
    return F.coalesce(F.col(name), stand_in)


class _Match:
    """Steps 1 to 4 for the wanted directions; ``result`` has the left rows as ``_l`` and their matches."""

    def __init__(self, left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str, right_time: str,
                 right_cols: Sequence[str], tie: str | None, bucket_unit: str, backward: bool, forward: bool,
                 first: bool = False, latest: bool = False, all_ties: bool = False, stored: int | None = None):
        by = list(by)
        if clash := _RESERVED & set(by):
            raise ValueError(f"key columns use reserved names: {sorted(clash)}")
        self.left_cols = left.columns
        self.right_time = right_time
        self.carried = [right_time] + [c for c in right_cols if c != right_time and c not in by]
        present = F.lit(True)
        for k in by:
            present = present & F.col(k).isNotNull()

        # a null tie ranks below every real tie value, in the windows and in the
        # summaries alike (negation of the floor cannot overflow)
        rank = F.coalesce(F.col(tie).cast("long"), F.lit(_NULL_TIE)) if tie else F.lit(0).cast("long")
        lkind, rkind = ({f.name: f.dataType for f in df.schema.fields} for df in (left, right))
        rights = right.where(present & F.col(right_time).isNotNull())
        bucket = time_bucket(F.col(right_time), bucket_unit)
        if stored:
            keys = [F.col(k) for k in by]
            bucket = F.col(bucket_column(right_time))
        else:
            keys, bucket = [_never_null(k, rkind[k]).alias(k) for k in by], F.coalesce(bucket, F.lit(0))
        rights = rights.select(*keys, bucket.alias("_b"), F.col(right_time).alias("_t"), rank.alias("_k"),
                               F.struct(*self.carried).alias("_r"))
        apart = _NO_BUCKET + F.pmod(F.xxhash64(*left.columns), F.lit(_SPREAD))
        lefts = left.select(
            *[_never_null(k, lkind[k]).alias(k) for k in by],
            F.when(present & F.col(left_time).isNotNull(), F.coalesce(time_bucket(F.col(left_time), bucket_unit), F.lit(0)))
            .otherwise(apart).alias("_b"),
            F.col(left_time).alias("_t"), F.lit(0).cast("long").alias("_k"), F.struct(*left.columns).alias("_l"))
        if stored:
            lefts = lefts.repartition(stored, *by, "_b")
        u = lefts.unionByName(rights, allowMissingColumns=True)
        if not stored:
            u = u.repartition(*by, "_b")

        # 1. match inside (by, bucket): a running last. Rights sort before lefts at
        #    equal times, ties ascending so the last is the largest; forward runs
        #    from the latest time to the earliest.
        m = u
        inside = Window.partitionBy(*by, "_b")
        for name, wanted, order in (("_mb", backward, F.col("_t").asc()), ("_mf", forward, F.col("_t").desc())):
            if wanted:
                w = inside.orderBy(order, F.col("_l").isNotNull(), "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
                m = m.withColumn(name, F.last("_r", ignorenulls=True).over(w))
        if all_ties:
            at = Window.partitionBy(*by, "_b", "_t")
            m = m.withColumn("_met", F.max(F.col("_l").isNotNull()).over(at))
            m = m.withColumn("_all", F.collect_list(F.when(F.col("_met"), F.col("_r"))).over(at))
        m = m.where(F.col("_l").isNotNull())

        # 2. one row a bucket, from the same exchange (a left row's order is null, so it is never taken).
        is_right = F.col("_r").isNotNull()
        first = first or forward
        summary = [F.count("_l").alias("_n")]
        if backward:
            summary.append(F.max_by("_r", F.when(is_right, F.struct("_t", "_k"))).alias("_last"))
        if first:
            summary.append(F.min_by("_r", F.when(is_right, F.struct(F.col("_t"), -F.col("_k")))).alias("_first"))
        if latest:
            summary.append(F.max(F.when(is_right, F.col("_t"))).alias("_latest"))
        s = u.groupBy(*by, "_b").agg(*summary)

        # 3. carry-in per bucket from the other buckets of the same key.
        up, down = Window.partitionBy(*by).orderBy("_b"), Window.partitionBy(*by).orderBy(F.col("_b").desc())
        whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        carry = []
        if backward:
            carry.append(F.last("_last", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("_cb"))
        if forward:
            carry.append(F.last("_first", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("_cf"))
        if first:
            carry.append(F.first("_first", ignorenulls=True).over(whole).alias("_key_first"))
        if latest:
            carry.append(F.max("_latest").over(whole).alias("_key_latest"))
        s = s.select(*by, "_b", "_n", *carry).where("_n > 0").drop("_n")

        # 4. left rows meet their bucket's carry-in.
        self.result = m.join(s, [*by, "_b"], "left")
        self.known = F.col("_b") >= _NO_BUCKET + _SPREAD

    def match(self, direction: str, tolerance: float | None = None, roll_ends: bool = False) -> Column:
        near, carry = ("_mb", "_cb") if direction == "backward" else ("_mf", "_cf")
        found = F.coalesce(near, carry, "_key_first") if roll_ends else F.coalesce(near, carry)
        ok = self.known
        if tolerance is not None:
            t, span = found[self.right_time], _interval_seconds(tolerance)
            ok = ok & (t >= F.col("_t") - span if direction == "backward" else t <= F.col("_t") + span)
        return F.when(ok, found)

    def own(self) -> list[Column]:
        """The left columns. The condition always holds; it keeps the struct whole below the exchange."""
        row = F.when(F.col("_r").isNull(), F.col("_l"))
        return [row[c].alias(c) for c in self.left_cols]


def bucket_column(time_col: str) -> str:
    """The column that a bucketed table (``sources.sinks.write_bucketed``) has for a time's bucket."""
    return f"{time_col}_bucket"


def _check_names(left: DataFrame, names: Sequence[str]) -> None:
    if clash := set(names) & set(left.columns):
        raise ValueError(f"right columns clash with left columns: {sorted(clash)}")


def asof_join(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str,
              right_time: str, right_cols: Sequence[str] = (), tie: str | None = None,
              direction: str = "backward", tolerance: float | None = None, how: str = "left",
              roll_ends: bool = False, ties: str = "last", last_time: str | None = None,
              bucket_unit: str = "minute", stored: int | None = None) -> DataFrame:
    """Match each left row to the nearest right row with the same ``by`` keys.

    Parameters
    ----------
    by : key columns present on both sides (e.g. ``["vehicle_id", "service_day"]``).
    left_time, right_time : the ordering timestamps.
    right_cols : right columns to carry (``right_time`` is always carried).
        Names must not clash with left columns.
    tie : numeric right column that orders rows sharing one time.
    direction : ``"backward"`` (last right row at or before the left time) or
        ``"forward"`` (first right row at or after it).
    tolerance : seconds; a match farther away counts as no match (exact,
        microsecond comparison).
    how : ``"left"`` keeps unmatched left rows with nulls, ``"inner"`` drops them.
    roll_ends : backward only; a left row before the key's first right row
        takes that first row (both ends rolled).
    ties : ``"last"`` (one row per left row) or ``"all"`` (every right row at
        exactly the left time; one row where the match is rolled).
    last_time : when given, also output the key's latest right time under this name.
    bucket_unit : time bucket for splitting keys ("second", "minute", "hour", "day").
    stored : buckets of the table that ``right`` reads, if ``write_bucketed`` wrote it for
        these keys, this time and this unit.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be 'backward' or 'forward'")
    if roll_ends and direction != "backward":
        raise ValueError("roll_ends applies to the backward direction")
    if ties not in ("last", "all"):
        raise ValueError("ties must be 'last' or 'all'")
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    found = _Match(left, right, by=by, left_time=left_time, right_time=right_time, right_cols=right_cols, tie=tie,
                   bucket_unit=bucket_unit, backward=direction == "backward", forward=direction == "forward",
                   first=roll_ends, latest=last_time is not None, all_ties=ties == "all", stored=stored)
    _check_names(left, [*found.carried, *([last_time] if last_time else [])])
    match = found.match(direction, tolerance, roll_ends)
    res = found.result
    if how == "inner":
        res = res.where(match.isNotNull())
    extra = [F.when(found.known, F.col("_key_latest")).alias(last_time)] if last_time else []
    if ties == "all":
        several = F.when(match[right_time] == F.col("_t"), F.col("_all")).otherwise(F.array(match))
        res = res.select("*", F.explode(several).alias("_match"))
        match = F.col("_match")
    return res.select(*found.own(), *[match[c].alias(c) for c in found.carried], *extra)


def asof_both(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_time: str, right_time: str,
              right_cols: Sequence[str] = (), tie: str | None = None, before: float | None = None,
              after: float | None = None, bucket_unit: str = "minute", stored: int | None = None) -> DataFrame:
    """Each left row with both its backward match (``prev_`` columns) and its forward match (``next_``).

    One exchange and one carry-in join serve both directions; the second one costs a sort
    inside the buckets. ``before`` and ``after`` are their tolerances in seconds.
    """
    found = _Match(left, right, by=by, left_time=left_time, right_time=right_time, right_cols=right_cols, tie=tie,
                   bucket_unit=bucket_unit, backward=True, forward=True, stored=stored)
    names = [f"{side}_{c}" for side in ("prev", "next") for c in found.carried]
    _check_names(left, names)
    prev, following = found.match("backward", before), found.match("forward", after)
    return found.result.select(*found.own(), *[m[c].alias(f"{side}_{c}") for side, m in (("prev", prev), ("next", following))
                                               for c in found.carried])


def last_position(positions: DataFrame, by: Sequence[str] = ("vehicle_id", "service_day"),
                  time_col: str = "pos_time", out: str = "maxtime") -> DataFrame:
    """AGG-2: latest position time per key (partial + final hash aggregate)."""
    return positions.groupBy(*by).agg(F.max(time_col).alias(out))


def with_last_position(df: DataFrame, positions: DataFrame,
                       by: Sequence[str] = ("vehicle_id", "service_day"),
                       time_col: str = "pos_time", out: str = "maxtime") -> DataFrame:
    """JOI-7: attach the key's latest position time with a left join.

    ``asof_join(..., last_time=...)`` gives the same column without a join;
    this form serves callers that matched elsewhere.
    """
    return df.join(last_position(positions, by, time_col, out), on=list(by), how="left")
