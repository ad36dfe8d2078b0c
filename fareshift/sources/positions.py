"""Vehicle positions: message history joined to position history (SRC-9, SRC-10, JOI-4, SET-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareshift.functions.timefns import SERVICE_DAY_START_HOUR

# The corridor's routes start with 9; its fleet is 1970-1999.
ROUTE_LIKE = "9%"
FLEET_RANGE = (1970, 1999)
MESSAGE_COLUMNS = ("route", "stop_name", "stop_id", "inbound_outbound", "trip", "boards", "alights", "departure_time")
HISTORY_COLUMNS = ("latitude", "longitude", "gps_status")


def jdbc_table(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None,
               lower_bound=None, upper_bound=None, num_partitions: int | None = None,
               properties: dict | None = None) -> DataFrame:
    """SRC-10: a database table as a lazy DataFrame.

    With a partition column and bounds, Spark reads it in ``num_partitions``
    parallel range queries; filters written later on the DataFrame are pushed
    into each query's WHERE clause.
    """
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", str(lower_bound))
             .option("upperBound", str(upper_bound)).option("numPartitions", str(num_partitions or 1)))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load()


def read_positions(vmh: DataFrame, avl: DataFrame, start=None, end=None, *, route_like: str | None = ROUTE_LIKE,
                   vehicle_range: tuple[int, int] | None = FLEET_RANGE, by_service_day: bool = True,
                   start_hour: int = SERVICE_DAY_START_HOUR, distinct: bool = True) -> DataFrame:
    """SRC-9 / SRC-10: positions of the corridor for a period.

    Message history (``vmh``: avl_history_id, time, vehicle_id and what it has of
    ``MESSAGE_COLUMNS``) left-joins position history (``avl``: avl_history_id, time and what it
    has of ``HISTORY_COLUMNS``) on ``avl_history_id`` (JOI-4), which stays in the output: it orders
    positions of one time. A message is kept when its
    route is LIKE ``route_like`` or its vehicle is in ``vehicle_range``: one
    scan with an OR instead of two scans and a UNION; ``distinct`` keeps the
    UNION's duplicate removal over all columns (SET-3). The period is [start, end] in service
    days: from ``start`` 03:00 to the day after ``end`` 03:00
    (``by_service_day=False`` bounds at midnight instead, as one analysis did); a bound that is
    None is open. The position history is not bounded by time, so a position is found however far
    its time lies from the message's. With a bound it is read between the smallest and the largest id of the kept messages
    (ids grow with time, so that prunes files and row groups), and on large tables Spark's own runtime Bloom filter
    of the messages' ids (``spark.sql.optimizer.runtime.bloomFilter``) drops the rest before the join.
    Filters are written on the source columns, so a parquet or JDBC source
    receives them.
    """
    for side, df, needed in (("message", vmh, {"avl_history_id", "time", "vehicle_id"}), ("position", avl, {"avl_history_id"})):
        if missing := needed - set(df.columns):
            raise ValueError(f"{side} history lacks {sorted(missing)}")
    v, a = vmh, avl
    shift = F.make_dt_interval(hours=F.lit(start_hour if by_service_day else 0))
    if start is not None:
        v = v.where(F.col("time") >= F.lit(start).cast("date").cast("timestamp_ntz") + shift)
    if end is not None:
        v = v.where(F.col("time") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz") + shift)
    keep = F.lit(False)
    if route_like:
        keep = keep | F.coalesce(F.col("route").like(route_like), F.lit(False))
    if vehicle_range:
        keep = keep | F.coalesce(F.col("vehicle_id").between(*vehicle_range), F.lit(False))
    v = v.where(keep)
    if start is not None or end is not None:
        ids = [v.select(f("avl_history_id")).scalar() for f in (F.min, F.max)]
        a = a.where(F.col("avl_history_id").between(*ids))
    messages = [c for c in MESSAGE_COLUMNS if c in v.columns]
    history = [c for c in HISTORY_COLUMNS if c in a.columns]
    j = v.join(a.select("avl_history_id", *history), "avl_history_id", "left")
    out = j.select("avl_history_id", F.col("time").alias("pos_time"), F.col("vehicle_id").cast("string").alias("vehicle_id"),
                   *messages, *history)
    return out.distinct() if distinct else out
