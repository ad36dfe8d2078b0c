"""Stand-in inputs built from the supplied test tables.

The agency's own inputs (farebox reports, vehicle message history) are not
available, so the test tables play their roles. These builders only rename
and map columns into the schemas the jobs expect; they do none of the jobs'
work (no service day, no filtering by the rules, no matching). Every
job runs on whatever rows of that schema it is given.

Roles (same text as the DuckDB oracle's CTEs in ``__spark_entry__``):

* ``td``: fare transactions = ``events`` of type purchase / signup (signup is a
  transfer, Type '118 TRANSFER').
* ``positions``: vehicle positions = ``events`` of type view / click / error;
  latitude is ``value``.
* ``rules``: the ridership rule list (a fare code for each pass type).
* ``routesum``: control totals per route, less every fiftieth transaction (route '25'
  absent, for the outer join).
* ``daily_totals``: control totals per service day = all transactions that day, but 1
  on every fifth date.
* ``vmh`` / ``avl``: message history and position history, joined on
  ``avl_history_id`` by the positions reader.
* ``td2`` / ``positions2``: orders and shipped lines, a tie-heavy pair keyed by
  customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareshift.functions.timefns import service_day

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _route_of(event_id):
    return (F.when(event_id % 5 == 0, "90").when(event_id % 5 == 1, "901")
            .when(event_id % 5 == 2, "902").when(event_id % 5 == 3, "8").otherwise("25"))


def td(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions: txn_id, type, txn_time, vehicle_id, route, description."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup"))
    return e.select(
        F.col("event_id").alias("txn_id"),
        F.when(F.col("event_type") == "signup", F.lit("118 TRANSFER")).otherwise(F.lit("100 FARE")).alias("type"),
        F.col("ts").alias("txn_time"),
        F.col("user_id").cast("string").alias("vehicle_id"),
        _route_of(F.col("event_id")).alias("route"),
        F.concat(F.col("event_type"), F.lit("-"), (F.col("event_id") % 6).cast("string")).alias("description"),
    )


def rules(spark: SparkSession) -> DataFrame:
    """Ridership rules: code, description, one code for each pass type ('purchase-2' and 'purchase-5'
    are deliberately absent).

    An in-plan VALUES list, so the optimizer knows its exact size.
    """
    return spark.sql("SELECT * FROM VALUES ('purchase-0', 'Single Ride Full Fare'), ('purchase-1', '31 FULL'), "
                     "('purchase-3', '10 TRIP FULL'), ('purchase-4', 'Free') AS r(code, description)")


def _props_number(props):
    return F.regexp_extract(props, "[0-9]+", 0).cast("int")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions: avl_history_id, pos_time, vehicle_id, latitude, gps_status, trip."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "error"))
    k = _props_number(F.col("props"))
    return e.select(
        F.col("event_id").alias("avl_history_id"),
        F.col("ts").alias("pos_time"),
        F.col("user_id").cast("string").alias("vehicle_id"),
        F.col("value").alias("latitude"),
        F.when(k % 10 == 0, F.lit(None).cast("int")).when(k % 10 == 1, F.lit(0)).otherwise(F.lit(2)).alias("gps_status"),
        k.alias("trip"),
    )


def routesum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control totals per route: the transactions the farebox counted (it misses every fiftieth), by route;
    route '25' is absent."""
    t = td(spark, sf_dir).where((F.col("route") != "25") & (F.col("txn_id") % 50 != 0))
    return t.groupBy("route").agg(F.count(F.lit(1)).alias("ridership"))


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control totals per service day: all transactions of the day; 1 on every fifth date, below what is matched."""
    g = td(spark, sf_dir).groupBy(service_day("txn_time").alias("service_day")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("service_day", F.when(F.day("service_day") % 5 == 0, F.lit(1).cast("long")).otherwise(F.col("n"))
                    .alias("ridership"))


def vmh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message history: avl_history_id, time, vehicle_id (number) and the message columns; every
    seventh message was sent twice."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "error"))
    m = e.select(
        F.col("event_id").alias("avl_history_id"),
        F.col("ts").alias("time"),
        _route_of(F.col("event_id")).alias("route"),
        F.col("user_id").alias("vehicle_id"),
        _props_number(F.col("props")).alias("trip"),
        (F.col("event_id") % 40).alias("stop_id"),
        F.when(F.col("event_id") % 2 == 0, "I").otherwise("O").alias("inbound_outbound"),
        (F.col("event_id") % 4).cast("int").alias("boards"),
        (F.col("event_id") % 3).cast("int").alias("alights"),
    )
    return m.unionAll(m.where(F.col("avl_history_id") % 7 == 0))


def avl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position history: avl_history_id, time, latitude, longitude, gps_status (views and clicks only);
    every 97th entry is dated two days after its message."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    k = _props_number(F.col("props"))
    return e.select(
        F.col("event_id").alias("avl_history_id"),
        (F.col("ts") + F.make_dt_interval(days=F.when(F.col("event_id") % 97 == 0, 2).otherwise(0))).alias("time"),
        F.col("value").alias("latitude"),
        (-F.col("value")).alias("longitude"),
        F.when(k % 10 == 0, F.lit(None).cast("int")).when(k % 10 == 1, F.lit(0)).otherwise(F.lit(2)).alias("gps_status"),
    )


def td2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions: txn_id, txn_time, vehicle_id (customer)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("txn_id"), F.col("o_orderdate").alias("txn_time"),
                    F.col("o_custkey").alias("vehicle_id"))


def positions2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped lines as positions: vehicle_id, pos_time, avl_history_id, latitude.

    (l_orderkey, l_linenumber) is not unique in the supplied lineitem, so rows
    are reduced to one per (customer, ship date, line id).
    """
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return (j.groupBy(F.col("o_custkey").alias("vehicle_id"), F.col("l_shipdate").alias("pos_time"),
                      (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("avl_history_id"))
            .agg(F.max("l_quantity").alias("latitude")))


# ------------------------------------------------------------------ report text
# The readers parse farebox report text. These builders print the role
# tables as report lines (one "file" per month), so the readers run on text
# whose volume grows with the tables. They only format rows; the parsing,
# slicing and typing are the readers' work.

TD_HEADER = ("Type,Date and Time,Bus,Route,Run,Driver,Description,Value,Amount,Direction,Fareset,Stop,Trip,"
             "Longitude,Latitude")


def _month_file(prefix: str, day, suffix: str):
    d = F.to_date(day)
    return F.concat(F.lit(prefix), F.date_format(d, "MMMM"), F.lit(" "), F.year(d).cast("string"), F.lit(suffix))


def _report_time_text(t):
    """'M/d/yyyy H:mm:ss' from the wall-clock fields (no session-zone cast)."""
    return F.format_string("%d/%d/%d %d:%02d:%02d", F.month(t), F.dayofmonth(t), F.year(t),
                           F.hour(t), F.minute(t), F.second(t))


def td_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction detail report text: (file, line), no line numbers."""
    t = td(spark, sf_dir).withColumn(
        "file", F.upper(_month_file("TRANSACTION DETAIL ", F.col("txn_time"), ".csv")))
    body = t.select("file", F.concat_ws(
        ",", "type", _report_time_text(F.col("txn_time")), "vehicle_id", "route", F.lit("1"), F.lit("0"),
        "description", F.lit("1.75"), F.lit("1.75"), F.lit(""), F.lit("1"), F.lit(""), F.lit(""), F.lit(""),
        F.lit("")).alias("line"))
    files = t.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    frame = files.select("file", F.explode(F.array(
        F.lit("Transaction Detail Report"), F.concat(F.lit("Printed for "), F.col("file")), F.lit(TD_HEADER),
        F.concat(F.lit("Number of Transactions: "), F.col("n").cast("string")))).alias("line"))
    return body.unionByName(frame)


def rules_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules report text per month: every fare code seen that month, described."""
    t = td(spark, sf_dir).select(_month_file("MONTHLY SUMMARY ", F.col("txn_time"), ".txt").alias("file"),
                                 F.col("description").alias("code")).distinct()
    from pyspark.sql import Window
    w = Window.partitionBy("file").orderBy("code")
    rows = t.select("file", (F.row_number().over(w) + 1).alias("line_no"),
                    F.concat(F.lit('"'), F.col("code"), F.lit('","Fare '), F.col("code"), F.lit(', full",""'))
                    .alias("line"))
    files = t.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("n"))
    frame = files.select("file", F.inline(F.array(
        F.struct(F.lit(0).alias("line_no"), F.lit("Monthly Summary").alias("line")),
        F.struct(F.lit(1).alias("line_no"), F.lit("Ridership is defined as the following:").alias("line")),
        F.struct((F.col("n") + 2).alias("line_no"), F.lit("All other fares are excluded.").alias("line")))))
    return rows.unionByName(frame)


def routesum_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route summary text per month: transactions per route, then TOTAL."""
    t = td(spark, sf_dir).withColumn("file", _month_file("EVENT SUMMARY (", F.col("txn_time"), ").txt"))
    g = t.groupBy("file", "route").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    w = Window.partitionBy("file").orderBy("route")
    rows = g.select("file", (F.row_number().over(w) + 2).alias("line_no"),
                    F.concat_ws(",", "route", F.col("n").cast("string"), F.lit("0"), F.lit("0"), F.lit("0"),
                                F.lit("")).alias("line"))
    tot = g.groupBy("file").agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("int").alias("rows"))
    frame = tot.select("file", F.inline(F.array(
        F.struct(F.lit(0).alias("line_no"), F.lit("Event Summary").alias("line")),
        F.struct(F.lit(1).alias("line_no"), F.lit("Ridership By Route").alias("line")),
        F.struct(F.lit(2).alias("line_no"),
                 F.lit("Route,Ridership,Token Count,Ticket Count,Preset Preset1,X").alias("line")),
        F.struct((F.col("rows") + 3).alias("line_no"),
                 F.concat(F.lit("TOTAL,"), F.col("n").cast("string"), F.lit(",0,0,0,")).alias("line")))))
    return rows.unionByName(frame)


def daily_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals text per month ("Local Route" report): one row per service day."""
    d = daily_totals(spark, sf_dir).withColumn("file", _month_file("Local Route 90 ", F.col("service_day"), ".txt"))
    from pyspark.sql import Window
    w = Window.partitionBy("file").orderBy("service_day")
    rows = d.select("file", (F.row_number().over(w) + 2).alias("line_no"),
                    F.concat_ws(",", F.date_format("service_day", "M/d/yyyy"), F.col("ridership").cast("string"))
                    .alias("line"))
    tot = d.groupBy("file").agg(F.sum("ridership").alias("n"), F.count(F.lit(1)).cast("int").alias("rows"))
    frame = tot.select("file", F.inline(F.array(
        F.struct(F.lit(1).alias("line_no"), F.lit("Ridership By Route").alias("line")),
        F.struct(F.lit(2).alias("line_no"), F.lit("Date,Ridership").alias("line")),
        F.struct((F.col("rows") + 3).alias("line_no"), F.lit("Weekday Average,0").alias("line")),
        F.struct((F.col("rows") + 4).alias("line_no"), F.concat(F.lit("TOTAL,"), F.col("n").cast("string")).alias("line")))))
    return rows.unionByName(frame)


def report_folder(spark: SparkSession, sf_dir: str) -> str:
    """All four report kinds as files in a new folder (below the shared checkpoint folder)."""
    import uuid

    from fareshift.session import ensure_checkpoint_dir
    from fareshift.sources.sinks import write_report_files

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fareshift/reports-{uuid.uuid4().hex}"
    line = F.col("line")
    # title, date printed and header first, footer last, as in a printed report
    order = (F.when(line.startswith("Transaction Detail"), 0).when(line.startswith("Printed for"), 1).when(line == TD_HEADER, 2)
             .when(line.startswith("Number of Transactions"), 4).otherwise(3))
    detail = td_report_lines(spark, sf_dir).select("file", order.alias("line_no"), "line")
    kinds = [rules_report_lines(spark, sf_dir), routesum_report_lines(spark, sf_dir), daily_report_lines(spark, sf_dir)]
    for k in kinds:
        detail = detail.unionByName(k.select("file", "line_no", "line"))
    write_report_files(detail, path)
    return path
