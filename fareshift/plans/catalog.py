"""Registered queries (one per operator group of the inventory) and their oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the supplied tables.
Each oracle is DuckDB SQL over the same tables, written independently of the
Spark code: role CTEs (the same column mapping as ``roles``), then the job
in DuckDB's own terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareshift.plans import roles

QUERIES: dict = {}
ORACLES: dict = {}

# Parameters of the test runs (the supplied latitudes are 0-500, so the
# corridor is 20-60 instead of the agency's 39.709468-39.877512).
NORTH = 60.0
SOUTH = 20.0
GEO = {"north": NORTH, "south": SOUTH}

# ---------------------------------------------------------------- oracle text

ROLE_CTES = """
td AS (
  SELECT event_id AS txn_id,
         CASE WHEN event_type = 'signup' THEN '118 TRANSFER' ELSE '100 FARE' END AS type,
         ts AS txn_time, CAST(user_id AS VARCHAR) AS vehicle_id,
         CASE event_id % 5 WHEN 0 THEN '90' WHEN 1 THEN '901' WHEN 2 THEN '902' WHEN 3 THEN '8' ELSE '25' END AS route,
         event_type || '-' || CAST(event_id % 6 AS VARCHAR) AS description
  FROM events WHERE event_type IN ('purchase', 'signup')),
rules AS (
  SELECT * FROM (VALUES ('purchase-0', 'Single Ride Full Fare'), ('purchase-1', '31 FULL'), ('purchase-3', '10 TRIP FULL'),
                        ('purchase-4', 'Free')) AS r(code, description)),
positions AS (
  SELECT event_id AS avl_history_id, ts AS pos_time, CAST(user_id AS VARCHAR) AS vehicle_id, value AS latitude,
         CASE CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) % 10 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 2 END AS gps_status,
         CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS trip
  FROM events WHERE event_type IN ('view', 'click', 'error')),
routesum AS (SELECT route, COUNT(*) AS ridership FROM td WHERE route <> '25' AND txn_id % 50 <> 0 GROUP BY route),
daily_totals AS (
  SELECT service_day, CASE WHEN day(service_day) % 5 = 0 THEN 1 ELSE n END AS ridership
  FROM (SELECT CAST(txn_time - INTERVAL 3 HOUR AS DATE) AS service_day, COUNT(*) AS n FROM td GROUP BY 1)),
used AS (SELECT * FROM td WHERE description IN (SELECT code FROM rules) OR type LIKE '%118%'),
used_d AS (SELECT *, CAST(txn_time - INTERVAL 3 HOUR AS DATE) AS service_day FROM used),
pos_d AS (SELECT *, CAST(pos_time - INTERVAL 3 HOUR AS DATE) AS service_day FROM positions),
maxt AS (SELECT vehicle_id, service_day, MAX(pos_time) AS maxtime FROM pos_d GROUP BY 1, 2),
matched0 AS (
  SELECT u.*, p.pos_time, p.avl_history_id, p.latitude, p.gps_status, p.trip
  FROM used_d u ASOF LEFT JOIN pos_d p
    ON u.vehicle_id = p.vehicle_id AND u.service_day = p.service_day AND u.txn_time >= p.pos_time),
matched AS (
  SELECT m.*, x.maxtime FROM matched0 m
  LEFT JOIN maxt x ON m.vehicle_id = x.vehicle_id AND m.service_day = x.service_day),
yrs AS (SELECT CAST(generate_series AS INTEGER) AS y FROM generate_series(2000, 2030)),
hol AS (
  SELECT make_date(y, 1, 1) AS holiday_date, 'Sunday' AS service FROM yrs
  UNION ALL SELECT make_date(y, 1, 1) + CAST((8 - isodow(make_date(y, 1, 1))) % 7 + 14 AS INTEGER), 'Saturday' FROM yrs
  UNION ALL SELECT make_date(y, 5, 25) + CAST((8 - isodow(make_date(y, 5, 25))) % 7 AS INTEGER), 'Sunday' FROM yrs
  UNION ALL SELECT make_date(y, 7, 4), 'Sunday' FROM yrs
  UNION ALL SELECT make_date(y, 9, 1) + CAST((8 - isodow(make_date(y, 9, 1))) % 7 AS INTEGER), 'Sunday' FROM yrs
  UNION ALL SELECT make_date(y, 11, 1) + CAST((11 - isodow(make_date(y, 11, 1))) % 7 + 21 AS INTEGER), 'Sunday' FROM yrs
  UNION ALL SELECT make_date(y, 12, 25), 'Sunday' FROM yrs),
hol1 AS (SELECT holiday_date, MIN(service) AS hs FROM hol GROUP BY 1),
typed AS (
  SELECT m.*,
         CASE WHEN h.hs = 'Saturday' THEN 'Saturday' WHEN h.hs = 'Sunday' THEN 'Sunday'
              WHEN isodow(m.service_day) BETWEEN 1 AND 5 THEN 'Weekday' ELSE dayname(m.service_day) END AS service_type,
         CASE WHEN m.latitude > 60.0 THEN '901' WHEN m.latitude < 20.0 THEN '902' ELSE '90' END AS local_route
  FROM matched m LEFT JOIN hol1 h ON m.service_day = h.holiday_date)
"""


def sql(select: str, *extra_ctes: str) -> str:
    ctes = ROLE_CTES.strip()
    for c in extra_ctes:
        ctes += ",\n" + c.strip()
    return f"WITH {ctes}\n{select.strip()}"


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------- helpers

def _inputs(spark: SparkSession, sf_dir: str):
    return roles.td(spark, sf_dir), roles.positions(spark, sf_dir), roles.rules(spark)


def _matched(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """The matched table of the role inputs."""
    from fareshift.plans.period import matched_table
    td, pos, rules = _inputs(spark, sf_dir)
    return matched_table(td, pos, rules, **GEO, **kw)


def _located(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """The matched table for location summaries: only the latitude is carried."""
    return _matched(spark, sf_dir, position_cols=("latitude",), columns=(), **kw)


# ---------------------------------------------------------------- queries

@register("local_by_day", sql("""
SELECT service_day, local_route, COUNT(*) AS ridership
FROM typed WHERE local_route <> '90' GROUP BY 1, 2"""))
def local_by_day(spark, sf_dir):
    """DOM-5 flagship: ridership of the local routes by service day."""
    from fareshift.operators.summary import local_counts
    return local_counts(_located(spark, sf_dir), ["service_day", "local_route"])


@register("asof_backward", sql("""
SELECT txn_id, vehicle_id, service_day, txn_time, pos_time, avl_history_id, latitude, gps_status, maxtime
FROM matched"""))
def asof_backward(spark, sf_dir):
    """JOI-1 + JOI-7: last position at or before each used transaction on its vehicle-day."""
    from fareshift.operators.matching import match_positions
    from fareshift.operators.ridership import ridership_only
    td, pos, rules = _inputs(spark, sf_dir)
    m = match_positions(ridership_only(td, rules).select("txn_id", "vehicle_id", "txn_time"), pos,
                        position_cols=("avl_history_id", "latitude", "gps_status"))
    return m.select("txn_id", "vehicle_id", "service_day", "txn_time", "pos_time", "avl_history_id",
                    "latitude", "gps_status", "maxtime")


# ---------------------------------------------------------------- ridership rules

@register("ridership_used", sql("SELECT * FROM used"))
def ridership_used(spark, sf_dir):
    """FLT-1 / JOI-10: transactions whose description is a rule code, or transfers."""
    from fareshift.operators.ridership import ridership_only
    td, _, rules = _inputs(spark, sf_dir)
    return ridership_only(td, rules)


@register("ridership_unused", sql("""
SELECT * FROM td WHERE NOT (description IN (SELECT code FROM rules) OR type LIKE '%118%')"""))
def ridership_unused(spark, sf_dir):
    """JOI-9 / SET-5 / DOM-2: the rest, as the negated ridership filter (one scan, no join)."""
    from fareshift.operators.ridership import unused_transactions
    td, _, rules = _inputs(spark, sf_dir)
    return unused_transactions(td, rules)


@register("used_unused_counts", sql("""
SELECT COUNT(*) AS n_all,
       COUNT(*) FILTER (WHERE description IN (SELECT code FROM rules) OR type LIKE '%118%') AS n_used,
       COUNT(*) FILTER (WHERE NOT (description IN (SELECT code FROM rules) OR type LIKE '%118%')) AS n_unused,
       COUNT(*) FILTER (WHERE description IN (SELECT code FROM rules) OR type LIKE '%118%')
         + COUNT(*) FILTER (WHERE NOT (description IN (SELECT code FROM rules) OR type LIKE '%118%'))
         = COUNT(*) AS counts_agree
FROM td"""))
def used_unused_counts(spark, sf_dir):
    """AGG-3 / DOM-2: used + unused = all, in one aggregate."""
    from fareshift.operators.ridership import used_unused_counts as f
    td, _, rules = _inputs(spark, sf_dir)
    return f(td, rules)


@register("unused_by_description", sql("""
SELECT description, COUNT(*) AS n FROM td
WHERE NOT (description IN (SELECT code FROM rules) OR type LIKE '%118%') GROUP BY 1"""))
def unused_by_description(spark, sf_dir):
    """AGG-1: what is left out, counted by description."""
    from fareshift.operators.ridership import unused_by
    td, _, rules = _inputs(spark, sf_dir)
    return unused_by(td, rules, "description")


@register("unused_by_type", sql("""
SELECT type, COUNT(*) AS n FROM td
WHERE NOT (description IN (SELECT code FROM rules) OR type LIKE '%118%') GROUP BY 1"""))
def unused_by_type(spark, sf_dir):
    """AGG-1: what is left out, counted by Type."""
    from fareshift.operators.ridership import unused_by
    td, _, rules = _inputs(spark, sf_dir)
    return unused_by(td, rules, "type")


@register("route_family_fleet", sql("""
SELECT txn_id, CASE WHEN vehicle_id = '0' THEN '1970' ELSE vehicle_id END AS vehicle_id, route, service_day
FROM used_d
WHERE regexp_matches(route, '^90')
  AND (TRY_CAST(vehicle_id AS BIGINT) IN (149) OR TRY_CAST(vehicle_id AS BIGINT) BETWEEN 0 AND 139)"""))
def route_family_fleet(spark, sf_dir):
    """FLT-2 route family '^90', FLT-4 fleet (one id plus a range), FIX-1 vehicle repair, PRJ-1..3."""
    from fareshift.plans.period import used_transactions
    td, _, rules = _inputs(spark, sf_dir)
    t = used_transactions(td, rules, route_pattern="^90", fleet=([149], [(0, 139)]), repair={"0": "1970"})
    return t.select("txn_id", "vehicle_id", "route", "service_day")


# ---------------------------------------------------------------- date and time

@register("service_day_counts", sql("""
SELECT service_day, COUNT(*) AS n FROM used_d
WHERE service_day >= DATE '2024-01-01' AND service_day < DATE '2024-01-31' GROUP BY 1"""))
def service_day_counts(spark, sf_dir):
    """DT-1/DT-3 service day, FLT-5 half-open period, AGG-1 count by day."""
    from fareshift.operators.matching import transactions_in_period
    from fareshift.operators.ridership import count_by, ridership_only
    td, _, rules = _inputs(spark, sf_dir)
    t = transactions_in_period(ridership_only(td, rules), "2024-01-01", "2024-01-31")
    return count_by(t, "service_day")


@register("service_seconds", sql("""
SELECT txn_id, service_day,
       date_diff('microsecond', CAST(service_day AS TIMESTAMP), txn_time) / 1e6 AS service_seconds,
       strftime(txn_time, '%H:%M:%S') AS clock, CAST(hour(txn_time) AS INTEGER) AS clock_hour
FROM used_d"""))
def service_seconds(spark, sf_dir):
    """DT-4 seconds since the service day's midnight (past 86,400 after midnight), DT-5 clock text and hour."""
    from fareshift.functions.timefns import clock_text, service_day, service_seconds as secs
    from fareshift.operators.ridership import ridership_only
    td, _, rules = _inputs(spark, sf_dir)
    t = ridership_only(td, rules).withColumn("service_day", service_day("txn_time"))
    return t.select("txn_id", "service_day", secs("txn_time", "service_day").alias("service_seconds"),
                    clock_text("txn_time").alias("clock"), F.hour("txn_time").alias("clock_hour"))


@register("clock_hour_counts", sql("""
SELECT monthname(service_day) AS month, CAST(month(service_day) AS INTEGER) AS month_number,
       CAST(hour(txn_time) AS INTEGER) AS clock_hour,
       COUNT(*) AS n
FROM used_d GROUP BY 1, 2, 3"""))
def clock_hour_counts(spark, sf_dir):
    """DT-5: counts by month name, month number and clock hour."""
    from fareshift.functions.timefns import month_name, service_day
    from fareshift.operators.ridership import ridership_only
    td, _, rules = _inputs(spark, sf_dir)
    t = ridership_only(td, rules).withColumn("service_day", service_day("txn_time"))
    return t.groupBy(month_name("service_day").alias("month"), F.month("service_day").alias("month_number"),
                     F.hour("txn_time").alias("clock_hour")).agg(F.count(F.lit(1)).alias("n"))


HOLIDAY_NAMES_SQL = """
dyrs AS (SELECT DISTINCT CAST(year(CAST(txn_time - INTERVAL 3 HOUR AS DATE)) AS INTEGER) AS y FROM td),
dhol AS (
  SELECT make_date(y, 1, 1) AS holiday_date, 'New Year''s Day' AS holiday, 'Sunday' AS service, y AS year FROM dyrs
  UNION ALL SELECT make_date(y, 1, 1) + CAST((8 - isodow(make_date(y, 1, 1))) % 7 + 14 AS INTEGER),
                   'Martin Luther King Jr. Day', 'Saturday', y FROM dyrs
  UNION ALL SELECT make_date(y, 5, 25) + CAST((8 - isodow(make_date(y, 5, 25))) % 7 AS INTEGER),
                   'Memorial Day', 'Sunday', y FROM dyrs
  UNION ALL SELECT make_date(y, 7, 4), 'Independence Day', 'Sunday', y FROM dyrs
  UNION ALL SELECT make_date(y, 9, 1) + CAST((8 - isodow(make_date(y, 9, 1))) % 7 AS INTEGER),
                   'Labor Day', 'Sunday', y FROM dyrs
  UNION ALL SELECT make_date(y, 11, 1) + CAST((11 - isodow(make_date(y, 11, 1))) % 7 + 21 AS INTEGER),
                   'Thanksgiving Day', 'Sunday', y FROM dyrs
  UNION ALL SELECT make_date(y, 12, 25), 'Christmas Day', 'Sunday', y FROM dyrs)
"""


@register("holiday_calendar", sql("SELECT * FROM dhol", HOLIDAY_NAMES_SQL))
def holiday_calendar_q(spark, sf_dir):
    """DT-6 / DT-10: the holiday calendar for every year the transactions' service days touch."""
    from fareshift.functions.calendar import holiday_calendar
    from fareshift.functions.timefns import service_day
    td, _, _ = _inputs(spark, sf_dir)
    years = td.select(F.year(service_day("txn_time")).alias("year"))
    return holiday_calendar(spark, years=years)


@register("service_type_counts", sql("""
SELECT u.service_day,
       CASE WHEN h.hs = 'Saturday' THEN 'Saturday' WHEN h.hs = 'Sunday' THEN 'Sunday'
            WHEN isodow(u.service_day) BETWEEN 1 AND 5 THEN 'Weekday' ELSE dayname(u.service_day) END AS service_type,
       dayname(u.service_day) AS weekday, COUNT(*) AS n
FROM used_d u LEFT JOIN hol1 h ON u.service_day = h.holiday_date GROUP BY 1, 2, 3"""))
def service_type_counts(spark, sf_dir):
    """CLS-2 service type (holidays, weekdays), DT-7 weekday name, AGG-1."""
    from fareshift.functions.calendar import with_service_type
    from fareshift.functions.timefns import service_day, weekday_name
    from fareshift.operators.ridership import ridership_only
    td, _, rules = _inputs(spark, sf_dir)
    t = ridership_only(td, rules).withColumn("service_day", service_day("txn_time"))
    t = with_service_type(t, "service_day")
    return t.groupBy("service_day", "service_type", weekday_name("service_day").alias("weekday")) \
        .agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- as-of joins

MATCH_COLS = ("txn_id", "vehicle_id", "service_day", "txn_time", "pos_time", "avl_history_id", "latitude",
              "gps_status")

FIRSTP_SQL = """
firstp AS (
  SELECT * FROM (
    SELECT p.*, row_number() OVER (PARTITION BY vehicle_id, service_day ORDER BY pos_time, avl_history_id DESC) AS rn
    FROM pos_d p) WHERE rn = 1)
"""


@register("asof_roll_ends", sql("""
SELECT m.txn_id, m.vehicle_id, m.service_day, m.txn_time,
       CASE WHEN m.pos_time IS NULL THEN f.pos_time ELSE m.pos_time END AS pos_time,
       CASE WHEN m.pos_time IS NULL THEN f.avl_history_id ELSE m.avl_history_id END AS avl_history_id,
       CASE WHEN m.pos_time IS NULL THEN f.latitude ELSE m.latitude END AS latitude,
       CASE WHEN m.pos_time IS NULL THEN f.gps_status ELSE m.gps_status END AS gps_status
FROM matched0 m LEFT JOIN firstp f ON m.vehicle_id = f.vehicle_id AND m.service_day = f.service_day""", FIRSTP_SQL))
def asof_roll_ends(spark, sf_dir):
    """JOI-2: as JOI-1, but a transaction before the vehicle-day's first position takes that first one."""
    from fareshift.operators.matching import match_positions
    from fareshift.operators.ridership import ridership_only
    td, pos, rules = _inputs(spark, sf_dir)
    used = ridership_only(td, rules).select("txn_id", "vehicle_id", "txn_time")
    m = match_positions(used, pos, roll_ends=True, last_time=None, position_cols=("avl_history_id", "latitude", "gps_status"))
    return m.select(*MATCH_COLS)


@register("asof_forward_tolerance", sql("""
SELECT u.txn_id, u.vehicle_id, u.service_day, u.txn_time, p.pos_time, p.avl_history_id, p.latitude, p.gps_status
FROM used_d u ASOF JOIN pos_d p
  ON u.vehicle_id = p.vehicle_id AND u.service_day = p.service_day AND u.txn_time <= p.pos_time
WHERE p.pos_time <= u.txn_time + INTERVAL 3600 SECOND"""))
def asof_forward_tolerance(spark, sf_dir):
    """JOI-3: next position within 3,600 s (exact), inner: unmatched transactions dropped."""
    from fareshift.operators.asof import asof_join
    from fareshift.operators.matching import with_service_day
    from fareshift.operators.ridership import ridership_only
    td, pos, rules = _inputs(spark, sf_dir)
    left = with_service_day(ridership_only(td, rules), "txn_time").select("txn_id", "vehicle_id", "service_day", "txn_time")
    right = with_service_day(pos, "pos_time")
    m = asof_join(left, right, by=["vehicle_id", "service_day"], left_time="txn_time", right_time="pos_time",
                  right_cols=["avl_history_id", "latitude", "gps_status"], tie="avl_history_id",
                  direction="forward", tolerance=3600, how="inner")
    return m.select(*MATCH_COLS)


TIES_SQL = """
td2 AS (SELECT o_orderkey AS txn_id, o_orderdate AS txn_time, o_custkey AS vehicle_id FROM orders),
positions2 AS (
  SELECT o_custkey AS vehicle_id, l_shipdate AS pos_time, l_orderkey * 10 + l_linenumber AS avl_history_id,
         MAX(l_quantity) AS latitude
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
p2last AS (
  SELECT vehicle_id, pos_time, MAX(avl_history_id) AS avl_history_id, arg_max(latitude, avl_history_id) AS latitude
  FROM positions2 GROUP BY 1, 2),
p2t AS (SELECT DISTINCT vehicle_id, pos_time FROM positions2)
"""


def _ties_join(spark, sf_dir, ties, **kw):
    from fareshift.operators.asof import asof_join
    t2, p2 = roles.td2(spark, sf_dir), roles.positions2(spark, sf_dir)
    return asof_join(t2, p2, by=["vehicle_id"], left_time="txn_time", right_time="pos_time",
                     right_cols=["avl_history_id", "latitude"], tie="avl_history_id", ties=ties,
                     bucket_unit="day", **kw)


@register("asof_ties_last", sql("""
SELECT t.txn_id, t.txn_time, t.vehicle_id, p.pos_time, p.avl_history_id, p.latitude
FROM td2 t ASOF LEFT JOIN p2last p ON t.vehicle_id = p.vehicle_id AND t.txn_time >= p.pos_time""", TIES_SQL))
def asof_ties_last(spark, sf_dir):
    """JOI-1 with ties: of several positions at the matched time, the one with the largest id."""
    return _ties_join(spark, sf_dir, "last")


@register("asof_ties_all", sql("""
SELECT t.txn_id, t.txn_time, t.vehicle_id, p.pos_time, p.avl_history_id, p.latitude
FROM td2 t JOIN positions2 p ON t.vehicle_id = p.vehicle_id AND t.txn_time = p.pos_time
UNION ALL
SELECT t.txn_id, t.txn_time, t.vehicle_id, p.pos_time, p.avl_history_id, p.latitude
FROM td2 t ASOF LEFT JOIN p2last p ON t.vehicle_id = p.vehicle_id AND t.txn_time >= p.pos_time
WHERE p.pos_time IS DISTINCT FROM t.txn_time""", TIES_SQL))
def asof_ties_all(spark, sf_dir):
    """JOI-2 'mult=all': every position at exactly the transaction's time; one row where the match is rolled."""
    return _ties_join(spark, sf_dir, "all")


@register("asof_ties_rolled", sql("""
SELECT t.txn_id, t.txn_time, t.vehicle_id, p.pos_time, p.avl_history_id, p.latitude
FROM td2 t JOIN positions2 p ON t.vehicle_id = p.vehicle_id AND t.txn_time = p.pos_time
UNION ALL
SELECT t.txn_id, t.txn_time, t.vehicle_id, COALESCE(p.pos_time, f.pos_time), COALESCE(p.avl_history_id, f.avl_history_id),
       CASE WHEN p.pos_time IS NULL THEN f.latitude ELSE p.latitude END
FROM td2 t ASOF LEFT JOIN p2last p ON t.vehicle_id = p.vehicle_id AND t.txn_time >= p.pos_time
LEFT JOIN (SELECT q.* FROM p2last q JOIN (SELECT vehicle_id, MIN(pos_time) AS m FROM p2last GROUP BY 1) x
             ON q.vehicle_id = x.vehicle_id AND q.pos_time = x.m) f ON t.vehicle_id = f.vehicle_id
WHERE p.pos_time IS DISTINCT FROM t.txn_time""", TIES_SQL))
def asof_ties_rolled(spark, sf_dir):
    """JOI-2: both ends rolled, ties at exactly the transaction's time expanded."""
    return _ties_join(spark, sf_dir, "all", roll_ends=True)


@register("asof_stored", sql("""
SELECT txn_id, vehicle_id, service_day, txn_time, pos_time, avl_history_id, latitude, gps_status, maxtime
FROM matched"""))
def asof_stored(spark, sf_dir):
    """SRT-3 / DOM-4 on stored positions: two half-months written into one bucketed table, which the match reads without a shuffle."""
    import uuid

    from fareshift.operators.matching import match_positions, with_service_day
    from fareshift.operators.ridership import ridership_only
    from fareshift.session import ensure_checkpoint_dir
    from fareshift.sources.sinks import write_bucketed
    td, pos, rules = _inputs(spark, sf_dir)
    by, name = ["vehicle_id", "service_day"], f"fareshift_positions_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pos = with_service_day(pos, "pos_time")
    for mode, part in (("overwrite", pos.where("service_day < DATE'2024-01-16'")), ("append", pos.where("service_day >= DATE'2024-01-16'"))):
        write_bucketed(part, name, by, "pos_time", buckets=buckets, mode=mode, path=f"{ensure_checkpoint_dir(spark)}/fareshift/{name}")
    used = ridership_only(td, rules).select("txn_id", "vehicle_id", "txn_time")
    m = match_positions(used, spark.table(name), stored=buckets, position_cols=("avl_history_id", "latitude", "gps_status"))
    return m.select("txn_id", "vehicle_id", "service_day", "txn_time", "pos_time", "avl_history_id", "latitude", "gps_status", "maxtime")


@register("asof_nearest", sql("""
SELECT m.txn_id, m.txn_time, m.vehicle_id, m.service_day, m.pos_time AS prev_pos_time, m.latitude AS prev_latitude,
       n.pos_time AS next_pos_time, n.latitude AS next_latitude
FROM matched0 m ASOF LEFT JOIN pos_d n
  ON m.vehicle_id = n.vehicle_id AND m.service_day = n.service_day AND m.txn_time <= n.pos_time"""))
def asof_nearest(spark, sf_dir):
    """JOI-1 and JOI-3 together: the positions before and after each transaction, in one pass."""
    from fareshift.operators.asof import asof_both
    from fareshift.operators.matching import with_service_day
    from fareshift.operators.ridership import ridership_only
    td, pos, rules = _inputs(spark, sf_dir)
    left = with_service_day(ridership_only(td, rules), "txn_time").select("txn_id", "txn_time", "vehicle_id", "service_day")
    return asof_both(left, with_service_day(pos, "pos_time"), by=["vehicle_id", "service_day"], left_time="txn_time",
                     right_time="pos_time", right_cols=["latitude"], tie="avl_history_id")


@register("asof_comparison", sql("""
SELECT COUNT(*) FILTER (WHERE latitude > 60.0 OR latitude < 20.0) AS local_exact_match,
       (SELECT COUNT(*) FROM used_d u ASOF JOIN pos_d p
          ON u.vehicle_id = p.vehicle_id AND u.service_day = p.service_day AND u.txn_time <= p.pos_time
        WHERE p.pos_time <= u.txn_time + INTERVAL 120 SECOND AND (p.latitude > 60.0 OR p.latitude < 20.0))
         AS local_fuzzy_match,
       COUNT(*) AS n_exact,
       (SELECT COUNT(*) FROM used_d u ASOF JOIN pos_d p
          ON u.vehicle_id = p.vehicle_id AND u.service_day = p.service_day AND u.txn_time <= p.pos_time
        WHERE p.pos_time <= u.txn_time + INTERVAL 120 SECOND) AS n_fuzzy
FROM matched0"""))
def asof_comparison(spark, sf_dir):
    """DOM-10: local counts by the exact backward match and by the 120 s forward match."""
    from fareshift.operators.matching import asof_comparison as f
    from fareshift.operators.ridership import ridership_only
    td, pos, rules = _inputs(spark, sf_dir)
    return f(ridership_only(td, rules), pos, 120.0, NORTH, SOUTH)


@register("match_count_check", sql("""
SELECT r.vehicle_id, r.service_day, r.roll_count, t.td_count, t.td_count - r.roll_count AS diff
FROM (SELECT vehicle_id, service_day, COUNT(*) AS roll_count FROM matched GROUP BY 1, 2) r
LEFT JOIN (SELECT vehicle_id, service_day, COUNT(*) AS td_count FROM used_d GROUP BY 1, 2) t
  ON r.vehicle_id IS NOT DISTINCT FROM t.vehicle_id AND r.service_day = t.service_day"""))
def match_count_check(spark, sf_dir):
    """QLT-5 / JOI-8: per vehicle-day the as-of join keeps every transaction (diff = 0)."""
    from fareshift.operators.matching import match_count_check as f, match_positions
    from fareshift.operators.ridership import ridership_only
    td, pos, rules = _inputs(spark, sf_dir)
    used = ridership_only(td, rules).select("vehicle_id", "txn_time")
    return f(match_positions(used, pos, position_cols=(), last_time=None), used)


@register("last_position", sql("SELECT * FROM maxt"))
def last_position_q(spark, sf_dir):
    """AGG-2: latest position time per vehicle and service day."""
    from fareshift.operators.asof import last_position
    from fareshift.operators.matching import with_service_day
    _, pos, _ = _inputs(spark, sf_dir)
    return last_position(with_service_day(pos, "pos_time"))


# ---------------------------------------------------------------- summaries

@register("local_by_day_wide", sql("""
SELECT service_day, NULLIF(COUNT(*) FILTER (WHERE local_route = '901'), 0) AS ridership_901,
       NULLIF(COUNT(*) FILTER (WHERE local_route = '902'), 0) AS ridership_902
FROM typed WHERE local_route <> '90' GROUP BY 1"""))
def local_by_day_wide(spark, sf_dir):
    """RSH-2: day x local route, absent cells null."""
    from fareshift.operators.summary import LOCAL_ROUTES, local_wide
    return local_wide(_located(spark, sf_dir), ["service_day"], "local_route", LOCAL_ROUTES, "ridership_")


@register("local_by_type_long", sql("""
SELECT service_type, local_route, COUNT(*) AS ridership FROM typed WHERE local_route <> '90' GROUP BY 1, 2"""))
def local_by_type_long(spark, sf_dir):
    """DOM-5: local ridership by service type and local route (long)."""
    from fareshift.operators.summary import local_counts
    return local_counts(_located(spark, sf_dir), ["service_type", "local_route"])


@register("local_by_type_wide", sql("""
SELECT local_route, NULLIF(COUNT(*) FILTER (WHERE service_type = 'Weekday'), 0) AS "Weekday",
       NULLIF(COUNT(*) FILTER (WHERE service_type = 'Saturday'), 0) AS "Saturday",
       NULLIF(COUNT(*) FILTER (WHERE service_type = 'Sunday'), 0) AS "Sunday"
FROM typed WHERE local_route <> '90' GROUP BY 1"""))
def local_by_type_wide(spark, sf_dir):
    """RSH-2: local route x service type (Weekday, Saturday, Sunday)."""
    from fareshift.operators.summary import SERVICE_TYPES, local_wide
    return local_wide(_located(spark, sf_dir), ["local_route"], "service_type", SERVICE_TYPES)


@register("local_by_month", sql("""
SELECT CAST(year(service_day) AS INTEGER) AS year, monthname(service_day) AS month, COUNT(*) AS ridership
FROM typed WHERE local_route <> '90' GROUP BY 1, 2"""))
def local_by_month(spark, sf_dir):
    """DOM-5 / FLT-7: ridership outside the corridor per month."""
    from fareshift.operators.summary import local_by_month as f
    return f(_located(spark, sf_dir))


DAILY_SQL = """
daily AS (SELECT service_day, service_type, local_route, COUNT(*) AS ridership
          FROM typed WHERE local_route <> '90' GROUP BY 1, 2, 3)
"""


@register("service_summary", sql("""
SELECT service_type, CAST(year(service_day) AS INTEGER) AS year, monthname(service_day) AS month, local_route,
       CAST(SUM(ridership) AS BIGINT) AS total_ridership, COUNT(*) AS service_days,
       round_even(AVG(ridership), 0) AS average_daily_ridership
FROM daily GROUP BY 1, 2, 3, 4""", DAILY_SQL))
def service_summary_q(spark, sf_dir):
    """AGG-5 / NUM-1: daily counts, then total, days and half-even mean per type, month, route."""
    from fareshift.operators.summary import daily_series, service_summary, with_month
    d = daily_series(_located(spark, sf_dir), ["service_day", "service_type", "local_route"])
    return service_summary(with_month(d), ["service_type", "year", "month", "local_route"])


@register("service_summary_distinct", sql("""
SELECT service_type, local_route, COUNT(*) AS total_ridership, COUNT(DISTINCT service_day) AS service_days,
       round_even(COUNT(*) / COUNT(DISTINCT service_day), 0) AS average_daily_ridership
FROM typed WHERE local_route <> '90' GROUP BY 1, 2"""))
def service_summary_distinct_q(spark, sf_dir):
    """AGG-6: rows over distinct days, half-even."""
    from fareshift.operators.summary import service_summary_distinct
    return service_summary_distinct(_located(spark, sf_dir))


SEASON_SQL = """
ctl AS (
  SELECT d.service_day,
         CASE WHEN h.hs = 'Saturday' THEN 'Saturday' WHEN h.hs = 'Sunday' THEN 'Sunday'
              WHEN isodow(d.service_day) BETWEEN 1 AND 5 THEN 'Weekday' ELSE dayname(d.service_day) END AS service_type,
         d.ridership
  FROM daily_totals d LEFT JOIN hol1 h ON d.service_day = h.holiday_date
  WHERE d.service_day < DATE '2024-01-16'),
own AS (
  SELECT service_day, service_type, COUNT(*) AS ridership FROM typed
  WHERE local_route <> '90' AND service_day >= DATE '2024-01-16' GROUP BY 1, 2),
comb AS (SELECT * FROM ctl UNION ALL SELECT * FROM own)
"""


def _season_series(spark, sf_dir):
    """SET-2: control series before the matched period, matched series after."""
    from fareshift.functions.calendar import with_service_type
    from fareshift.operators.summary import daily_series
    ctl = roles.daily_totals(spark, sf_dir).where(F.col("service_day") < F.lit("2024-01-16").cast("date"))
    ctl = with_service_type(ctl, "service_day").select("service_day", "service_type", "ridership")
    own = daily_series(_located(spark, sf_dir, start="2024-01-16"))
    return ctl.unionByName(own)


@register("season_summary", sql("""
SELECT service_type, CAST(SUM(ridership) AS BIGINT) AS total_ridership, COUNT(*) AS service_days,
       round_even(AVG(ridership), 0) AS average_daily_ridership
FROM comb WHERE service_day <= DATE '2024-01-25' GROUP BY 1""", SEASON_SQL))
def season_summary_q(spark, sf_dir):
    """DOM-6: summary over control + matched daily series up to a date (FLT-6 inclusive end)."""
    from fareshift.operators.summary import season_summary
    return season_summary(_season_series(spark, sf_dir), ["service_type"], until="2024-01-25")


@register("monthly_summary", sql("""
SELECT CAST(year(service_day) AS INTEGER) AS year, monthname(service_day) AS month, service_type,
       CAST(SUM(ridership) AS BIGINT) AS total_ridership,
       COUNT(*) AS service_days, round_even(AVG(ridership), 0) AS average_daily_ridership
FROM comb GROUP BY 1, 2, 3""", SEASON_SQL))
def monthly_summary_q(spark, sf_dir):
    """DOM-6: the per-month copies of the summary as one grouped query."""
    from fareshift.operators.summary import service_summary, with_month
    return service_summary(with_month(_season_series(spark, sf_dir)), ["year", "month", "service_type"])


@register("missing_days", sql("""
SELECT CAST(d AS DATE) AS service_day FROM generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) g(d)
WHERE CAST(d AS DATE) NOT IN (SELECT service_day FROM typed WHERE local_route <> '90')"""))
def missing_days_q(spark, sf_dir):
    """DT-9: days of the range without local ridership (date spine + anti join)."""
    from fareshift.functions.calendar import missing_days
    from fareshift.operators.summary import daily_series
    return missing_days(daily_series(_located(spark, sf_dir), ["service_day"]), "2023-12-31", "2024-01-31")


# ---------------------------------------------------------------- quality

FLAGS_SQL = """
flags AS (
  SELECT txn_id, date_diff('microsecond', pos_time, txn_time) / 1e6 AS timediffs,
         COALESCE(txn_time > maxtime, FALSE) AS after_last,
         COALESCE(txn_time < maxtime AND date_diff('microsecond', pos_time, txn_time) / 1e6 > 90.0, FALSE) AS in_gap,
         (gps_status IS NULL OR gps_status <> 2) AS bad_gps,
         COALESCE(pos_time > txn_time, FALSE) AS before_first
  FROM matched)
"""


def _flags(spark, sf_dir):
    from fareshift.operators.quality import quality_flags
    return quality_flags(_matched(spark, sf_dir, position_cols=("latitude", "gps_status"), columns=("txn_id",)))


@register("quality_flags", sql("SELECT * FROM flags", FLAGS_SQL))
def quality_flags_q(spark, sf_dir):
    """QLT-2/3, FLT-8, DT-8: per transaction the gap in seconds and the fault flags."""
    return _flags(spark, sf_dir).select("txn_id", "timediffs", "after_last", "in_gap", "bad_gps", "before_first")


@register("questionable_pct", sql("""
SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE after_last) AS n_after_last,
       COUNT(*) FILTER (WHERE in_gap) AS n_in_gap, COUNT(*) FILTER (WHERE bad_gps) AS n_bad_gps,
       SUM(CAST(after_last AS BIGINT) + CAST(in_gap AS BIGINT) + CAST(bad_gps AS BIGINT)) / COUNT(*) * 100.0
         AS questionable_pct,
       COUNT(*) FILTER (WHERE after_last OR in_gap OR bad_gps) / COUNT(*) * 100.0 AS questionable_pct_distinct
FROM flags""", FLAGS_SQL))
def questionable_pct_q(spark, sf_dir):
    """QLT-4 / SET-4: faults per row (counted once per fault, and once per row)."""
    from fareshift.operators.quality import questionable_pct
    return questionable_pct(_flags(spark, sf_dir))


@register("questionable_fraction", sql("""
SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE after_last) AS n_after_last,
       COUNT(*) FILTER (WHERE in_gap2) AS n_in_gap, COUNT(*) FILTER (WHERE bad_gps) AS n_bad_gps,
       SUM(CAST(after_last AS BIGINT) + CAST(in_gap2 AS BIGINT) + CAST(bad_gps AS BIGINT)) / COUNT(*) * 1.0
         AS questionable_pct,
       COUNT(*) FILTER (WHERE after_last OR in_gap2 OR bad_gps) / COUNT(*) * 1.0 AS questionable_pct_distinct
FROM (SELECT *, in_gap OR timediffs IS NULL AS in_gap2 FROM flags)""", FLAGS_SQL))
def questionable_fraction_q(spark, sf_dir):
    """QLT-3/4 variant of the parameterised run: a missing gap counts as a gap, share as a fraction."""
    from fareshift.operators.quality import quality_flags, questionable_pct
    m = _matched(spark, sf_dir, position_cols=("latitude", "gps_status"), columns=("txn_id",))
    return questionable_pct(quality_flags(m, null_is_gap=True), scale=1.0)


@register("quality_report", sql("""
SELECT round_even((SELECT COUNT(*) FILTER (WHERE gps_status IS NULL OR gps_status <> 2) FROM positions)
                  / (SELECT COUNT(*) FROM positions) * 100, 3) AS bad_vmh_pct,
       (SELECT COUNT(*) FROM positions) AS count_vmh,
       round_even(COUNT(*) FILTER (WHERE bad_gps) / COUNT(*) * 100, 3) AS bad_td_pct,
       round_even(SUM(CAST(after_last AS BIGINT) + CAST(in_gap AS BIGINT) + CAST(bad_gps AS BIGINT)) / COUNT(*) * 100, 3)
         AS questionable_td_pct,
       COUNT(*) AS count_td
FROM flags""", FLAGS_SQL))
def quality_report_q(spark, sf_dir):
    """AGG-9 / QLT-1: one-row report over positions and matched transactions."""
    from fareshift.operators.quality import quality_report
    _, pos, _ = _inputs(spark, sf_dir)
    return quality_report(pos, _flags(spark, sf_dir))


@register("bad_gps_by_month", sql("""
SELECT CAST(year(service_day) AS INTEGER) AS year, monthname(service_day) AS month,
       COUNT(*) FILTER (WHERE gps_status IS NULL OR gps_status <> 2) / (SELECT COUNT(*) FROM matched) * 100
         AS bad_td_gps_pct
FROM matched GROUP BY 1, 2"""))
def bad_gps_by_month_q(spark, sf_dir):
    """AGG-4: bad-GPS share per month over the whole table's rows."""
    from fareshift.operators.quality import bad_gps_by_month
    return bad_gps_by_month(_matched(spark, sf_dir, position_cols=("latitude", "gps_status"), columns=("txn_id",)))


@register("bad_gps_by_month_route", sql("""
SELECT CAST(year(service_day) AS INTEGER) AS year, monthname(service_day) AS month, local_route,
       COUNT(*) FILTER (WHERE gps_status IS NULL OR gps_status <> 2) / (SELECT COUNT(*) FROM typed) * 100
         AS bad_td_gps_pct
FROM typed GROUP BY 1, 2, 3"""))
def bad_gps_by_month_route_q(spark, sf_dir):
    """AGG-4: bad-GPS share per month and local route over the whole table's rows."""
    from fareshift.operators.quality import bad_gps_by_month_route
    return bad_gps_by_month_route(_matched(spark, sf_dir, position_cols=("latitude", "gps_status"), columns=("txn_id",)))


QBM_SQL = """
qbm AS (
  SELECT CAST(year(m.service_day) AS INTEGER) AS year, monthname(m.service_day) AS month, COUNT(*) AS n_rows,
         COUNT(*) FILTER (WHERE after_last) AS n_after_last,
         COUNT(*) FILTER (WHERE in_gap) AS n_in_gap, COUNT(*) FILTER (WHERE bad_gps) AS n_bad_gps,
         SUM(CAST(after_last AS BIGINT) + CAST(in_gap AS BIGINT) + CAST(bad_gps AS BIGINT)) AS faults,
         COUNT(*) FILTER (WHERE after_last OR in_gap OR bad_gps) AS anyf
  FROM flags f JOIN matched m ON f.txn_id = m.txn_id GROUP BY 1, 2),
qbm_pct AS (
  SELECT year, month, n_rows, n_after_last, n_in_gap, n_bad_gps,
         faults / (SELECT COUNT(*) FROM matched) * 100.0 AS questionable_pct,
         anyf / (SELECT COUNT(*) FROM matched) * 100.0 AS questionable_pct_distinct,
         faults / n_rows * 100.0 AS group_questionable_pct, anyf / n_rows * 100.0 AS group_questionable_pct_distinct
  FROM qbm)
"""


@register("questionable_by_month", sql("SELECT * FROM qbm_pct", FLAGS_SQL, QBM_SQL))
def questionable_by_month_q(spark, sf_dir):
    """QLT-4 by month: each month's faults over the whole table's transactions, and over the month's own."""
    from fareshift.operators.quality import questionable_by_month
    return questionable_by_month(_flags(spark, sf_dir))


ROLLED_SQL = """
firstp AS (
  SELECT * FROM (
    SELECT p.*, row_number() OVER (PARTITION BY vehicle_id, service_day ORDER BY pos_time, avl_history_id DESC) AS rn
    FROM pos_d p) WHERE rn = 1),
rolled AS (
  SELECT m.txn_id, m.txn_time, m.vehicle_id, m.maxtime, CASE WHEN m.pos_time IS NULL THEN f.pos_time ELSE m.pos_time END AS pos_time,
         CASE WHEN m.pos_time IS NULL THEN f.gps_status ELSE m.gps_status END AS gps_status
  FROM matched m LEFT JOIN firstp f ON m.vehicle_id = f.vehicle_id AND m.service_day = f.service_day),
rflags AS (
  SELECT txn_id, vehicle_id, date_diff('microsecond', pos_time, txn_time) / 1e6 AS timediffs,
         COALESCE(txn_time > maxtime, FALSE) AS after_last,
         COALESCE(txn_time < maxtime AND date_diff('microsecond', pos_time, txn_time) / 1e6 > 90.0, FALSE)
           OR pos_time IS NULL AS in_gap,
         (gps_status IS NULL OR gps_status <> 2) AS bad_gps, COALESCE(pos_time > txn_time, FALSE) AS before_first
  FROM rolled)
"""


@register("quality_flags_rolled", sql("SELECT * EXCLUDE (vehicle_id) FROM rflags", ROLLED_SQL))
def quality_flags_rolled_q(spark, sf_dir):
    """QLT-2/3 with both ends rolled (JOI-2): rides before the first position are matched to it."""
    from fareshift.operators.quality import quality_flags
    m = _matched(spark, sf_dir, position_cols=("avl_history_id", "latitude", "gps_status"), columns=("txn_id",),
                 roll_ends=True)
    return quality_flags(m, null_is_gap=True).select("txn_id", "timediffs", "after_last", "in_gap", "bad_gps",
                                                     "before_first")


@register("period_questionable", sql("""
SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE after_last) AS n_after_last,
       COUNT(*) FILTER (WHERE in_gap) AS n_in_gap, COUNT(*) FILTER (WHERE bad_gps) AS n_bad_gps,
       SUM(CAST(after_last AS BIGINT) + CAST(in_gap AS BIGINT) + CAST(bad_gps AS BIGINT)) / COUNT(*) * 1.0
         AS questionable_pct,
       COUNT(*) FILTER (WHERE after_last OR in_gap OR bad_gps) / COUNT(*) * 1.0 AS questionable_pct_distinct
FROM rflags WHERE TRY_CAST(vehicle_id AS BIGINT) IN (149) OR TRY_CAST(vehicle_id AS BIGINT) BETWEEN 0 AND 139""",
                                     ROLLED_SQL))
def period_questionable_q(spark, sf_dir):
    """The period run's quality share: fleet only, ends rolled, missing gap a gap, as a fraction."""
    from fareshift.operators.quality import quality_flags, questionable_pct
    m = _matched(spark, sf_dir, position_cols=("avl_history_id", "latitude", "gps_status"), columns=(), roll_ends=True,
                 ties="all", fleet=([149], [(0, 139)]))
    return questionable_pct(quality_flags(m, null_is_gap=True), scale=1.0)


@register("gps_by_trip", sql("""
SELECT service_day, trip, CAST(SUM(CASE WHEN gps_status = 0 THEN 0 ELSE 1 END) AS BIGINT) AS missingcount
FROM pos_d GROUP BY 1, 2"""))
def gps_by_trip_q(spark, sf_dir):
    """AGG-8 / CLS-4: positions whose GPS status is not 0, per day and trip."""
    from fareshift.operators.matching import with_service_day
    from fareshift.operators.quality import gps_by_trip
    _, pos, _ = _inputs(spark, sf_dir)
    return gps_by_trip(with_service_day(pos, "pos_time"))


@register("gps_profile", sql("SELECT gps_status, COUNT(*) AS n FROM positions GROUP BY 1"))
def gps_profile_q(spark, sf_dir):
    """AGG-1 by GPS status."""
    from fareshift.operators.quality import gps_profile
    _, pos, _ = _inputs(spark, sf_dir)
    return gps_profile(pos)


# ---------------------------------------------------------------- reconciliation

@register("reconcile", sql("""
SELECT m.route, m.ridership_td, r.ridership, m.ridership_td - r.ridership AS ridership_diff,
       round_even((m.ridership_td - r.ridership) / r.ridership * 100, 3) AS percent_disagree
FROM (SELECT route, COUNT(*) AS ridership_td FROM used GROUP BY 1) m JOIN routesum r ON m.route = r.route"""))
def reconcile_q(spark, sf_dir):
    """DOM-1 / JOI-5: own count per route against RouteSum."""
    from fareshift.operators.ridership import reconcile
    td, _, rules = _inputs(spark, sf_dir)
    return reconcile(td, rules, roles.routesum(spark, sf_dir))


@register("reconcile_outer", sql("""
SELECT m.route, m.ridership_td, r.ridership, m.ridership_td - r.ridership AS ridership_diff,
       round_even((m.ridership_td - r.ridership) / r.ridership * 100, 3) AS percent_disagree
FROM (SELECT route, COUNT(*) AS ridership_td FROM used GROUP BY 1) m LEFT JOIN routesum r ON m.route = r.route"""))
def reconcile_outer_q(spark, sf_dir):
    """JOI-6: every route of the transactions, null control where RouteSum has none."""
    from fareshift.operators.ridership import reconcile
    td, _, rules = _inputs(spark, sf_dir)
    return reconcile(td, rules, roles.routesum(spark, sf_dir), how="left")


@register("reconcile_sorted", sql("""
SELECT m.route, m.ridership_td, r.ridership, m.ridership_td - r.ridership AS ridership_diff,
       round_even((m.ridership_td - r.ridership) / r.ridership * 100, 3) AS percent_disagree
FROM (SELECT route, COUNT(*) AS ridership_td FROM used GROUP BY 1) m LEFT JOIN routesum r ON m.route = r.route
ORDER BY TRY_CAST(m.route AS INTEGER) NULLS LAST, m.route"""))
def reconcile_sorted_q(spark, sf_dir):
    """SRT-1 / DOM-1: every route of the transactions beside its control, by route number."""
    from fareshift.operators.ridership import reconcile, sort_route_numeric
    td, _, rules = _inputs(spark, sf_dir)
    return sort_route_numeric(reconcile(td, rules, roles.routesum(spark, sf_dir), how="left"))


@register("reconcile_top", sql("""
SELECT m.route, m.ridership_td, r.ridership, m.ridership_td - r.ridership AS ridership_diff,
       round_even((m.ridership_td - r.ridership) / r.ridership * 100, 3) AS percent_disagree
FROM (SELECT route, COUNT(*) AS ridership_td FROM used GROUP BY 1) m JOIN routesum r ON m.route = r.route
ORDER BY ridership_diff DESC, m.route LIMIT 3"""))
def reconcile_top_q(spark, sf_dir):
    """LIM-1 / SRT-2: the three routes with the largest difference (a top-k report)."""
    from fareshift.operators.ridership import largest_differences, reconcile
    td, _, rules = _inputs(spark, sf_dir)
    return largest_differences(reconcile(td, rules, roles.routesum(spark, sf_dir)), 3)


@register("reconcile_transfers", sql("""
SELECT m.route, m.ridership_mine, m.mine_xfer, m.transfers, r.ridership,
       m.ridership_mine - r.ridership AS ridership_diff, m.mine_xfer - r.ridership AS xfer_diff,
       (m.mine_xfer - r.ridership) <> 0 AS nonzero_xfer_diff
FROM (SELECT route,
             COUNT(*) FILTER (WHERE description IN (SELECT code FROM rules)) AS ridership_mine,
             COUNT(*) FILTER (WHERE description IN (SELECT code FROM rules) OR type LIKE '%118%') AS mine_xfer,
             COUNT(*) FILTER (WHERE type LIKE '%118%') AS transfers
      FROM td GROUP BY 1) m JOIN routesum r ON m.route = r.route"""))
def reconcile_transfers_q(spark, sf_dir):
    """DOM-3 / FLT-9: rules only vs rules + transfers against the control."""
    from fareshift.operators.ridership import reconcile_transfers
    td, _, rules = _inputs(spark, sf_dir)
    return reconcile_transfers(td, rules, roles.routesum(spark, sf_dir))


# ---------------------------------------------------------------- control totals

CMP_SQL = """
cmp AS (
  SELECT COALESCE(a.service_day, b.service_day) AS service_day, a.n, b.ridership, a.n - b.ridership AS diff,
         round_even((a.n - b.ridership) / b.ridership * 100, 3) AS pct_diff
  FROM (SELECT service_day, COUNT(*) AS n FROM used_d WHERE regexp_matches(route, '^90') GROUP BY 1) a
  FULL JOIN daily_totals b ON a.service_day = b.service_day)
"""


def _compare(spark, sf_dir):
    from fareshift.operators.control import compare_daily
    from fareshift.operators.ridership import count_by
    from fareshift.plans.period import used_transactions
    td, _, rules = _inputs(spark, sf_dir)
    daily = count_by(used_transactions(td, rules, route_pattern="^90"), "service_day", out="n")
    return compare_daily(daily, roles.daily_totals(spark, sf_dir))


@register("compare_daily", sql("SELECT * FROM cmp", CMP_SQL))
def compare_daily_q(spark, sf_dir):
    """DOM-7 / JOI-11 by key: daily count against the control series (full outer)."""
    return _compare(spark, sf_dir)


@register("compare_daily_overall", sql("""
SELECT CAST(SUM(diff) AS BIGINT) AS sum_diff, CAST(SUM(ridership) AS BIGINT) AS sum_ridership,
       SUM(diff) / SUM(ridership) AS overall_ratio
FROM cmp WHERE diff IS NOT NULL""", CMP_SQL))
def compare_daily_overall_q(spark, sf_dir):
    """DOM-7 / AGG-7: overall ratio of differences to control."""
    from fareshift.operators.control import compare_daily_overall
    return compare_daily_overall(_compare(spark, sf_dir))


SCALE_SQL = """
lw AS (SELECT service_day, COUNT(*) FILTER (WHERE local_route = '901') AS r1,
              COUNT(*) FILTER (WHERE local_route = '902') AS r2
       FROM typed WHERE local_route <> '90' AND regexp_matches(route, '^90') GROUP BY 1),
sc AS (
  SELECT l.service_day, l.r1 AS ridership_901, l.r2 AS ridership_902, l.r1 + l.r2 AS ridershiprj, d.ridership,
         CASE WHEN l.r1 + l.r2 < d.ridership
              THEN COALESCE(CAST(trunc(l.r1 / NULLIF(l.r1 + l.r2, 0) * (d.ridership - (l.r1 + l.r2)) + l.r1) AS BIGINT), l.r1)
              ELSE l.r1 END AS final_901,
         CASE WHEN l.r1 + l.r2 < d.ridership
              THEN COALESCE(CAST(trunc(l.r2 / NULLIF(l.r1 + l.r2, 0) * (d.ridership - (l.r1 + l.r2)) + l.r2) AS BIGINT), l.r2)
              ELSE l.r2 END AS final_902
  FROM (SELECT COALESCE(l.service_day, d.service_day) AS service_day, COALESCE(l.r1, 0) AS r1, COALESCE(l.r2, 0) AS r2
        FROM lw l FULL JOIN daily_totals d ON l.service_day = d.service_day) l
  LEFT JOIN daily_totals d ON l.service_day = d.service_day),
sct AS (
  SELECT s.*, CASE WHEN h.hs = 'Saturday' THEN 'Saturday' WHEN h.hs = 'Sunday' THEN 'Sunday'
                   WHEN isodow(s.service_day) BETWEEN 1 AND 5 THEN 'Weekday' ELSE dayname(s.service_day) END AS service_type
  FROM sc s LEFT JOIN hol1 h ON s.service_day = h.holiday_date),
per_a AS (
  SELECT service_type, '901' AS local_route, CAST(SUM(final_901) AS BIGINT) AS ridership FROM sct
  WHERE service_day < DATE '2024-01-16' GROUP BY 1
  UNION ALL
  SELECT service_type, '902', CAST(SUM(final_902) AS BIGINT) FROM sct WHERE service_day < DATE '2024-01-16' GROUP BY 1),
per_b AS (
  SELECT service_type, local_route, COUNT(*) AS ridership FROM typed
  WHERE local_route <> '90' AND regexp_matches(route, '^90') AND service_day >= DATE '2024-01-16' GROUP BY 1, 2),
comb_t AS (
  SELECT local_route, service_type, CAST(SUM(ridership) AS BIGINT) AS ridership
  FROM (SELECT * FROM per_a UNION ALL SELECT * FROM per_b) GROUP BY 1, 2)
"""


def _matched90(spark, sf_dir):
    return _located(spark, sf_dir, route_pattern="^90")


def _scaled(spark, sf_dir):
    from fareshift.operators.control import scale_to_control
    from fareshift.operators.summary import LOCAL_ROUTES, local_wide
    wide = local_wide(_matched90(spark, sf_dir), ["service_day"], "local_route", LOCAL_ROUTES, "ridership_")
    return scale_to_control(wide, roles.daily_totals(spark, sf_dir))


@register("scale_to_control", sql("SELECT * FROM sc", SCALE_SQL))
def scale_to_control_q(spark, sf_dir):
    """DOM-8 / NUM-2 / NUM-3 / CND-1: proportional scale-up of 901/902 to the daily control."""
    return _scaled(spark, sf_dir)


def _scaled_typed(spark, sf_dir):
    from fareshift.functions.calendar import with_service_type
    return with_service_type(_scaled(spark, sf_dir), "service_day")


@register("scale_by_service_type", sql("""
SELECT service_type, '901' AS local_route, CAST(SUM(final_901) AS BIGINT) AS ridership FROM sct GROUP BY 1
UNION ALL
SELECT service_type, '902', CAST(SUM(final_902) AS BIGINT) FROM sct GROUP BY 1""", SCALE_SQL))
def scale_by_service_type_q(spark, sf_dir):
    """RSH-3 / AGG-7: scaled totals per service type, unpivoted to (type, local route)."""
    from fareshift.operators.control import scaled_by_service_type
    return scaled_by_service_type(_scaled_typed(spark, sf_dir))


def _combined(spark, sf_dir):
    from fareshift.operators.control import combine_periods
    return combine_periods(_scaled_typed(spark, sf_dir), "2024-01-16")


@register("compare_local_daily", sql("""
SELECT COALESCE(l.service_day, d.service_day) AS service_day, l.n, d.ridership, l.n - d.ridership AS diff,
       round_even((l.n - d.ridership) / d.ridership * 100, 3) AS pct_diff
FROM (SELECT service_day, r1 + r2 AS n FROM lw) l FULL JOIN daily_totals d ON l.service_day = d.service_day""", SCALE_SQL))
def compare_local_daily_q(spark, sf_dir):
    """DOM-7, the scale-up run's second comparison: matched local count against the control, by day."""
    from fareshift.operators.control import compare_daily
    from fareshift.operators.summary import daily_series
    local = daily_series(_matched90(spark, sf_dir), ["service_day"]).withColumnRenamed("ridership", "n")
    return compare_daily(local, roles.daily_totals(spark, sf_dir))


@register("combine_totals", sql("SELECT * FROM comb_t", SCALE_SQL))
def combine_totals_q(spark, sf_dir):
    """DOM-9: scaled first period + matched second period, per (local route, service type)."""
    return _combined(spark, sf_dir)


@register("combine_totals_wide", sql("""
SELECT local_route, CAST(SUM(ridership) FILTER (WHERE service_type = 'Weekday') AS BIGINT) AS "Weekday",
       CAST(SUM(ridership) FILTER (WHERE service_type = 'Saturday') AS BIGINT) AS "Saturday",
       CAST(SUM(ridership) FILTER (WHERE service_type = 'Sunday') AS BIGINT) AS "Sunday"
FROM comb_t GROUP BY 1""", SCALE_SQL))
def combine_totals_wide_q(spark, sf_dir):
    """DOM-9 / RSH-2: wide, columns Weekday, Saturday, Sunday."""
    from fareshift.operators.control import combine_totals_wide
    return combine_totals_wide(_combined(spark, sf_dir))


# ---------------------------------------------------------------- pass mix

PASS_SQL = """
pm0 AS (
  SELECT u.service_day,
         CASE WHEN x.d2 = 'Free' THEN 'Free Key'
              WHEN x.d2 IN ('Single Ride Full Fare', 'Single Ride Half Fare', 'LA2 Single Full', 'RA2 Single Half',
                            'RA3 UnderPayment', '*1 COURTESY ISSUED') THEN 'Single Ride'
              WHEN x.d2 IN ('31 HALF', '31 FULL', '7 DAY FULL', 'ALL DAY FULL', '7 DAY HALF', 'ALL DAY HALF',
                            '31 DAY S PASS', 'Comp Day Pass', 'Comp 31 day pass', 'LA1 Issue Day Pass',
                            'RA1 Issue Day Half') THEN 'Period Pass'
              WHEN x.d2 IN ('10 TRIP FULL', 'Comp 10 Trip Pass') THEN 'Stored Ride' END AS pass_type
  FROM used_d u
  LEFT JOIN (SELECT code, MAX(description) AS rdesc FROM rules GROUP BY 1) r ON u.description = r.code
  CROSS JOIN LATERAL (SELECT CASE WHEN u.type LIKE '%118%' THEN 'Transfer' ELSE r.rdesc END AS d2) x),
pm AS (
  SELECT service_day, pass_type, COUNT(*) AS number_of_passes,
         CAST(SUM(COUNT(*)) OVER (PARTITION BY service_day) AS BIGINT) AS daily_sum,
         COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY service_day) AS share
  FROM pm0 WHERE pass_type IS NOT NULL GROUP BY 1, 2)
"""


def _pass_mix(spark, sf_dir):
    from fareshift.operators.summary import pass_mix
    from fareshift.plans.period import used_transactions
    td, _, rules = _inputs(spark, sf_dir)
    return pass_mix(used_transactions(td, rules), rules)


@register("pass_mix", sql("SELECT * FROM pm", PASS_SQL))
def pass_mix_q(spark, sf_dir):
    """DOM-11 / CLS-3 / FIX-2 / WIN-2 / WIN-3: pass-type count and share of the day."""
    return _pass_mix(spark, sf_dir)


@register("pass_mix_wide", sql("""
SELECT service_day,
       CAST(SUM(number_of_passes) FILTER (WHERE pass_type = 'Single Ride') AS BIGINT) AS single_ride,
       CAST(SUM(number_of_passes) FILTER (WHERE pass_type = 'Period Pass') AS BIGINT) AS period_pass,
       CAST(SUM(number_of_passes) FILTER (WHERE pass_type = 'Stored Ride') AS BIGINT) AS stored_ride,
       CAST(SUM(number_of_passes) FILTER (WHERE pass_type = 'Free Key') AS BIGINT) AS free_key
FROM pm GROUP BY 1""", PASS_SQL))
def pass_mix_wide_q(spark, sf_dir):
    """RSH-2: pass types as columns per day."""
    from fareshift.operators.summary import pass_mix_wide
    return pass_mix_wide(_pass_mix(spark, sf_dir))


# ---------------------------------------------------------------- readers and positions

@register("transactions_from_report", sql("""
SELECT upper('TRANSACTION DETAIL ' || monthname(txn_time) || ' ' || CAST(year(txn_time) AS VARCHAR) || '.csv') AS file,
       type, date_trunc('second', txn_time) AS txn_time, vehicle_id, route, '1' AS run, '0' AS driver, description,
       CAST(1.75 AS DOUBLE) AS value, CAST(1.75 AS DOUBLE) AS amount,
       CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS DOUBLE) AS latitude,
       upper(monthname(txn_time)) || ' ' || CAST(year(txn_time) AS VARCHAR) AS period
FROM td"""))
def transactions_from_report(spark, sf_dir):
    """SRC-8 / SRC-3 / DT-1 / PRJ-3: parse transaction-detail text (header by name, footer skipped)."""
    from fareshift.sources.reports import parse_transactions, with_period
    return with_period(parse_transactions(roles.td_report_lines(spark, sf_dir)))


@register("rules_from_report", sql("""
SELECT DISTINCT 'MONTHLY SUMMARY ' || monthname(txn_time) || ' ' || CAST(year(txn_time) AS VARCHAR) || '.txt' AS file,
       description AS code, 'Fare ' || description || ', full' AS description
FROM td"""))
def rules_from_report(spark, sf_dir):
    """SRC-5 / WIN-1 / RSH-1 / RSH-4 / STR-4: rules text sliced between markers, tokens paired."""
    from fareshift.sources.reports import parse_rules
    return parse_rules(roles.rules_report_lines(spark, sf_dir))


@register("routesum_from_report", sql("""
SELECT 'EVENT SUMMARY (' || monthname(txn_time) || ' ' || CAST(year(txn_time) AS VARCHAR) || ').txt' AS file,
       route, COUNT(*) AS ridership, substring(monthname(txn_time), 1, 3) || ' ' || CAST(year(txn_time) AS VARCHAR) AS period
FROM td GROUP BY 1, 2, 4"""))
def routesum_from_report(spark, sf_dir):
    """SRC-6 / SRC-3 / WIN-4: route rows between 'Ridership By Route' and TOTAL, three-letter period."""
    from fareshift.sources.reports import parse_routesum, with_period
    return with_period(parse_routesum(roles.routesum_report_lines(spark, sf_dir)), letters=3)


@register("rules_v1_from_report", sql("""
SELECT file, MAX(tok) FILTER (WHERE i % 2 = 0) AS code, MAX(tok) FILTER (WHERE i % 2 = 1) AS description
FROM (SELECT file, tok, row_number() OVER (PARTITION BY file ORDER BY code, k) - 1 AS i
      FROM (SELECT DISTINCT 'MONTHLY SUMMARY ' || monthname(txn_time) || ' ' || CAST(year(txn_time) AS VARCHAR) || '.txt'
                     AS file, description AS code FROM td) f
      CROSS JOIN LATERAL (VALUES (1, f.code), (2, 'Fare ' || substring(f.code, 1, length(f.code) - 1)), (3, 'full')) v(k, tok))
GROUP BY file, i // 2"""))
def rules_v1_from_report(spark, sf_dir):
    """SRC-4: the first rules layout, split on ',' and stripped of outer characters (commas in a description break it up)."""
    from fareshift.sources.reports import parse_rules
    return parse_rules(roles.rules_report_lines(spark, sf_dir), version=1)


@register("reconcile_by_month", sql("""
SELECT m.year, m.month, m.route, m.ridership_td, r.ridership, m.ridership_td - r.ridership AS ridership_diff,
       round_even((m.ridership_td - r.ridership) / r.ridership * 100, 3) AS percent_disagree
FROM (SELECT CAST(year(txn_time) AS INTEGER) AS year, substring(monthname(txn_time), 1, 3) AS month, route, COUNT(*) AS ridership_td
      FROM td GROUP BY 1, 2, 3) m
JOIN (SELECT CAST(year(txn_time) AS INTEGER) AS year, substring(monthname(txn_time), 1, 3) AS month, route, COUNT(*) AS ridership
      FROM td GROUP BY 1, 2, 3) r ON m.year = r.year AND m.month = r.month AND m.route = r.route"""))
def reconcile_by_month_q(spark, sf_dir):
    """SET-1 / SRC-2 / DOM-1: counts under each month's own rules against that month's RouteSum, both from report text."""
    from fareshift.operators.ridership import reconcile_by_month
    from fareshift.sources import reports
    rules = reports.with_month_key(reports.with_period(reports.parse_rules(roles.rules_report_lines(spark, sf_dir))))
    routesum = reports.with_month_key(reports.with_period(
        reports.parse_routesum(roles.routesum_report_lines(spark, sf_dir)), letters=3))
    return reconcile_by_month(roles.td(spark, sf_dir), rules, routesum)


@register("reconcile_by_month_outer", sql("""
SELECT m.year, m.month, m.route, m.ridership_td, r.ridership, m.ridership_td - r.ridership AS ridership_diff,
       round_even((m.ridership_td - r.ridership) / r.ridership * 100, 3) AS percent_disagree
FROM (SELECT CAST(year(txn_time) AS INTEGER) AS year, substring(monthname(txn_time), 1, 3) AS month, route, COUNT(*) AS ridership_td
      FROM td GROUP BY 1, 2, 3) m
LEFT JOIN (SELECT CAST(year(txn_time) AS INTEGER) AS year, substring(monthname(txn_time), 1, 3) AS month, route, COUNT(*) AS ridership
           FROM td WHERE route <> '25' GROUP BY 1, 2, 3) r ON m.year = r.year AND m.month = r.month AND m.route = r.route"""))
def reconcile_by_month_outer_q(spark, sf_dir):
    """DOM-1 as the runs write it: routes that RouteSum does not list (here '25') keep their row."""
    from fareshift.operators.ridership import reconcile_by_month
    from fareshift.sources import reports
    rules = reports.with_month_key(reports.with_period(reports.parse_rules(roles.rules_report_lines(spark, sf_dir))))
    routesum = reports.with_month_key(reports.with_period(
        reports.parse_routesum(roles.routesum_report_lines(spark, sf_dir)), letters=3)).where("route <> '25'")
    return reconcile_by_month(roles.td(spark, sf_dir), rules, routesum, how="left")


@register("iso_times", sql("SELECT txn_id, date_trunc('second', txn_time) AS iso_time FROM td"))
def iso_times(spark, sf_dir):
    """DT-2: ISO text parsed to wall-clock time."""
    from fareshift.functions.timefns import parse_iso_timestamp
    t = roles.td(spark, sf_dir).select("txn_id", F.date_format("txn_time", "yyyy-MM-dd HH:mm:ss").alias("text"))
    return t.select("txn_id", parse_iso_timestamp("text").alias("iso_time"))


@register("route_equality", sql("SELECT service_day, COUNT(*) AS n FROM used_d WHERE route = '901' GROUP BY 1"))
def route_equality(spark, sf_dir):
    """FLT-3: one route by equality, counted by service day."""
    from fareshift.operators.ridership import count_by
    from fareshift.plans.period import used_transactions
    td, _, rules = _inputs(spark, sf_dir)
    return count_by(used_transactions(td, rules).where(F.col("route") == "901"), "service_day")


@register("report_ordered", sql("""
SELECT service_type, local_route, COUNT(*) AS ridership FROM typed WHERE local_route <> '90' GROUP BY 1, 2
ORDER BY service_type DESC, local_route"""))
def report_ordered(spark, sf_dir):
    """SRT-2: local ridership in report order (service type as text, descending)."""
    from fareshift.operators.summary import local_counts, order_for_report
    return order_for_report(local_counts(_located(spark, sf_dir), ["service_type", "local_route"]), "local_route")


@register("daily_totals_from_report", sql("""
SELECT 'Local Route 90 ' || monthname(service_day) || ' ' || CAST(year(service_day) AS VARCHAR) || '.txt' AS file,
       service_day, ridership
FROM daily_totals"""))
def daily_totals_from_report(spark, sf_dir):
    """SRC-7 / DT-1 date only: daily rows kept where the date parses."""
    from fareshift.sources.reports import parse_daily_totals
    return parse_daily_totals(roles.daily_report_lines(spark, sf_dir))


POS_SQL = """
vmh0 AS (
  SELECT event_id AS avl_history_id, ts AS time,
         CASE event_id % 5 WHEN 0 THEN '90' WHEN 1 THEN '901' WHEN 2 THEN '902' WHEN 3 THEN '8' ELSE '25' END AS route,
         user_id AS vehicle_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS trip, event_id % 40 AS stop_id,
         CASE event_id % 2 WHEN 0 THEN 'I' ELSE 'O' END AS inbound_outbound,
         CAST(event_id % 4 AS INTEGER) AS boards, CAST(event_id % 3 AS INTEGER) AS alights
  FROM events WHERE event_type IN ('view', 'click', 'error')),
vmh AS (SELECT * FROM vmh0 UNION ALL SELECT * FROM vmh0 WHERE avl_history_id % 7 = 0),
avl AS (
  SELECT event_id AS avl_history_id, value AS latitude, -value AS longitude,
         CASE CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) % 10 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 2 END AS gps_status
  FROM events WHERE event_type IN ('view', 'click')),
both_ AS (
  SELECT a.avl_history_id, a.time AS pos_time, CAST(a.vehicle_id AS VARCHAR) AS vehicle_id, a.route, a.stop_id,
         a.inbound_outbound, a.trip, a.boards, a.alights, b.latitude, b.longitude, b.gps_status, a.vehicle_id AS number
  FROM vmh a LEFT JOIN avl b ON a.avl_history_id = b.avl_history_id
  WHERE a.time >= TIMESTAMP '2023-12-31 03:00:00' AND a.time < TIMESTAMP '2024-02-01 03:00:00')
"""


@register("positions_union", sql("""
SELECT * EXCLUDE (number) FROM both_ WHERE route LIKE '9%'
UNION
SELECT * EXCLUDE (number) FROM both_ WHERE number >= 100 AND number <= 129""", POS_SQL))
def positions_union(spark, sf_dir):
    """SRC-9 / JOI-4 / SET-3 / FLT-4: messages left-join positions; route '9%' OR fleet range; distinct over all columns."""
    from fareshift.sources.positions import read_positions
    return read_positions(roles.vmh(spark, sf_dir), roles.avl(spark, sf_dir), "2023-12-31", "2024-01-31",
                          route_like="9%", vehicle_range=(100, 129))


# ---------------------------------------------------------------- files, sinks and stores

def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    from fareshift.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/fareshift/{name}-{uuid.uuid4().hex}"


JAN_SQL = """
jan AS (SELECT * FROM td WHERE year(txn_time) = 2024 AND month(txn_time) = 1),
jan_days AS (SELECT * FROM daily_totals WHERE year(service_day) = 2024 AND month(service_day) = 1)
"""


@register("report_files", sql("""
SELECT kind, file, n_lines FROM (
  SELECT 'transactions' AS kind, 'TRANSACTION DETAIL JANUARY 2024.CSV' AS file, COUNT(*) + 4 AS n_lines FROM jan
  UNION ALL SELECT 'rules', 'MONTHLY SUMMARY January 2024.txt', COUNT(DISTINCT description) + 3 FROM jan
  UNION ALL SELECT 'routesum', 'EVENT SUMMARY (January 2024).txt', COUNT(DISTINCT route) + 4 FROM jan
  UNION ALL SELECT 'daily', 'Local Route 90 January 2024.txt', COUNT(*) + 4 FROM jan_days)""", JAN_SQL))
def report_files_q(spark, sf_dir):
    """SRC-1 / SRC-2: report files found by kind, month (any case) and year in their names; their printed lines."""
    from fareshift.sources.reports import KIND_MARKERS, numbered_lines, report_files
    folder, out = roles.report_folder(spark, sf_dir), None
    for kind in KIND_MARKERS:
        found = report_files(spark, folder, kind, period="JANuary", year=2024)
        lines = found.withColumnRenamed("value", "line") if kind == "transactions" else numbered_lines(found)
        n = lines.where(F.trim("line") != "").groupBy(F.lit(kind).alias("kind"), "file").agg(F.count(F.lit(1)).alias("n_lines"))
        out = n if out is None else out.unionByName(n)
    return out


@register("transactions_from_files", sql("""
SELECT 'TRANSACTION DETAIL JANUARY 2024.CSV' AS file, type, date_trunc('second', txn_time) AS txn_time, vehicle_id, route,
       '1' AS run, '0' AS driver, description, CAST(1.75 AS DOUBLE) AS value, CAST(1.75 AS DOUBLE) AS amount,
       CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS DOUBLE) AS latitude, 'JANUARY 2024' AS period
FROM jan""", JAN_SQL))
def transactions_from_files(spark, sf_dir):
    """SRC-1 / SRC-2 / SRC-8: one month's transaction detail, read from the folder of all reports."""
    from fareshift.sources.reports import read_transactions
    return read_transactions(spark, roles.report_folder(spark, sf_dir), period="January", year="2024")


@register("summary_read_back", sql("SELECT service_day, ridership FROM daily_totals"))
def summary_read_back(spark, sf_dir):
    """SNK-1 / SRC-11: a summary written as CSV and read as a delimited file with its schema."""
    from fareshift.sources.reports import read_delimited
    from fareshift.sources.sinks import write_summary
    path = _folder(spark, "summary")
    write_summary(roles.daily_totals(spark, sf_dir), path, order_by=("service_day",))
    return read_delimited(spark, path, "service_day date, ridership long")


@register("summary_by_period", sql("""
SELECT CASE WHEN service_day < DATE '2024-01-16' THEN '2024-01-01_2024-01-16' ELSE '2024-01-16_2024-02-01' END AS period,
       service_type, local_route, COUNT(*) AS ridership
FROM typed WHERE local_route <> '90' GROUP BY 1, 2, 3"""))
def summary_by_period(spark, sf_dir):
    """SNK-2: two periods appended to one folder, the first one written twice; each row says its period."""
    from fareshift.operators.summary import local_counts
    from fareshift.sources.sinks import write_summary
    path = _folder(spark, "periods")
    matched = _located(spark, sf_dir)
    first, second = matched.where("service_day < DATE'2024-01-16'"), matched.where("service_day >= DATE'2024-01-16'")
    for part, period in ((first, "2024-01-01_2024-01-16"), (second, "2024-01-16_2024-02-01"), (first, "2024-01-01_2024-01-16")):
        write_summary(local_counts(part, ["service_type", "local_route"]), path, mode="append",
                      order_by=(F.col("service_type").desc(), "local_route"), period=period)
    return spark.read.csv(path, header=True, schema="service_type string, local_route string, ridership long, period string")


def _stored_counts(spark, sf_dir) -> DataFrame:
    """Daily counts of two half-months, matched one after the other; the second one is run twice."""
    from fareshift.operators.quality import quality_flags
    from fareshift.plans.season import daily_counts, store_daily_counts
    path, counts = _folder(spark, "season-store"), None
    for start, end in (("2023-12-31", "2024-01-16"), ("2024-01-16", "2024-02-01"), ("2024-01-16", "2024-02-01")):
        m = _matched(spark, sf_dir, position_cols=("latitude", "gps_status"), columns=(), start=start, end=end)
        counts = store_daily_counts(daily_counts(quality_flags(m), start, end), path)
    return counts.where("n_rows > 0")


@register("season_increments", sql("""
SELECT CAST(year(service_day) AS INTEGER) AS year, monthname(service_day) AS month, service_type,
       CAST(SUM(ridership) AS BIGINT) AS total_ridership, COUNT(*) AS service_days, round_even(AVG(ridership), 0) AS average_daily_ridership
FROM (SELECT service_day, service_type, COUNT(*) AS ridership FROM typed WHERE local_route <> '90' GROUP BY 1, 2) GROUP BY 1, 2, 3"""))
def season_increments(spark, sf_dir):
    """DOM-6 / AGG-5 over stored daily counts: later days are added without another match of the earlier ones."""
    from fareshift.operators.summary import daily_from_counts, service_summary, with_month
    daily = daily_from_counts(_stored_counts(spark, sf_dir))
    return service_summary(with_month(daily), ["year", "month", "service_type"])


@register("season_increments_quality", sql("SELECT * FROM qbm_pct", FLAGS_SQL, QBM_SQL))
def season_increments_quality(spark, sf_dir):
    """QLT-4 by month from stored daily counts, over the whole store."""
    from fareshift.operators.quality import shares_from_counts
    from fareshift.operators.summary import with_month
    return shares_from_counts(with_month(_stored_counts(spark, sf_dir)), ["year", "month"])
