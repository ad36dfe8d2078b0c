"""Farebox report readers (SRC-1..8) built on ``spark.read.text``.

Report layouts (inferred; no sample ships with the reference):

* rules ("MONTHLY SUMMARY"): after a line containing "Ridership is defined",
  up to the line before the first "excluded", comma-separated quoted tokens
  that alternate code, description.
* RouteSum ("EVENT SUMMARY"): after the line "Ridership By Route" a CSV
  header, then one row per route up to the first "TOTAL" line.
* daily totals ("Local" route report): the same layout keyed by a
  ``M/d/yyyy`` date; trailing summary rows are dropped because their date
  does not parse.
* transaction detail ("TRANSACTION DETAIL"): a CSV header (the line holding
  "Type" and "Date and Time"), body rows, and a footer from "Number of Tran".

The small reports are read whole (one row per file, then split into numbered
lines): each is a page or two, and their slicing needs line order. The
transaction detail, the large input, is read line by line with splittable
file reads; a body row is recognised by content (its date parses), so no line
numbers and no single-task read are needed. Columns are found by header
name, not position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareshift.functions.timefns import parse_report_date, parse_report_timestamp

# File-name markers of each report kind and the text markers
# inside the reports.
KIND_MARKERS = {
    "rules": "MONTHLY SUMMARY",
    "routesum": "EVENT SUMMARY",
    "transactions": "TRANSACTION DETAIL",
    "daily": "Local",
}
RULES_START = "Ridership is defined"
RULES_END = "excluded"
ROUTESUM_START = "Ridership By Route"
ROUTESUM_END = "TOTAL"
TD_HEADER_MARKERS = ("Type", "Date and Time")
TD_FOOTER = "Number of Tran"
TD_DROPPED = ("Direction", "Fareset", "Stop", "Trip")
TD_COLUMNS = {  # header name -> output column
    "Type": "type", "Date and Time": "txn_time", "Bus": "vehicle_id", "Route": "route", "Run": "run",
    "Driver": "driver", "Description": "description", "Value": "value", "Amount": "amount",
    "Longitude": "longitude", "Latitude": "latitude",
}
TD_TEXT = ("type", "vehicle_id", "route", "run", "driver", "description")
TD_NUMBERS = ("value", "amount", "longitude", "latitude")
PERIOD_PATTERN = r"([A-Za-z]{3,}\s\d{1,4})"

# ------------------------------------------------------------------ files


def report_files(spark: SparkSession, directory: str, kind: str, period: str | None = None,
                 year: int | str | None = None, whole: bool | None = None) -> DataFrame:
    """SRC-1 / SRC-2: read the report files of one kind from a folder.

    Files are chosen by the kind's marker in the name, then (optionally) by
    a month name (case-insensitive) and a year in the name. ``whole`` reads
    each file as one row (``value``), otherwise one row per line. Adds ``file``.
    """
    marker = KIND_MARKERS.get(kind, kind)
    whole = (kind != "transactions") if whole is None else whole
    df = (spark.read.option("pathGlobFilter", f"*{marker}*").option("recursiveFileLookup", "true")
          .text(directory, wholetext=whole))
    # the file name comes percent-encoded; decode it (a literal '+' stays '+')
    name = F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B"))
    df = df.select("value", name.alias("file"))
    if period:
        df = df.where(F.lower("file").contains(str(period).lower()))
    if year:
        df = df.where(F.col("file").contains(str(year)))
    return df


def with_period(df: DataFrame, file_col: str = "file", out: str = "period",
                pattern: str = PERIOD_PATTERN, letters: int | None = None) -> DataFrame:
    """SRC-3: label rows with the period in the file name (e.g. 'DECEMBER 1').

    ``letters=3`` keeps the first three letters of the month, and the year where the
    name has one (the RouteSum month key, 'Dec 2019').
    """
    p = F.regexp_extract(F.col(file_col), pattern, 1)
    if letters:
        p = F.concat_ws(" ", F.substring(p, 1, letters), _year(F.col(file_col)))
    return df.withColumn(out, p)


def _year(name: Column) -> Column:
    """The four-digit year in a name, null without one."""
    return F.nullif(F.regexp_extract(name, r"(?<!\d)(\d{4})(?!\d)", 1), F.lit(""))


def with_month_key(df: DataFrame, period_col: str = "period", out: str = "month", year_out: str = "year") -> DataFrame:
    """SET-1 / Q-7: a month key shared by all report kinds: 'DECEMBER 1' and
    'DECEMBER 16' (half-month transaction files) and 'Dec 2019' (route summary)
    all become 'Dec'; the year is that of the file name, or of the label, null where
    neither has one. Months are paired by key, never by list position."""
    year = _year(F.col(period_col))
    if "file" in df.columns:
        year = F.coalesce(_year(F.col("file")), year)
    year = year.try_cast("int")
    return (df.withColumn(out, F.nullif(F.initcap(F.substring(F.col(period_col), 1, 3)), F.lit("")))
            .withColumn(year_out, year))


def numbered_lines(whole: DataFrame) -> DataFrame:
    """(file, value) whole-file rows -> (file, line_no, line), line_no from 0."""
    return whole.select("file", F.posexplode(F.split(F.col("value"), r"\r?\n")).alias("line_no", "line"))


# a comma followed by an even number of quotes up to the end of the line
# is a field separator (commas inside quoted fields are not)
_CSV_SPLIT = r',(?=(?:[^"]*+"[^"]*+")*+[^"]*+$)'  # possessive: no backtracking


def _fields(line: Column) -> Column:
    """Raw CSV fields of a line (quoted commas kept): one regular-expression
    split per line. Fields are cleaned only when picked (``_clean``), so the
    array stays a plain expression that code generation computes once.
    (A ``from_csv`` per field would be rewritten by the optimizer into one CSV
    parse per extracted field.)
    """
    return F.when(line.contains('"'), F.split(line, _CSV_SPLIT)).otherwise(F.split(line, ","))


def _clean(x: Column) -> Column:
    """Trim, unquote ('""' inside quotes becomes '"'), empty -> null."""
    t = F.trim(x)
    inner = F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))
    quoted = t.startswith('"') & t.endswith('"') & (F.length(t) >= 2)
    v = F.when(quoted, inner).otherwise(t)
    return F.when(v != "", v)


def _norm(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^A-Za-z0-9]", ""))


def _place(header_norm: Column, name: str) -> Column:
    """The place of header ``name`` (matched ignoring case, spaces, dots), null without one."""
    key = "".join(ch for ch in name.lower() if ch.isalnum())
    return F.nullif(F.array_position(header_norm, F.lit(key)).cast("int"), F.lit(0))


def _pick(fields: Column, header_norm: Column, name: str) -> Column:
    """The cleaned field under header ``name``."""
    return _clean(F.try_element_at(fields, _place(header_norm, name)))


def _header_norm(fields: Column) -> Column:
    """Header names normalised for matching (computed once per file)."""
    return F.transform(fields, lambda x: _norm(F.coalesce(_clean(x), F.lit(""))))


def _count_text(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), ",", "").try_cast("long")


# ------------------------------------------------------------------ rules


def parse_rules(lines: DataFrame, version: int = 2) -> DataFrame:
    """SRC-4 / SRC-5: (file, line_no, line) of rules reports -> (file, code, description).

    The section is sliced between the markers per file; tokens are numbered
    in line order and paired alternately (code, description) (WIN-1, RSH-1,
    RSH-4). Version 2 (default) splits on '","' so commas inside a
    description survive; version 1 splits on ',' and strips each token's
    outer characters. A rules section is one report page, so the per-file
    window is small.
    """
    by_file = Window.partitionBy("file")
    sec = lines.withColumn("_start", F.min(F.when(F.col("line").contains(RULES_START), F.col("line_no")))
                           .over(by_file))
    sec = sec.withColumn("_end", F.min(F.when(F.col("line").contains(RULES_END)
                                              & (F.col("line_no") > F.col("_start")), F.col("line_no")))
                         .over(by_file))
    # blank lines are layout, not tokens (both versions skip them)
    sec = sec.where((F.col("line_no") > F.col("_start")) & (F.col("line_no") < F.col("_end"))
                    & (F.trim("line") != ""))
    if version == 2:
        tok = sec.select("file", "line_no", F.posexplode(F.split("line", '","')).alias("pos", "tok"))
        tok = tok.where(~F.col("tok").isin('""', "", '"'))
        tok = tok.withColumn("tok", F.regexp_replace("tok", '^([^"]*)"', "$1"))  # first quote only
    else:
        tok = sec.select("file", "line_no", F.posexplode(F.split("line", ",")).alias("pos", "tok"))
        tok = tok.where(F.col("tok") != '""')
        tok = tok.withColumn("tok", F.expr("substring(tok, 2, length(tok) - 2)"))
    w = Window.partitionBy("file").orderBy("line_no", "pos")
    tok = tok.withColumn("_i", F.row_number().over(w) - 1)
    return (tok.groupBy("file", (F.col("_i") / 2).cast("long").alias("_pair"))
            .agg(F.max(F.when(F.col("_i") % 2 == 0, F.col("tok"))).alias("code"),
                 F.max(F.when(F.col("_i") % 2 == 1, F.col("tok"))).alias("description"))
            .drop("_pair"))


def read_rules(spark: SparkSession, directory: str, period: str | None = None, version: int = 2,
               year: int | str | None = None) -> DataFrame:
    """SRC-4/5: rules of every matching rules report, with its period."""
    lines = numbered_lines(report_files(spark, directory, "rules", period=period, year=year))
    return with_period(parse_rules(lines, version))


# ------------------------------------------------------------------ route summary


def _summary_bounds(lines: DataFrame) -> DataFrame:
    """Mark each line with its file's 'Ridership By Route' line (``_start``),
    first 'TOTAL' line after it (``_total``) and header text (``_hline``).

    Window functions per file, no joins: these reports are read whole, one
    file per task, and are a page or two long.
    """
    by_file = Window.partitionBy("file")
    b = lines.withColumn("_start", F.min(F.when(F.col("line").contains(ROUTESUM_START), F.col("line_no")))
                         .over(by_file))
    return (b.withColumn("_total", F.min(F.when(F.col("line").contains(ROUTESUM_END)
                                                 & (F.col("line_no") > F.col("_start")), F.col("line_no")))
                         .over(by_file))
            .withColumn("_hline", F.max(F.when(F.col("line_no") == F.col("_start") + 1, F.col("line")))
                        .over(by_file)))


def _summary_section(lines: DataFrame) -> DataFrame:
    """Body lines between the header and 'TOTAL', with parsed fields and header."""
    b = _summary_bounds(lines)
    body = b.where((F.col("line_no") > F.col("_start") + 1)
                   & (F.col("_total").isNull() | (F.col("line_no") < F.col("_total")))
                   & (F.trim("line") != ""))
    return body.select("file", _fields(F.col("line")).alias("_f"),
                       _header_norm(_fields(F.col("_hline"))).alias("_hdr"))


def parse_routesum(lines: DataFrame) -> DataFrame:
    """SRC-6: (file, line_no, line) -> (file, route, ridership).

    The TOTAL line ends the section and is not a route row (``routesum_total``
    reads it as a separate control value). Token, ticket, preset and unnamed
    columns are not carried.
    """
    body = _summary_section(lines)
    return body.select("file", _pick(F.col("_f"), F.col("_hdr"), "Route").alias("route"),
                       _count_text(_pick(F.col("_f"), F.col("_hdr"), "Ridership")).alias("ridership")) \
        .where(F.col("route").isNotNull())


def routesum_total(lines: DataFrame) -> DataFrame:
    """The TOTAL row of each route summary: (file, total_ridership)."""
    row = _summary_bounds(lines).where(F.col("line_no") == F.col("_total"))
    return row.select("file", _count_text(_pick(_fields(F.col("line")), _header_norm(_fields(F.col("_hline"))),
                                                "Ridership")).alias("total_ridership"))


def read_routesum(spark: SparkSession, directory: str, period: str | None = None,
                  year: int | str | None = None) -> DataFrame:
    """SRC-6 from files, with the three-letter month key as ``period``."""
    lines = numbered_lines(report_files(spark, directory, "routesum", period=period, year=year))
    return with_period(parse_routesum(lines), letters=3)


def parse_daily_totals(lines: DataFrame) -> DataFrame:
    """SRC-7: (file, line_no, line) -> (file, service_day, ridership).

    Rows whose date does not parse (trailing totals, averages) are dropped.
    """
    body = _summary_section(lines)
    out = body.select("file", parse_report_date(_pick(F.col("_f"), F.col("_hdr"), "Date")).alias("service_day"),
                      _count_text(_pick(F.col("_f"), F.col("_hdr"), "Ridership")).alias("ridership"))
    return out.where(F.col("service_day").isNotNull())


def read_daily_totals(spark: SparkSession, directory: str, period: str | None = None,
                      year: int | str | None = None) -> DataFrame:
    lines = numbered_lines(report_files(spark, directory, "daily", period=period, year=year))
    return parse_daily_totals(lines)


# ------------------------------------------------------------------ transaction detail


HEADER_SALTS = 16


def _td_headers(lines: DataFrame) -> DataFrame:
    """One header row per report file, once for each salt.

    Every line of a file needs its header; the join is on (file, salt of the line), so a file's
    lines spread over ``HEADER_SALTS`` tasks. Headers are small, and adaptive execution broadcasts
    them where their measured size allows.
    """
    cond = F.lit(True)
    for m in TD_HEADER_MARKERS:
        cond = cond & F.col("line").contains(m)
    hdr = lines.where(cond).groupBy("file").agg(F.min("line").alias("_hline"))
    hdr = hdr.select("file", _header_norm(_fields(F.col("_hline"))).alias("_hdr"),
                     (F.size(F.split("_hline", ",")) - 1).alias("_hcommas"))
    # Where each column stands is looked up here, once a file; a line only takes its fields from there.
    places = [_place(F.col("_hdr"), header).alias(name) for header, name in TD_COLUMNS.items()]
    return hdr.select("file", F.struct(*places).alias("_at"), "_hcommas",
                      F.explode(F.sequence(F.lit(0), F.lit(HEADER_SALTS - 1))).alias("_salt"))


def _td_candidates(lines: DataFrame) -> DataFrame:
    """Non-header, non-footer lines with their fields picked by header name
    (text) and the parsed ``txn_time`` (null when the date does not parse, or
    when the file has no header line: its ``_hcommas`` is null).

    The field array and the parsed time come out of one-element generators
    (``explode``). A filter on a generator's output cannot be pushed below
    it, so the body-row filter does not copy the whole split-pick-parse chain
    into a filter (where code generation would evaluate every copy); each
    line is split once and its date parsed once.
    """
    salted = lines.withColumn("_salt", F.pmod(F.xxhash64("line"), F.lit(HEADER_SALTS)).cast("int"))
    j = salted.join(_td_headers(lines), ["file", "_salt"], "left")
    is_header = F.col("line").contains(TD_HEADER_MARKERS[0]) & F.col("line").contains(TD_HEADER_MARKERS[1])
    j = j.where(~is_header & (F.trim("line") != "") & ~F.col("line").contains(TD_FOOTER))
    j = j.select("file", "line", "_at", "_hcommas", F.explode(F.array(_fields(F.col("line")))).alias("_f"))
    picked = [_clean(F.try_element_at("_f", F.col("_at")[name])).alias(f"_txt_{name}") for name in TD_COLUMNS.values()]
    j = j.select("file", "line", "_hcommas", *picked)
    return j.select("*", F.explode(F.array(parse_report_timestamp(F.col("_txt_txn_time")))).alias("txn_time"))


def parse_transactions(lines: DataFrame) -> DataFrame:
    """SRC-8: (file, line) rows of transaction reports -> typed transactions.

    Columns are picked by header name; Direction, Fareset, Stop and Trip are
    not carried; six columns stay text (PRJ-3), amounts and coordinates are
    doubles. A body row is one whose date parses.
    """
    c = _td_candidates(lines).where(F.col("txn_time").isNotNull())
    cols = [F.col("file")]
    for name in TD_COLUMNS.values():
        if name == "txn_time":
            cols.append(F.col("txn_time"))
            continue
        v = F.col(f"_txt_{name}")
        cols.append((v.try_cast("double") if name in TD_NUMBERS else v.cast("string")).alias(name))
    return c.select(*cols)


def rejected_transactions(lines: DataFrame) -> DataFrame:
    """Per file the lines that look like data and gave no transaction: rows with at least the
    header's field count whose date does not parse, and every line of a file that has no header
    line: (file, rejected, no_header)."""
    bare = F.col("_hcommas").isNull()
    bad = _td_candidates(lines).where(F.col("txn_time").isNull()
                                      & (bare | ((F.size(F.split("line", ",")) - 1) >= F.col("_hcommas"))))
    return bad.groupBy("file").agg(F.count(F.lit(1)).alias("rejected"), F.max(bare).alias("no_header"))


def transaction_lines(spark: SparkSession, directory: str, period: str | None = None,
                      year: int | str | None = None) -> DataFrame:
    """The (file, line) rows of the matching transaction reports, read line by line (splittable)."""
    return report_files(spark, directory, "transactions", period=period, year=year, whole=False) \
        .withColumnRenamed("value", "line")


def read_transactions(spark: SparkSession, directory: str, period: str | None = None,
                      year: int | str | None = None) -> DataFrame:
    """SRC-8 from files, with the period."""
    return with_period(parse_transactions(transaction_lines(spark, directory, period, year)))


def read_delimited(spark: SparkSession, path: str, schema, header: bool = True, sep: str = ",") -> DataFrame:
    """SRC-11: a delimited file with an explicit schema (no inference)."""
    return spark.read.csv(path, schema=schema, header=header, sep=sep, mode="PERMISSIVE")
