"""Sinks (SNK-1, SNK-2), and report text as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareshift.operators.asof import bucket_column, time_bucket


def write_summary(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = True,
                  order_by: Sequence[str | Column] = (), period: str | None = None) -> None:
    """SNK-1 / SNK-2: write a summary as CSV with a header, its rows in ``order_by``.

    Summaries are a few rows (per day, type or route), so one file is
    written; only the writing is one task, what makes the rows keeps its own.
    Several tables go to one folder each, never mixed in one file.

    ``period`` says what the rows are of: the folder is partitioned by a column of that name, so reading it
    back gives the column. With ``mode="append"`` the rows replace those of the same period (a dynamic partition
    overwrite) and leave other periods alone: a run done twice counts once. Without a period,
    ``append`` adds to the folder whatever is in it.
    """
    out = df.repartition(1) if single_file else df
    order = list(order_by)
    if period is not None:
        if "period" in df.columns:
            raise ValueError("the summary has a column of its own called 'period'")
        out, order = out.withColumn("period", F.lit(period)), ["period", *order]
    if order:
        out = out.sortWithinPartitions(*order) if single_file else out.orderBy(*order)
    w = out.write.option("header", "true")
    if period is None:
        w.mode(mode).csv(path)
    elif mode == "append":
        w.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").csv(path)
    else:
        w.mode(mode).option("partitionOverwriteMode", "static").partitionBy("period").csv(path)


def write_detail(df: DataFrame, path: str, partition_by: str = "service_day", mode: str = "overwrite") -> None:
    """Detail rows (e.g. the matched table) as Parquet partitioned by day. Rows are dealt by day first
    (days of many rows are split, small ones share a task), so a day gets few files."""
    df.hint("rebalance", partition_by).write.mode(mode).partitionBy(partition_by).parquet(path)


def write_bucketed(df: DataFrame, table: str, by: Sequence[str], time_col: str, *, buckets: int,
                   bucket_unit: str = "minute", partition_by: str | None = None, mode: str = "overwrite",
                   path: str | None = None) -> None:
    """Rows (e.g. positions with their service day) as a table laid out for ``asof_join(stored=buckets)``.

    The table is bucketed by the keys and the time's bucket (``bucket_column``), the way the as-of
    join deals its rows, so a hot key is spread over the files too. Later months are
    added with ``mode="append"``; ``partition_by`` (e.g. a month column) lets a run read its own part.
    One task writes one bucket's file (per partition).
    """
    column = bucket_column(time_col)
    out = df.withColumn(column, time_bucket(F.col(time_col), bucket_unit))
    w = (out.repartition(buckets, *by, column).write.mode(mode).format("parquet")
         .bucketBy(buckets, *by, column).sortBy(*by, column, time_col))
    if partition_by:
        w = w.partitionBy(partition_by)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)


def write_report_files(lines: DataFrame, directory: str) -> None:
    """(file, line_no, line) rows as one text file per name in ``directory``, lines in order.

    One task writes a file; the files are written below a folder of their own and then renamed.
    """
    spark = lines.sparkSession
    work = f"{directory.rstrip('/')}/_printed"
    (lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "line")
     .write.mode("overwrite").partitionBy("file").text(work))
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(work).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.globStatus(path(f"{work}/file=*")):
        name = folder.getPath().getName().removeprefix("file=")
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)
        for part in fs.globStatus(path(f"{folder.getPath()}/part-*")):
            fs.rename(part.getPath(), path(directory, name))
    fs.delete(path(work), True)
