"""Helpers shared by the training-data operators: table access, written
intermediate tables and id-based folds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareshift.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


#: Settings of the executions that write a table: Spark removes their shuffle files at their end, and hands
#: texts and sets to Python in batches of so many rows, which bounds the buffers on both sides.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WRITING = {FREE_SHUFFLES: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """``WRITING`` for the executions started inside; the session's settings are as before afterwards."""
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage with files every executor can read, so a lost executor
    costs only its running tasks. What was shuffled for it is given back at once.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    with writing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing will read again, also not to recompute: all that came
    from them has been written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as '')."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sub_batches(batches, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``max_bytes`` at most
    (a single row may be larger). Python work then has bounded memory whatever
    the length of the texts."""
    for batch in batches:
        pa.default_memory_pool().release_unused()  # workers live on; what the last batch took is given back
        n = batch.num_rows
        if n == 0:
            continue
        if batch.nbytes <= max_bytes:
            yield batch
            continue
        size = max(1, n * max_bytes // max(1, batch.nbytes))
        lo = 0
        while lo < n:
            piece = batch.slice(lo, size)
            while piece.num_rows > 1 and piece.nbytes > 4 * max_bytes:
                piece = batch.slice(lo, max(1, piece.num_rows // 2))
            yield piece
            lo += piece.num_rows


#: A table is broadcast up to so many bytes of values, with ``ROW_BYTES`` added for each row and collection.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 16


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """The bytes of a value: its own length for text, 8 for a number, sums for structs and arrays."""
    if isinstance(kind, T.StructType):
        size = sum((value_bytes(value[f.name], f.dataType) for f in kind), F.lit(0).cast("long"))
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(value, F.lit(ROW_BYTES).cast("long"), lambda n, x: n + value_bytes(x, kind.elementType))
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value).cast("long") + 8
    else:
        size = F.lit(8).cast("long")
    return F.coalesce(size, F.lit(8).cast("long"))


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Whether the values of ``df``, measured, take ``most`` bytes or less (``BROADCAST_BYTES`` unless given)."""
    row = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(ROW_BYTES).cast("long"))
    return (df.agg(F.sum(row)).first()[0] or 0) <= (BROADCAST_BYTES if most is None else most)


def small_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it ``is_small``; beyond that the join shuffles. For written tables, as they are read
    for the measurement."""
    return F.broadcast(df) if is_small(df) else df


def count_bytes(total: np.ndarray) -> bytes:
    """A table of counts as int32, as ``sum_counts`` takes it."""
    return np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()


def _add_counts(batches):
    total = None
    for b in batches:
        for v in b.column("counts"):
            x = np.frombuffer(v.as_py(), dtype=np.int32).astype(np.int64)
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([count_bytes(total)], pa.binary())], names=["counts"])


def sum_counts(parts: DataFrame, slots: int) -> np.ndarray:
    """The sum of the tasks' tables of ``slots`` counts (column ``counts``), added up in a tree of
    tasks; the driver gets 4 tables at most."""
    n = parts.count()
    while n > 4:
        n = -(-n // 16)
        before, parts = parts, materialize(parts.repartition(n).mapInArrow(_add_counts, "counts binary"), "counts")
        if hasattr(before, "written"):
            discard(before)
    total = np.zeros(slots, dtype=np.int64)
    for r in parts.collect():
        total += np.frombuffer(r["counts"], dtype=np.int32)
    return np.minimum(total, 2**31 - 1).astype(np.int32)


def hashed_share(id_col: Column, rows: int, total: int) -> Column:
    """Keeps about ``rows`` of ``total`` rows by a hash of their id, all if there are fewer."""
    whole = 1 << 30
    return F.pmod(F.xxhash64(id_col), F.lit(whole)) < F.lit(whole if total <= rows else whole * rows // total)


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, -(-rows // per_partition))
