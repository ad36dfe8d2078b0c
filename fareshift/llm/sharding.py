"""Shards of near-equal bytes by a k-d tree over document metadata.

The tree starts with all rows and the number of leaves that the target size
asks for. Every node is split along its widest dimension (its spread over that of
the whole table) at a weighted median: the left half of its leaves gets its share of
the node's bytes. All nodes of a level are split together: their rows are dealt by
ranges of node and value, summed up by range, and each row's running sum in its node says on
which side of the median it lies. So a level takes the same few jobs however many
nodes it has, and the cut is exact to one row.
Rows alike along the dimension are ordered by the crc32 of their text and the id, so a cut can go through any number
of them. The driver sees one row of sums a node.

Equal texts share their place in that order wherever they share the metadata;
they are cut apart only where a leaf must end among them.

Slots number the rows of a shard without gaps: rows are dealt into parts of bounded
size by a hash, numbered within the part, and the parts' counts added up.

Defined results: a null text has no bytes but still ``OVERHEAD``; null metadata sorts
first; rows alike in id, text and metadata get one shard; with fewer rows than
shards some shards stay empty; no rows give no rows. Other columns are dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareshift.llm.common import discard, materialize, partitions_for, small_side

OVERHEAD = 16
RANGE_ROWS = 100_000
PART_ROWS = 20_000


def text_order(s: Column) -> Column:
    """A long that orders strings by their first seven bytes; -1 for null."""
    head = F.rpad(F.hex(F.substring(F.encode(s, "UTF-8"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1).cast("long"))


def number_order(x: Column) -> Column:
    return F.coalesce(x.cast("long"), F.lit(-1).cast("long"))


def _halved(rows: DataFrame, jobs: DataFrame, total: int) -> DataFrame:
    """The rows (id, size, crc, tie, d, node) of the nodes in ``jobs`` (node, dim, goal, left, right), each in
    the left node or the right one.

    Rows are dealt by ranges of (node, value, tie, id); a row's bytes and all before it in its node are a running sum in
    its range plus the sums of the ranges before. The cut is the weighted median, to a row; rows alike
    in all of that stay together.
    """
    order = ["x", "tie", "id"]
    keyed = rows.join(F.broadcast(jobs), "node").withColumn("x", F.element_at("d", F.col("dim") + 1))
    ranged = materialize(keyed.repartitionByRange(partitions_for(total, RANGE_ROWS), "node", *order)
                         .withColumn("part", F.spark_partition_id()), "shard-ranges")
    before = Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = materialize(ranged.groupBy("part", "node").agg(F.sum("size").alias("s"))
                        .select("part", "node", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("ahead")), "shard-ahead")
    own = Window.partitionBy("part", "node").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranged.join(small_side(ahead), ["part", "node"]).withColumn("upto", F.col("ahead") + F.sum("size").over(own))
    goes_left = 2 * F.col("upto") - F.col("size") <= 2 * F.col("goal")
    out = materialize(running.select("id", "size", "crc", "tie", "d", F.when(goes_left, F.col("left")).otherwise(F.col("right"))
                                     .alias("node")), "shard-halves")
    discard(ranged, ahead)
    return out


def kd_tree(rows: DataFrame, dims: int, shards: int) -> DataFrame:
    """``rows`` (id, size, crc, tie, d: array of the dimensions; a written table, used up) with their ``shard``.

    A node's ``shards`` leaves are halved as long as there are two. The driver sees a row of sums a node
    and level.
    """
    spark = rows.sparkSession
    total = rows.count()
    stats = [F.sum("size").alias("size"), *[f(F.col("d")[i]).alias(f"{k}{i}") for i in range(dims) for k, f in
                                            (("lo", F.min), ("hi", F.max))]]
    whole = rows.agg(*stats).first()
    if not total:
        return rows.withColumn("shard", F.lit(0))
    spread = [max(1, whole[f"hi{i}"] - whole[f"lo{i}"]) for i in range(dims)]
    # A node is known by its first shard; ``leaves`` says how many follow.
    leaves, rows = {0: shards}, rows.withColumn("node", F.lit(0))
    while max(leaves.values()) > 1:
        open_nodes = [n for n, k in leaves.items() if k > 1]
        found = rows.where(F.col("node").isin(open_nodes)).groupBy("node").agg(*stats).collect()
        jobs, after = [], {n: k for n, k in leaves.items() if k == 1}
        for n in open_nodes:
            after |= {n: leaves[n] // 2, n + leaves[n] // 2: leaves[n] - leaves[n] // 2}
        for r in found:
            n, wide = r["node"], [(r[f"hi{i}"] - r[f"lo{i}"]) / spread[i] for i in range(dims)]
            jobs.append((n, int(np.argmax(wide)), r["size"] * (leaves[n] // 2) / leaves[n], n, n + leaves[n] // 2))
        if not jobs:  # every row is in a leaf; the other nodes have none
            break
        halved = _halved(rows, spark.createDataFrame(jobs, "node int, dim int, goal double, left int, right int"), total)
        done = rows.where(~F.col("node").isin(open_nodes))
        both = materialize(halved.unionByName(done.select(halved.columns)), "shard-level")
        discard(halved, *([rows] if hasattr(rows, "written") else []))
        leaves, rows = after, both
    return rows.withColumnRenamed("node", "shard")


def shard_documents(docs: DataFrame, shards: int, dimensions: tuple[Column, ...], id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row. ``dimensions`` are longs (``text_order``,
    ``number_order``)."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(raw).alias("crc"), F.array(*dimensions).alias("d"))
    tie = F.col("crc") * F.lit(1 << 30) + F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    rows = materialize(rows.withColumn("tie", tie), "shard-rows")
    shard = kd_tree(rows, len(dimensions), shards)
    parts = partitions_for(rows.count(), shards * PART_ROWS, 1)
    placed = materialize(shard.select("id", "size", "crc", "shard", "tie",
                                      F.pmod(F.xxhash64("id", "crc"), F.lit(parts)).alias("part")), "shard-placed")
    discard(rows, *([shard] if hasattr(shard, "written") else []))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
               .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("tie", "id"))
    return (placed.withColumn("number", number).join(F.broadcast(offsets) if parts * shards <= 100_000 else offsets,
                                                     ["shard", "part"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("offset") + F.col("number") - 1).cast("long").alias("slot")))
