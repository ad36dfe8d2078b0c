"""The corpus pipeline: ``documents`` through five training-data operators in turn.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
all but the last return the columns of ``documents``. ``run`` cuts the lineage after
each stage with a written table.

1. quality: rows the classifier scores below ``QUALITY_CUT`` go;
2. line_dedup: lines that match an earlier line go; a document that loses all
   its words that way goes, others keep their row, with ``n_chars`` as it is then;
3. near_duplicates: of each group of documents that link (five-word shingles, 0.8 or more)
   the one with the smallest doc_id stays, one row of it;
4. decontamination: documents with a window of ten words of a benchmark item go;
5. bpe: token ids of every text, and the digests of ids and decoded bytes.

Stages 2 to 4 know a document by its id and a 64-bit hash of id and text: rows without an id and
different texts of one id are documents of their own (without an id: after all others). Rows equal
in both lose the same lines; stage 3 keeps one of them. Empty texts pass stages 2 to 4.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareshift.llm import bpe, decontam, line_dedup, ngram_join, quality
from fareshift.llm.common import id_fold, materialize, small_side, table
from fareshift.llm.queries import QUALITY_CUT, RANKS


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc_key``, which is never null: rows without an id sort last."""
    return docs.withColumn("doc_key", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                                               F.xxhash64("doc_id", "text").alias("h")))


def _same(keyed: DataFrame, keys: DataFrame):
    return keyed["doc_key.h"].eqNullSafe(keys["key.h"]) & keyed["doc_key.id"].eqNullSafe(keys["key.id"])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(id_fold(F.col("doc_id"), 5) != 0)
    known = labels.select("doc_id").distinct()
    stats = quality.statistics(docs.join(small_side(known), "doc_id", "left_semi"))
    model = quality.fit(materialize(stats, "pipeline-statistics"), labels)
    return quality.filter_rows(docs, model, QUALITY_CUT)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    out = line_dedup.dedup_lines(_keyed(docs), id_col="doc_key", keep=others)
    emptied = (F.col("n_removed") > 0) & (F.size(decontam.words_of(F.col("text"))) == 0)
    return out.where(~emptied).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        .select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    groups = ngram_join.near_duplicates(keyed, id_col="doc_key", k=5, num=80, den=100)
    # Keys that don't stay as they are: of another's group (keep = 0), or in several rows (keep > 1).
    decided = materialize(
        groups.where("n_shingles > 0").groupBy(F.col("doc_key").alias("key"))
        .agg(F.count("*").alias("c"), F.min("component_id").alias("least"))
        .select("key", F.when(F.col("key") == F.col("least"), F.col("c")).otherwise(0).alias("keep"))
        .where("keep <> 1"), "pipeline-duplicates")
    stay = keyed.join(small_side(decided), _same(keyed, decided), "left_anti").select(docs.columns)
    several = decided.where("keep > 1")
    if several.isEmpty():
        return stay
    # One row each, the smallest by all columns, by partial minima.
    again = keyed.join(small_side(several), _same(keyed, several), "left_semi")
    again = again.groupBy("doc_key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return stay.union(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = decontam.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col="doc_key")
    gone = materialize(found.where("hit > 0").select(F.col("doc_key").alias("key")).distinct(), "pipeline-contaminated")
    return keyed.join(small_side(gone), _same(keyed, gone), "left_anti").select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    encoded = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)
    encoded = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                             F.sha2(bpe.ids_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"))
    # Written in between: a task then holds one Python worker with a vocabulary, not two.
    decoded = bpe.decode_documents(materialize(encoded, "pipeline-encoded"), ranks, keep=("ids", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "ids", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_good), ("line_dedup", drop_repeated_lines), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("bpe", tokenise)]
ORACLE_SQL = None  # SQL can't express the boosted trees and the merges; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
