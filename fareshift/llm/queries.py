"""The registered queries of the training-data operators: each applies one
operator, with production parameters, to its whole table and derives the
contract's columns from the operator's output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareshift.llm import (bpe, decontam, fill_middle, kneser_ney, langid, line_dedup, ngram_join, packing, quality,
                           resample, secrets, sharding, sql, topk)
from fareshift.llm.common import id_fold, materialize, table, work_path

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(id_fold(F.col("doc_id"), 3) != 1))
    found = langid.identify(docs, model)
    return found.select("doc_id", (id_fold(F.col("doc_id"), 3) == 1).alias("held_out"),
                        F.col("nearest").alias("lang_pred"), "score", F.col("lang").alias("lang_or_rejected"))


QUALITY_CUT = 0.3


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(quality.statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    labels = table(spark, sf_dir, "labels").where(id_fold(F.col("doc_id"), 5) != 0)
    scored = quality.predict(stats, quality.fit(stats, labels))
    return scored.select("doc_id", (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    digests = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                             F.sha2(bpe.ids_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"))
    decoded = bpe.decode_documents(digests, ranks, keep=("n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = (sharding.text_order(F.col("lang")), sharding.number_order(F.col("n_chars")))
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 40, dims)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.fit(docs.where(id_fold(F.col("doc_id"), 7) != 2), order=3)
    return kneser_ney.score(docs, model).select(
        "doc_id", (id_fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(model["N"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def _span_text(findings, kinds: list[str]):
    """kind:start:end of the given kinds by start, then kind as listed."""
    listed = F.array(*[F.lit(k) for k in kinds])
    order = F.filter(findings, lambda f: F.array_contains(listed, f["kind"]))
    order = F.array_sort(F.transform(order, lambda f: F.struct(
        f["start"].alias("start"), F.array_position(listed, f["kind"]).alias("k"), f["end"].alias("end"),
        f["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda f: F.concat_ws(
        ":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_versions(table(spark, sf_dir, "documents"), work_path(spark, "secret-ledger"),
                                  path_col="doc_id")
    base = [r.kind for r in secrets.BASE_RULES]
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(_span_text(F.col("findings"), base).cast("binary"), 256).alias("base_sha256"),
        _span_text(F.col("findings"), [r.kind for r in secrets.RULES]).alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.col("hit").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("hit") > 0).alias("contaminated"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(fill_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


WORD_IDS = "word_bpe_49k.json"


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_IDS))
    # Only the ids' digest is carried on.
    placed = packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op1_language": op1_language, "op2_quality": op2_quality,
           "op3_ngram_jaccard": op3_ngram_jaccard, "op4_bpe": op4_bpe, "op5_kd_shards": op5_kd_shards,
           "op6_kneser_ney": op6_kneser_ney, "op7_secret_scan": op7_secret_scan, "op8_line_dedup": op8_line_dedup,
           "op9_decontaminate": op9_decontaminate, "op10_topk": op10_topk,
           "op11_fill_middle": op11_fill_middle, "op12_resample": op12_resample, "op13_packing": op13_packing}
ORACLES: dict[str, str] = sql.ORACLES
