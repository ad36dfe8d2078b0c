"""Byte-level BPE encoding and decoding with overlapping chunks.

The rank file and the pre-token pattern are parameters; nothing is trained.
Texts up to ``CHUNK`` characters are encoded where they lie. A longer text is
cut into chunks of ``CHUNK`` characters that overlap by ``OVERLAP``:

1. chunks are pre-tokenised in parallel, wherever their rows land;
2. neighbours are stitched at the first position in their overlap where both
   have a pre-token boundary. A match of the pattern depends only on what
   follows its start, so from a shared boundary both go on alike. The last
   pre-tokens of a chunk may depend on text beyond its end and are not trusted, nor is a
   boundary after white space, whose run would be taken as one where a piece ends in it;
3. each piece between two stitches is encoded in parallel, and the ids are
   joined in order.

Where two neighbours share no boundary (a run longer than the overlap), the
text is pre-tokenised as one chunk instead.

Decoding concatenates the bytes of the ids' tokens.

Defined results: a null or empty text has no ids and decodes to no bytes;
repeated rows each get their row; other columns are dropped. An id that the
vocabulary lacks is an error.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareshift.llm.common import materialize, small_side, sub_batches

CHUNK = 16_384
OVERLAP = 1_024
MARGIN = 64  # characters at a chunk's end whose pre-tokens are not trusted


def _ranks(path: str) -> dict[bytes, int]:
    """Read once a task and not kept: a worker lives on, and other stages need its memory."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(path: str, pattern: str):
    """Encodes each pre-token of a text separately, without special tokens."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path),
                             special_tokens={}).encode_ordinary


def boundaries(pattern, text: str, start: int = 0) -> list[int]:
    """Starts of the pre-tokens of ``text`` from ``start``, and its length."""
    return [m.start() for m in pattern.finditer(text, start)] + [len(text)]


def _encode_whole(path: str, pattern: str):
    def encode(batches):
        ids_of = _encoder(path, pattern)
        for b in sub_batches(batches, 2 << 20):
            ids = pa.array([ids_of(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], names=["id", "ids"])
    return encode


def _edges(pattern: str):
    """Per chunk: the pre-token starts in the overlaps with its neighbours, as
    positions in the whole text."""
    def edges(batches):
        compiled = regex.compile(pattern)
        for b in sub_batches(batches):
            heads, tails = [], []
            for text, at, last in zip(b.column("chunk").to_pylist(), b.column("at").to_pylist(),
                                      b.column("last").to_pylist(), strict=True):
                starts = boundaries(compiled, text)[:-1]
                trusted = len(text) - MARGIN
                heads.append([at + s for s in starts if at and s < OVERLAP])
                tails.append([] if last else [at + s for s, e in zip(starts, starts[1:], strict=False)
                                              if CHUNK <= s and e <= trusted and not text[s - 1].isspace()])
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("no"), b.column("last"), pa.array(heads, pa.list_(pa.int64())),
                 pa.array(tails, pa.list_(pa.int64()))], names=["row", "no", "last", "head", "tail"])
    return edges


def _encode_piece(path: str, pattern: str):
    """Ids of a chunk from its own stitch up to the next one. Cut at a boundary,
    a piece has the pre-tokens it has within the whole text: its last one can't
    reach further, and it does not end in white space."""
    def encode(batches):
        ids_of = _encoder(path, pattern)
        for b in sub_batches(batches, 2 << 20):
            ids = [ids_of(text[lo - at:None if hi is None else hi - at]) for text, at, lo, hi in zip(
                *[b.column(c).to_pylist() for c in ("chunk", "at", "lo", "hi")], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("no"), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["row", "no", "ids"])
    return encode


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id_col, ids): the ids of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.length("text") > CHUNK + OVERLAP
    short_ids = d.where(~long).mapInArrow(_encode_whole(rank_path, pattern), f"id {kind}, ids array<int>")

    # A long text goes by its content: equal texts share the work, repeated ids stay apart.
    d_long = d.where(long).withColumn("row", F.sha2(F.col("text").cast("binary"), 256))
    n = F.ceil((F.length("text") - OVERLAP) / F.lit(float(CHUNK))).cast("int")
    chunks = (d_long.select("row", "text", (n - 1).alias("final"), F.explode(F.sequence(F.lit(0), n - 1)).alias("no"))
              .select("row", "no", (F.col("no").cast("long") * CHUNK).alias("at"),
                      (F.col("no") == F.col("final")).alias("last"),
                      F.expr(f"substring(text, no * {CHUNK} + 1, {CHUNK + OVERLAP})").alias("chunk"))
              .dropDuplicates(["row", "no"]))  # also deals the chunks out over all tasks
    chunks = materialize(chunks, "bpe-chunks")
    per_text = Window.partitionBy("row").orderBy("no")
    cuts = (chunks.mapInArrow(_edges(pattern), "row string, no int, last boolean, head array<long>, tail array<long>")
            .withColumn("hi", F.array_min(F.array_intersect("tail", F.lead("head").over(per_text))))
            .withColumn("lo", F.coalesce(F.lag("hi").over(per_text), F.lit(0).cast("long")))
            .withColumn("lost", F.max(~F.col("last") & F.col("hi").isNull()).over(Window.partitionBy("row")))
            .select("row", "no", "lo", "hi", "lost"))
    cuts = materialize(cuts, "bpe-cuts")
    pieces = (chunks.join(small_side(cuts.where(~F.col("lost"))), ["row", "no"]).select("row", "no", "at", "chunk", "lo", "hi")
              .mapInArrow(_encode_piece(rank_path, pattern), "row string, no int, ids array<int>"))
    stitched = (pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("parts"))
                .select("row", F.flatten("parts.ids").alias("ids")))
    long_ids = d_long.select("id", "row").join(stitched, "row").select("id", "ids")

    # Rare: texts with a run longer than the overlap. Known by their digests, so the texts stay where they are.
    lost = materialize(cuts.where("lost").select("row").distinct(), "bpe-lost")
    lost_ids = (d_long.join(small_side(lost), "row", "left_semi").select("id", "text")
                .mapInArrow(_encode_whole(rank_path, pattern), f"id {kind}, ids array<int>"))
    return short_ids.unionByName(long_ids).unionByName(lost_ids).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, decoded, keep...): the concatenated bytes of every row's ids."""
    kept = [c for c in keep if c != id_col]
    df = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"),
                        *[F.col(c).alias(f"k_{c}") for c in kept if c != ids_col])
    names = [c for c in df.columns if c != "ids" or ids_col in kept]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)

    def decode(batches):
        token = {i: b for b, i in _ranks(rank_path).items()}.__getitem__
        for b in sub_batches(batches, 2 << 20):
            flat, ends = b.column("ids").flatten().to_numpy(), np.cumsum(
                [0, *pc.list_value_length(b.column("ids")).fill_null(0).to_pylist()])
            out = [b"".join(map(token, flat[i:j].tolist())) for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(out, pa.binary())],
                                             names=[*names, "decoded"])

    out = df.mapInArrow(decode, f"{schema}, decoded binary")
    return out.select(F.col("id").alias(id_col), "decoded",
                      *[F.col("ids" if c == ids_col else f"k_{c}").alias(c) for c in kept])


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
