"""Near-duplicate groups by an exact Jaccard join with PartEnum signatures.

A document's set holds its distinct shingles of ``k`` words; two documents link
when intersection / union >= ``num`` / ``den``. Groups are the connected
components of the links.

1. Equal sets collapse to one, known by a 64-bit digest.
2. Sizes fall into bands whose ends differ by the similarity at most, so linked
   sets lie in the same band or in neighbouring ones; every set signs in its own band
   and in the next. Within a band of largest size u, linked sets differ in at most
   d = floor(2u (den - num) / (den + num)) elements. The domain is cut into d + 1
   partitions by a hash; by the pigeonhole principle two such sets agree
   on one partition whole. A signature is band, partition and the hash of the
   set's elements there (PartEnum with second level n2 = 1, k2 = 0). No linked
   pair is lost. An empty projection signs with the size band like any other, so
   equal-size-band sets that share it are compared too.
3. Only signatures shared by different sets go on. A set is first compared with
   one leader, the smallest set of the most signatures it shares. What is
   linked merges into components. Then sets are compared with the leader of
   each signature they share with another component. For the sets that still share
   a signature with another component, an exact prefix, positional and parity filter
   on their shingles, the rarest first, picks the pairs that can link at all.
   A group of m near copies costs a few times m comparisons, not m^2: what
   merges needs no further ones, and what stays apart has shingles of its own.
4. Comparisons are exact on the sets of 64-bit shingle hashes of the whole texts. A pair first meets by sketches
   (parities of hashed classes, a 64th of the sets' size), which rule out sets that differ in too much;
   whole sets move only for the pairs that are left.

Defined results: null texts and texts without words have an empty set and link
with nothing, also not with each other; a text of fewer than k words is one shingle;
repeated rows share their component; the smallest id is taken over all rows of a
component; a row with a null id takes part and gets the smallest id of its
component (null if that has none). Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareshift.llm import tokens
from fareshift.llm.common import count_bytes, discard, materialize, small_side, sub_batches, sum_counts

U = np.uint64
SLOTS = 1 << 20  # hashed counts that order shingles by rarity


def shingle_sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text."""
    for _, _, raw, off in tokens.slices(column):
        h, wb = tokens.word_hashes(raw, off)
        s, sb = tokens.shingle_hashes(h, wb, k)
        for a, b in zip(sb, sb[1:], strict=False):
            yield np.unique(s[a:b])


def bands(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(index, largest size) of the bands in which a set of ``n`` signs. Band i ends at
    u_i; the next one starts at u_i + 1 and ends at floor((u_i + 1) den / num)."""
    i, u = 0, 0
    while True:
        u = (u + 1) * den // num
        if n <= u:
            return [(i, u), (i + 1, (u + 1) * den // num)]
        i += 1


def set_signatures(s: np.ndarray, num: int, den: int, band_of) -> np.ndarray:
    """The signatures of a sorted set; see the module's text."""
    out = []
    for i, u in band_of(len(s)):
        parts = 2 * u * (den - num) // (den + num) + 1
        seed = tokens.mix(np.array([i + 1], dtype=U))
        where = (tokens.mix(s ^ seed) % U(parts)).astype(np.int64)
        total = np.zeros(parts, dtype=U)
        np.add.at(total, where, tokens.mix(s + seed))
        out.append(tokens.mix(total ^ (seed + np.arange(parts).astype(U))))
    return np.concatenate(out)


def _key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _describe(k: int, num: int, den: int):
    def run(batches):
        band_of = lru_cache(maxsize=100_000)(lambda n: bands(n, num, den))
        for b in sub_batches(batches):
            n, key, sig = [], [], []
            for s in shingle_sets(b.column("text"), k):
                n.append(len(s))
                key.append(_key(s) if len(s) else None)
                sig.append(set_signatures(s, num, den, band_of).view(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(sig, pa.list_(pa.int64()))],
                names=["id", "n", "key", "sigs"])
    return run


def sketch(s: np.ndarray) -> bytes:
    """For each of at least as many classes as a set has elements (a power of two, 64 at least): does it hold an odd
    number of that class? Sets that differ in d elements differ in d of these bits at most."""
    bits = 1 << max(6, len(s).bit_length())
    odd = np.bincount((tokens.mix(s + U(3)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """How many elements two sets differ in at least; the longer sketch is folded to the shorter."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    folded = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ folded).sum())


def _sets(k: int):
    def run(batches):
        for b in sub_batches(batches):
            key, sets, sketches = [], [], []
            for s in shingle_sets(b.column("text"), k):
                key.append(_key(s))
                sets.append(s.view(np.int64))
                sketches.append(sketch(s))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(sets, pa.list_(pa.int64())),
                                              pa.array(sketches, pa.binary())], names=["key", "s", "m"])
    return run


def _may_link(num: int, den: int):
    """The pairs (a, na, b, nb, ma, mb) whose sketches don't rule a link out."""
    def run(batches):
        for batch in sub_batches(batches):
            ok = []
            for m, n, x, y in zip(*[batch.column(c).to_pylist() for c in ("na", "nb", "ma", "mb")], strict=True):
                overlap = -(-num * (m + n) // (num + den))
                ok.append(sketch_distance(x, y) <= m + n - 2 * overlap)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])
    return run


def _shingle_counts(batches):
    total = np.zeros(SLOTS, dtype=np.int64)
    for b in sub_batches(batches):
        h = b.column("s").flatten().to_numpy(zero_copy_only=False).view(U)
        total += np.bincount((h & U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array([count_bytes(total)], pa.binary())], names=["counts"])


PARITY = tuple(f"p{k}" for k in range(4))


def parity_map(h: np.ndarray) -> np.ndarray:
    """256 bits that say for each of 256 classes whether a set holds an odd number of its shingles;
    sets that differ in d elements differ in d bits at most."""
    m = tokens.mix(h + U(2))
    return np.array([np.bitwise_xor.reduce(U(1) << (m[(m & U(3)) == U(k)] >> U(58)), initial=U(0))
                     for k in range(len(PARITY))], dtype=U).view(np.int64)


def _rare_prefixes(counts: np.ndarray, num: int, den: int):
    """Rows (key, comp, n, i, shingle, parity map): each set under the first
    n - ceil(n num / den) + 1 of its shingles, ordered by hashed counts."""
    def run(batches):
        for b in sub_batches(batches):
            key, comp, size, place, shingle, parity = [], [], [], [], [], []
            for k, c, s in zip(b.column("key").to_pylist(), b.column("comp").to_pylist(), b.column("s"), strict=True):
                h = np.asarray(s.values).view(U)
                take = len(h) - (len(h) * num + den - 1) // den + 1
                first = np.lexsort((h, counts[(h & U(SLOTS - 1)).astype(np.int64)]))[:take]
                key.append(np.full(take, k))
                comp.append(np.full(take, c))
                size.append(np.full(take, len(h), dtype=np.int32))
                place.append(np.arange(take, dtype=np.int32))
                shingle.append(h[first].view(np.int64))
                parity.append(np.repeat(parity_map(h)[None, :], take, axis=0))
            if key:
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.concatenate(x)) for x in (key, comp, size, place, shingle)],
                     *[pa.array(c) for c in np.concatenate(parity).T]],
                    names=["key", "comp", "n", "i", "shingle", *PARITY])
    return run


def components(edges: DataFrame, labels: DataFrame, name: str = "cc") -> DataFrame:
    """``labels`` (v, comp), one row for every vertex, merged along the edges (a, b): each vertex gets
    the smallest label it reaches.

    Works on labels, so what an earlier call merged is not gone through again. Each round hooks every
    label to its smallest neighbour, follows the hooks once more, and relabels the edges; the rounds
    end when no edge joins two labels. Only narrow rows move."""
    def of(end: str) -> DataFrame:
        return labels.select(F.col("v").alias(end), F.col("comp").alias(f"l{end}"))

    e = materialize(edges.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
                    .where("a <> b").distinct(), f"{name}-edges")
    jumps = []
    while not e.isEmpty():
        hook = (e.union(e.select("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
                .select(F.col("a").alias("v"), F.least("a", "m").alias("p")))
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jump = materialize(hook.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), f"{name}-jumps")
        labels = labels.join(jump.withColumnRenamed("v", "comp"), "comp", "left") \
            .select("v", F.coalesce("p", "comp").alias("comp"))
        to_a = jump.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        to_b = jump.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        jumps.append(jump)
        before, e = e, materialize(e.join(to_a, "a", "left").join(to_b, "b", "left")
                                   .select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
                                   .where("a <> b").distinct(), f"{name}-edges")
        discard(before)
    out = materialize(labels, f"{name}-labels")
    discard(e, *jumps)
    return out


def _linked_components(shared: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(key, comp) of the sets in ``shared``. ``shared``: (sig, key, n) of signatures with more
    than one set; ``sets``: (key, s, m). Both are written tables, and used up."""
    near = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    a_sets = sets.select(F.col("key").alias("a"), F.col("s").alias("sa"))
    b_sets = sets.select(F.col("key").alias("b"), F.col("s").alias("sb"))

    a_sketch = sets.select(F.col("key").alias("a"), F.col("m").alias("ma"))
    b_sketch = sets.select(F.col("key").alias("b"), F.col("m").alias("mb"))

    def compare(pairs: DataFrame, name: str) -> DataFrame:
        """Whole sets move only for pairs that lengths and sketches leave."""
        pairs = pairs.where(near).select("a", "na", "b", "nb").distinct()
        pairs = materialize(pairs.join(a_sketch, "a").join(b_sketch, "b").mapInArrow(_may_link(num, den), "a long, b long"),
                            f"{name}-pairs")
        both, all_ = F.size(F.array_intersect("sa", "sb")).cast("long"), F.size("sa").cast("long") + F.size("sb")
        out = materialize(pairs.join(a_sets, "a").join(b_sets, "b")
                          .select("a", "b", (den * both >= num * (all_ - both)).alias("linked")), f"{name}-compared")
        discard(pairs)
        return out

    # One leader each: among the smallest sets of its signatures, the one it meets most often.
    lead = shared.groupBy("sig").agg(F.min(F.struct("key", "n")).alias("lead"))
    met = (shared.join(lead, "sig").where(F.col("key") != F.col("lead.key"))
           .groupBy("key", "n", "lead").agg(F.count("*").alias("times")))
    first = met.groupBy("key", "n").agg(F.max(F.struct("times", "lead")).alias("best"))
    compared = compare(first.select(F.col("best.lead.key").alias("a"), F.col("best.lead.n").alias("na"),
                                    F.col("key").alias("b"), F.col("n").alias("nb")), "leaders")
    alone = materialize(shared.select(F.col("key").alias("v")).distinct().withColumn("comp", F.col("v")), "alone")
    merged = components(compared.where("linked"), alone)
    discard(compared, alone)

    def labelled(merged: DataFrame) -> DataFrame:
        """``shared`` with components, only where a signature still holds several."""
        now = shared.join(merged.withColumnRenamed("v", "key"), "key")
        open_sigs = now.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        return materialize(now.join(open_sigs.select("sig"), "sig"), "open")

    # Each set with the leader of every signature that it shares with another component.
    now = labelled(merged)
    lead = now.groupBy("sig").agg(F.min(F.struct(F.xxhash64("key").alias("h"), "key", "n", "comp")).alias("lead"))
    again = (now.join(lead, "sig").where(F.col("comp") != F.col("lead.comp"))
             .select(F.col("lead.key").alias("a"), F.col("lead.n").alias("na"), F.col("key").alias("b"),
                     F.col("n").alias("nb")).distinct())
    compared, before = compare(again, "second"), merged
    merged = components(compared.where("linked"), merged)
    discard(now, compared, before)

    # What is left: sets that still share a signature with another component. Such a pair can only
    # link if the sets share one of their rarest shingles early enough.
    now = labelled(merged)
    keys = materialize(now.select("key", "comp").distinct(), "open-keys")
    discard(shared, now)
    # The sets are listed as they are joined, no second copy of them is written. Any common order is exact, so
    # the counts are over all sets, without that join.
    counts = sum_counts(sets.select("s").mapInArrow(_shingle_counts, "counts binary"), SLOTS)
    left_sets = sets.select("key", "s").join(small_side(keys), "key")
    listed = materialize(left_sets.mapInArrow(_rare_prefixes(counts, num, den),
                                              "key long, comp long, n int, i int, shingle long, "
                                              + ", ".join(f"{c} long" for c in PARITY)), "open-listed")
    discard(keys)
    as_of = lambda x: listed.select("shingle", F.col("key").alias(x), F.col("n").alias(f"n{x}"),
                                    F.col("i").alias(f"i{x}"), F.col("comp").alias(f"c{x}"),
                                    *[F.col(c).alias(f"{c}{x}") for c in PARITY])
    overlap = F.ceil(num * (F.col("na") + F.col("nb")) / F.lit(float(num + den)))
    reachable = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= overlap
    differ = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in PARITY), F.lit(0))
    rest = (as_of("a").join(as_of("b"), "shingle")
            .where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near & reachable
                   & (differ <= F.col("na") + F.col("nb") - 2 * overlap))
            .select("a", "na", "b", "nb"))
    compared = compare(rest, "rest")
    out = components(compared.where("linked"), merged)
    discard(listed, sets, compared, merged)
    return out.withColumnRenamed("v", "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80,
                    den: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    described = materialize(d.mapInArrow(_describe(k, num, den), f"id {kind}, n long, key long, sigs array<long>"),
                            "jaccard-described")
    signed = described.where("key is not null").select("key", "n", F.explode("sigs").alias("sig"))
    several = materialize(signed.groupBy("sig").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
                          .where("lo <> hi").select("sig"), "jaccard-several")
    shared = materialize(signed.join(small_side(several), "sig").distinct(), "jaccard-shared")
    signatures, described = described, materialize(described.select("id", "n", "key"), "jaccard-rows")
    discard(signatures, several)

    # The sets of those that share a signature, each from one row that has it.
    keys = shared.select("key").distinct()
    reps = materialize(described.join(keys, "key", "left_semi").groupBy("key").agg(F.min("id").alias("rep"))
                       .select("rep").distinct(), "jaccard-reps")
    found = d.join(small_side(reps), d["id"].eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = materialize(found.mapInArrow(_sets(k), "key long, s array<long>, m binary").dropDuplicates(["key"]), "jaccard-sets")
    discard(reps)
    comp = _linked_components(shared, sets, num, den)

    classes = described.join(comp, "key", "left").select(
        "id", "n", F.coalesce("comp", "key").alias("class"))
    # Written first: the join then has two plain exchanges, and Spark can split a very large class.
    smallest = materialize(classes.where("class is not null").groupBy("class").agg(F.min("id").alias("least")),
                           "jaccard-smallest")
    return (classes.join(smallest, "class", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id")))
