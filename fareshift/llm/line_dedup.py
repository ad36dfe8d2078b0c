"""Near-duplicate lines by an exact set-similarity join; later matches go.

A line's tokens are its distinct words (runs of digits, a-z and anything beyond
ASCII, A-Z as a-z). A line matches an earlier one (order: document id, line
number) when their Jaccard similarity is ``num`` / ``den`` or more; a line that
matches any earlier line is removed.

1. Lines with equal token sets are found by a digest; all but the first go.
2. The rest is ordered token-wise by rarity, read from a table of ``SLOTS``
   hashed counts over all lines (any common order is exact; this one keeps
   the common words at the end). A line of n tokens is listed under the first
   n - ceil(n num / den) + 1 of them: matching lines share one of these.
3. Two lines under one token go on only if their lengths allow the similarity
   (length filter), the tokens from there on can still give the overlap
   (positional filter), and a 128-bit parity map of their tokens differs in
   no more bits than the sets may differ in.
4. What remains is verified on the token sets of the whole lines.

Only the existence of an earlier match counts. So each line first meets the
earliest lines under its ``LEAD`` rarest tokens (under all its tokens, where many
lines share one) and is compared with the closest of them, which settles groups of
near copies in as many comparisons as lines; the full join is for those left.

Defined results: null and empty texts have no lines to remove; lines without a word, and those of fewer
than ``min_tokens`` distinct tokens, are neither removed nor matched; in a script without spaces a run of
characters is one token, so such lines match where their runs are equal; repeated
rows of one id are one document, each row losing the same lines (of different texts of an id, lines of one number
are one line, so what goes from one goes from all; give such texts ids of their own, as the pipeline does); rows
with a null id lose nothing and match nothing. ``text`` keeps the other lines, in order, with their
line ends. Other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareshift.llm import tokens
from fareshift.llm.common import count_bytes, discard, is_small, materialize, small_side, sub_batches, sum_counts

SLOTS = 1 << 19
LEAD = 3
HOT = 16  # lines under a token that make its earliest line worth meeting by all tokens
MIN_TOKENS = 1
U = np.uint64
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


class Lines:
    """The lines of a run of texts and their distinct tokens, sorted by line and by hash, or by ``rank`` of the hash: numbers
    that differ, as good as always, where the hashes do, within their upper ``bits``."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, rank=None, bits: int = 44):
        ends = np.flatnonzero(raw == 10)
        starts = np.sort(np.concatenate([off[:-1], ends + 1]))
        self.first = np.arange(len(off)) + np.searchsorted(ends, off)  # each text's first line
        ws, we, _ = tokens.word_spans(raw, off, _WORD)
        h = tokens.hash_spans(raw, ws, we)
        line = np.searchsorted(starts, ws, side="right") - 1
        order = tokens.order_within(line, h if rank is None else rank(h), bits)
        h, line = h[order], line[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.h, self.line = h[new], line[new]
        self.count = len(starts)
        self.n = np.bincount(self.line, minlength=self.count)
        self.bounds = np.concatenate([[0], np.cumsum(self.n)])
        text = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.text, self.no = text, np.arange(self.count) - self.first[text]

    def reduce(self, ufunc, values: np.ndarray) -> np.ndarray:
        """One value a line: ``values`` (one a token) reduced; 0 for lines without tokens."""
        out = np.zeros(self.count, dtype=values.dtype)
        some = self.n > 0
        if some.any():
            out[some] = ufunc.reduceat(values, self.bounds[:-1][some])
        return out

    def keys(self) -> np.ndarray:
        return tokens.mix(self.reduce(np.add, tokens.mix(self.h + U(1))) + self.n.astype(U)).view(np.int64)


def _digests(kind: pa.DataType, least: int):
    """Rows (id, no, key, n) of the lines, and one row a task with its token counts."""
    def run(batches):
        total = np.zeros(SLOTS, dtype=np.int64)
        for b in sub_batches(batches):
            for lo, hi, raw, off in tokens.slices(b.column("text")):
                x = Lines(raw, off)
                np.add.at(total, (x.h & U(SLOTS - 1)).view(np.int64), 1)
                keep = np.flatnonzero(x.n >= least)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo).take(pa.array(x.text[keep])),
                     pa.array(x.no[keep].astype(np.int32)), pa.array(x.keys()[keep]),
                     pa.array(x.n[keep].astype(np.int32)), pa.nulls(len(keep), pa.binary())],
                    names=["id", "no", "key", "n", "counts"])
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
                 pa.array([count_bytes(total)], pa.binary())],
                names=["id", "no", "key", "n", "counts"])
    return run


def _prefixes(counts: np.ndarray, num: int, den: int, least: int):
    """Rows (id, no, n, parity, parity2, tokens): a line and the tokens of its prefix, but for the lines ``gone``."""
    # Rarity in steps of a 512th of a doubling, 14 bits: any common order is exact, and this one sorts in one key.
    rarity = (np.log2(counts + 1.0) * 512).astype(U) << U(50)

    def rank(h: np.ndarray) -> np.ndarray:
        """By rarity, then by hash."""
        return rarity[(h & U(SLOTS - 1)).view(np.int64)] | h >> U(14)

    def run(batches):
        for b in sub_batches(batches):
            for lo, hi, raw, off in tokens.slices(b.column("text")):
                x = Lines(raw, off, rank, 46)
                size = x.n - (x.n * num + den - 1) // den + 1
                gone = b.column("gone").slice(lo, hi - lo)
                of = np.repeat(np.arange(hi - lo), pc.list_value_length(gone).fill_null(0).to_numpy())
                at = x.first[of] + gone.flatten().to_numpy()
                size[at[at < x.first[of + 1]]] = 0  # another text of the id may have more lines
                # Sets so small that only equal ones match need no list.
                size[(x.n < least) | (x.n * den < num * (x.n + 1)) & ((x.n - 1) * den < num * x.n)] = 0
                m = tokens.mix(x.h + U(2))  # one bit says which word, six say which place
                parity = [x.reduce(np.bitwise_xor, (m & U(1) == U(k)).astype(U) << (m >> U(58))) for k in (0, 1)]
                at = np.arange(len(x.h)) - x.bounds[:-1][x.line]
                take = at < size[x.line]
                token = (x.h[take] >> U(32)).astype(np.uint32).view(np.int32)
                own = np.bincount(x.line[take], minlength=x.count)
                line = np.flatnonzero(own)
                ends = np.concatenate([[0], np.cumsum(own[line])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo).take(pa.array(x.text[line])),
                     pa.array(x.no[line].astype(np.int32)), pa.array(x.n[line].astype(np.int32)),
                     *[pa.array(p[line].view(np.int64)) for p in parity], pa.ListArray.from_arrays(ends, token)],
                    names=["id", "no", "n", "parity", "parity2", "tokens"])
    return run


def _token_sets(batches):
    """The token sets of the wanted lines (``nos``) of each text."""
    for b in sub_batches(batches):
        nos = b.column("nos").to_pylist()
        picked = []
        for text, own in zip(b.column("text").to_pylist(), nos, strict=True):
            lines = dict(enumerate(text.split("\n")))
            picked.append("\n".join([lines.get(j, "") for j in own]))
        for lo, hi, raw, off in tokens.slices(pa.array(picked, pa.large_string())):
            x = Lines(raw, off)
            sets = [x.h[x.bounds[j]:x.bounds[j + 1]].view(np.int64) for j in range(x.count)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").slice(lo, hi - lo).take(pa.array(x.text)),
                 pa.array(np.concatenate([nos[t] for t in range(lo, hi)]).astype(np.int32)),
                 pa.array(sets, pa.list_(pa.int64()))],
                names=["id", "no", "s"])


def _verify(num: int, den: int):
    def run(batches):
        for b in sub_batches(batches):
            ok = []
            for x, y in zip(b.column("sx"), b.column("sy"), strict=True):
                x, y = np.asarray(x.values), np.asarray(y.values)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("id").filter(keep), b.column("no").filter(keep)],
                                             names=["id", "no"])
    return run


def _may_match(num: int, den: int) -> Column:
    """Length, positional and parity filter between two listed lines (columns of the one, x_* of the other)."""
    n, m, i, j = F.col("n"), F.col("x_n"), F.col("i"), F.col("x_i")
    overlap = F.expr(f"cast(ceil({num} * (n + x_n) / {float(num + den)}D) as int)")
    return ((F.least(n, m) * den >= F.greatest(n, m) * num) & (F.least(n - i, m - j) >= overlap)
            & (_distance() <= n + m - 2 * overlap))


def _distance() -> Column:
    """A lower bound of how many tokens differ: the bits in which two 128-bit parity maps differ."""
    one, two = (F.bit_count(F.col(c).bitwiseXOR(F.col(f"x_{c}"))) for c in ("parity", "parity2"))
    return one + two


def later_matches(docs: DataFrame, id_col: str, text_col: str, num: int, den: int, min_tokens: int) -> DataFrame:
    """(id, no) of the lines to remove."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    kind = d.schema["id"].dataType.simpleString()
    arrow_kind = pa.schema(spark_arrow(d.select("id").schema)).field("id").type
    digests = materialize(d.mapInArrow(_digests(arrow_kind, min_tokens),
                                       f"id {kind}, no int, key long, n int, counts binary"), "lines-digests")
    counts = sum_counts(digests.where("counts is not null").select("counts"), SLOTS)
    lines = digests.where("counts is null").select("id", "no", "key")
    first = materialize(lines.groupBy("key").agg(F.min(F.struct("id", "no")).alias("first"), F.count("*").alias("c"))
                        .where("c > 1").select("key", "first"), "lines-first")
    equal = materialize(lines.join(first, "key").where(F.struct("id", "no") > F.col("first")).select("id", "no")
                        .distinct(), "lines-equal")
    discard(digests, first)

    # Lines that are gone already are not listed.
    skip = equal.groupBy("id").agg(F.collect_set("no").alias("gone"))
    listed = (d.join(F.broadcast(skip) if is_small(equal) else skip, "id", "left").select("id", "text", "gone")
              .mapInArrow(_prefixes(counts, num, den, min_tokens),
                          f"id {kind}, no int, n int, parity long, parity2 long, tokens array<int>"))
    listed = materialize(listed, "lines-listed")

    def under(lines: DataFrame, tokens: Column, *more: str) -> DataFrame:
        """A row for each of a line's ``tokens``, with its place ``i``."""
        return lines.select("id", "no", "n", "parity", "parity2", *more, F.posexplode(tokens).alias("i", "token"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The lines (id, no) of the pairs with (x_id, x_no) whose sets do match."""
        pairs = materialize(pairs, f"{name}-pairs")
        wanted = materialize(pairs.select("id", "no").union(pairs.select("x_id", "x_no")).distinct(), f"{name}-wanted")
        few = is_small(wanted)
        per_doc = wanted.groupBy("id").agg(F.sort_array(F.collect_set("no")).alias("nos"))
        sets = (d.join(F.broadcast(per_doc) if few else per_doc, "id").select("id", "text", "nos")
                .mapInArrow(_token_sets, f"id {kind}, no int, s array<long>").groupBy("id", "no").agg(F.max("s").alias("s")))
        sets = materialize(sets, f"{name}-sets")
        both = (pairs.join(sets.withColumnRenamed("s", "sy"), ["id", "no"])
                .join(sets.select(F.col("id").alias("x_id"), F.col("no").alias("x_no"), F.col("s").alias("sx")),
                      ["x_id", "x_no"]))
        out = materialize(both.select("id", "no", "sx", "sy").mapInArrow(_verify(num, den), f"id {kind}, no int")
                          .distinct(), f"{name}-verified")
        discard(pairs, wanted, sets)
        return out

    def as_x(df: DataFrame, *more: str) -> DataFrame:
        return df.select("token", *[F.col(c).alias(f"x_{c}") for c in ("id", "no", "n", "parity", "parity2", "i", *more)])

    # Asked first of each pair: cheap, and few pass. Ids may be structs, which are dear to compare.
    near = _may_match(num, den)
    earlier = F.struct("x_id", "x_no") < F.struct("id", "no")
    front = under(listed, F.slice("tokens", 1, LEAD))
    lead = materialize(front.groupBy("token").agg(F.min(F.struct("id", "no", "n", "parity", "parity2", "i")).alias("x"),
                                                  F.count("*").alias("c")).where("c > 1").select("token", "x.*", "c"),
                       "lines-lead")
    # The earliest line under a token that many share is met by every token of a line's list.
    hot = lead.where(F.col("c") >= HOT)
    hot = small_side(as_x(hot))
    met = front.join(as_x(lead), "token").where(near & earlier)
    deeper = F.slice("tokens", LEAD + 1, F.greatest(F.size("tokens") - LEAD, F.lit(0)))  # the first have met it
    met_hot = under(listed, deeper).join(hot, "token").where(near & earlier)
    best = (met.select(met_columns := ["id", "no", "x_id", "x_no", _distance().alias("off")])
            .union(met_hot.select(met_columns))
            .groupBy("id", "no").agg(F.min(F.struct("off", "x_id", "x_no")).alias("x")).select("id", "no", "x.x_id", "x.x_no"))
    settled = verified(best, "lines-leaders")
    discard(lead)

    # All pairs that still matter: the shorter line by the tokens it must share with one at least as
    # long, the longer one by its whole list; the later of the two must not be settled.
    marked = listed.join(small_side(settled.withColumn("done", F.lit(True))), ["id", "no"], "left")
    must = (F.col("n") - F.ceil(2 * num * F.col("n") / F.lit(float(num + den))) + 1).cast("int")
    shorter = under(marked, F.slice("tokens", F.lit(1), must), "done")
    longer = as_x(under(marked, F.col("tokens"), "done"), "done")
    later_open = F.when(earlier, F.col("done")).otherwise(F.col("x_done")).isNull()
    both_ways = (F.col("x_id") != F.col("id")) | (F.col("x_no") != F.col("no"))
    found = shorter.join(longer, "token").where((F.col("n") <= F.col("x_n")) & near & both_ways & later_open)
    one, two = F.struct("id", "no"), F.struct(F.col("x_id").alias("id"), F.col("x_no").alias("no"))
    rest = found.select(F.when(earlier, one).otherwise(two).alias("y"), F.when(earlier, two).otherwise(one).alias("x")) \
        .select("y.id", "y.no", F.col("x.id").alias("x_id"), F.col("x.no").alias("x_no")).distinct()
    others = verified(rest, "lines-rest")
    removed = materialize(equal.union(settled).union(others).distinct(), "lines-removed")
    discard(listed, equal, settled, others)
    return removed


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` without the numbers in ``gone`` (ascending): the runs between them, so it is linear in both."""
    ends = F.concat(gone, F.array(F.size(lines)))

    def run(end: Column, k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get(gone, k - 1) + 1)
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(ends, run))


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row. A filter on the result is moved to where its columns come from,
    with their expressions in place of their names; within another lambda they would run once an element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rebuilt(text: Column, gone: Column) -> Column:
    """(n_lines, n_removed, text) of a text that loses the lines ``gone``, as far as it has them."""
    def own(b: Column) -> Column:
        return F.struct(b["lines"].alias("lines"), F.filter(b["gone"], lambda no: no < F.size(b["lines"])).alias("gone"))

    def out(b: Column) -> Column:
        kept = F.array_join(_without(b["lines"], b["gone"]), "\n")
        return F.struct(F.coalesce(F.size(b["lines"]), F.lit(0)).cast("long").alias("n_lines"),
                        F.coalesce(F.size(b["gone"]), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))

    return _bound(F.struct(F.split(text, "\n").alias("lines"), gone.alias("gone")), lambda b: _bound(own(b), out))


def spark_arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100,
                min_tokens: int = MIN_TOKENS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, n_lines, n_removed, text without the removed lines, and the ``keep`` columns."""
    removed = later_matches(docs, id_col, text_col, num, den, min_tokens)
    few = is_small(removed)
    per_doc = removed.groupBy("id").agg(F.sort_array(F.collect_set("no")).alias("gone"))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"k_{c}") for c in keep])
    d = d.join(F.broadcast(per_doc) if few else per_doc, "id", "left") \
        .withColumn("out", _rebuilt(F.col("text"), F.col("gone")))
    return d.select(F.col("id").alias(id_col), "out.n_lines", "out.n_removed",
                    F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.col("out.kept")).alias("text"),
                    *[F.col(f"k_{c}").alias(c) for c in keep])
