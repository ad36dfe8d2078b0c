"""Packing (operator 13): best-fit decreasing over lengths.

Each text's ids, with an end id, are cut into full windows from the start; what is left is one shorter
piece, so every piece has one of ``window`` lengths. Best-fit decreasing looks at lengths alone, and
pieces of one length are alike: the driver runs it on the histogram of all pieces' lengths. Open
windows are groups of equal remaining capacity, a segment tree over the capacities finds the tightest
one that takes a length, and a group is filled at once: exactly what piece after piece would do.
The driver holds ``window`` counts and a list of groups whose number depends on the window alone.

Tasks number their pieces of each length as they write them; a prefix sum over tasks makes that a number
in the whole corpus, and the list says which sequence and offset it has. No length is gathered
anywhere, however many pieces share it.

A null text is empty: a piece of the end id alone. Repeated rows are packed as rows of their own. An empty
table gives no piece. Only the id and the text are read of ``docs``, other columns of any name are
left out. Long texts are encoded in blocks that end at a space or line end.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareshift.llm.common import materialize, small_side, sub_batches

WINDOW = 4096
END_ID = 2
BLOCK = 1 << 18
#: Words remembered by a Python worker with their ids (about 80 MB); beyond that it starts anew.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 48
#: Words of these characters alone are lower-cased and cut into token runs here, as the vocabulary's normalizer
#: and pattern do it; a word with any other character goes through the whole tokenizer.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordIds(dict):
    """Ids of words (and by them of texts) by the tokenizer library, each different word encoded once.

    The vocabulary drops white space and joins no tokens over it, so a text's ids are its words' ids one
    after another. Words are cut at spaces and line ends only. A plain word's runs go to the library's
    model one by one; other words, and those with the mark of a special token, to the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's own thread only
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def _run(self, run: str) -> bytes:
        """Ids of a run of lower-case letters, or of other characters."""
        letters = run if run.isascii() else self.bytes.pre_tokenize_str(run)[0][0]
        return packed([t.id for t in self.model.tokenize(letters)])

    def __missing__(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or "<|" in word:
            found = packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        else:
            runs = _RUN.findall(word.lower())
            found = self._run(runs[0]) if len(runs) == 1 else b"".join(map(self.__getitem__, runs))
        if len(word) <= LONGEST_REMEMBERED:
            self[word] = found
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self) > REMEMBERED:
            self.clear()
        return [b"".join(map(self.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    """One for the tasks of a Python worker, one after another."""
    return WordIds(path)


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _blocks(text: str) -> Iterator[str]:
    lo = 0
    while len(text) - lo > BLOCK:
        hi = min((i for i in (text.find(" ", lo + BLOCK), text.find("\n", lo + BLOCK)) if i >= 0), default=len(text))
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def _pieces(path: str, end_id: int, window: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = _word_ids(path), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, dtype=np.int64)
        end = packed([end_id])
        for b in sub_batches(batches, 4 * BLOCK):
            texts = [t or "" for t in b.column("text").to_pylist()]
            if len(texts) == 1:
                ids = [b"".join(chain.from_iterable(words.encode([x]) for x in _blocks(texts[0]))) + end]
            else:
                ids = [x + end for x in words.encode(texts)]
            row, start, length, nth, held = [], [], [], [], []
            for i, x in enumerate(ids):
                for lo in range(0, len(x) // 4, window):
                    n = min(window, len(x) // 4 - lo)
                    row.append(i)
                    start.append(lo)
                    length.append(n)
                    nth.append(seen[n])
                    held.append(x[4 * lo:4 * (lo + n)])
                    seen[n] += 1
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row, pa.int32())), pa.array(start, long), pa.array(length, long),
                 pa.array(held, pa.binary()), pa.array([len(ids[i]) // 4 for i in row], long),
                 pa.array([part] * len(row), pa.int32()), pa.array(nth, long)],
                names=["id", "start", "length", "ids", "doc_tokens", "part", "nth"])
    return pieces


def token_pieces(docs: DataFrame, path: str, *, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens, part, nth): each text's ids and the end id, cut into full windows
    and what is left. ``ids`` are little-endian unsigned 32-bit integers, ``doc_tokens`` counts the whole
    text's; ``nth`` numbers the pieces of a length within the task ``part``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(_pieces(path, end_id, window), f"id {kind}, start long, length long, ids binary, doc_tokens long, "
                                                       "part int, nth long")
            .withColumnRenamed("id", id_col))


class OpenWindows:
    """Groups of open windows (first sequence, windows) by remaining capacity, under a segment tree that
    counts the groups below each node."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += change
            node //= 2

    def put(self, room: int, first: int, windows: int) -> None:
        if room and windows:
            self.groups[room].append((first, windows))
            self._add(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        self._add(room, -1)
        return self.groups[room].pop()

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` with an open window."""
        node = self.leaves + length
        while not self.tree[node]:
            while node & 1:  # a right child: go up
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, ...]], int]:
    """Best-fit decreasing of ``counts`` pieces of each length into windows.

    Returns rows (length, low, high, each, first, offset) and the number of windows: of the pieces of
    that length, the ones numbered low to high - 1 go to the windows from ``first`` on, ``each`` in a
    window, one after another from ``offset``.
    """
    windows, rows, used = OpenWindows(window), [], 0
    for length in sorted(counts, reverse=True):
        low, left = 0, counts[length]
        while left:
            room = windows.tightest(length)
            if room is None:
                room, first, n = window, used, -(-left // (window // length))
                used += n
            else:
                first, n = windows.take(room)
            each = room // length
            full = min(n, left // each)
            for k, m in ((each, full), (left - full * each, 1)):
                if k and m and n and left:
                    k = min(k, left)
                    rows.append((length, low, low + k * m, k, first, window - room))
                    windows.put(room - k * length, first, m)
                    low, left, first, n = low + k * m, left - k * m, first + m, n - m
            windows.put(room, first, n)
    return rows, used


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (``length``, ``part``, ``nth`` and any other columns) with ``sequence_id`` and ``offset``.

    Sequences are numbered from 0 without gaps; the pieces of one fill it without gaps from offset 0.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pack-pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "pack-counts")
    total = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``window`` rows
    rows, _ = best_fit({r["length"]: r["n"] for r in total}, window)
    plan = _plan_table(spark, rows)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = materialize(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "pack-ahead")
    number = F.col("ahead") + F.col("nth")
    at = number - F.col("low")
    out = pieces.join(small_side(ahead), ["part", "length"]).join(
        F.broadcast(plan), (F.col("length") == F.col("of")) & (number >= F.col("low")) & (number < F.col("high")))
    return out.select(*[c for c in pieces.columns if c not in ("part", "nth")],
                      (F.col("first") + F.floor(at / F.col("each"))).alias("sequence_id"),
                      (F.col("begin") + at % F.col("each") * F.col("length")).alias("offset"))


def _plan_table(spark: SparkSession, rows: list[tuple[int, ...]]) -> DataFrame:
    """``best_fit``'s rows as a DataFrame; their number is bounded by the window, about 1 MB."""
    return spark.createDataFrame(rows, "of long, low long, high long, each long, first long, begin long")


def sequences(packed: DataFrame, *, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids) of packed pieces with their ``ids``: the training sequences. Each is padded
    to the window; one whose length is a power of two stays as it is."""
    whole = (packed.groupBy("sequence_id").agg(F.sum("length").alias("length"),
                                               F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
             .select("sequence_id", "length", F.expr("aggregate(p, CAST('' AS BINARY), (a, x) -> a || x.ids)").alias("ids")))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(window) - F.col("length")).cast("int")))
    even = F.expr("length & (length - 1)") == 0
    return whole.select("sequence_id", "length", F.when(even, F.col("ids")).otherwise(F.concat("ids", pad)).alias("ids"))
