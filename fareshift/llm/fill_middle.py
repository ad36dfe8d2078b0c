"""Fill-in-middle transformation (operator 11): chunk memoization.

A text is tokens ``[A-Za-z]+|[^A-Za-z]``. Its bytes are cut into content-defined chunks where a
rolling hash of 16 bytes says so, so equal passages of different texts give equal chunks. What a
chunk adds is remembered under the chunk's content (a hash finds it, its bytes confirm it): its
tokens, its code points, and whether it starts and ends with a letter. Neighbours combine by
addition, less one token where a run of letters goes on over the boundary. The running sums give
a text's number of tokens and the chunk a cut lies in; only that chunk's tokens are looked at.

Where the cuts fall and which form a text takes follows from the SHA-256 of seed and id alone. A
narrow job: nothing is shuffled. A null text is empty; a null id is hashed as ''. An empty text, and
one that holds a sentinel, stays plain. Repeated rows give equal rows. Only the id and the text are
read of ``docs``, other columns of any name are left out. Long texts are read in blocks of 1 MB,
and the remembered chunks of a task take about ``CACHE_BYTES``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareshift.llm.tokens import buffers

SENTINELS = ("<P>", "<S>", "<M>")
WINDOW = 16
MIN_CHUNK, MAX_CHUNK = 128, 4096
#: A window whose hash has these top bits clear ends a chunk: one in 512.
TOP_BITS = 9
BLOCK = 1 << 20
CACHE_BYTES = 16 << 20

_VALUE = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)
_BASE = 0x01000193
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_CONTINUED = bytes(range(0x80, 0xC0))
_NO_TOKEN = _LETTERS + _CONTINUED
_RUNS = bytes(97 if b in _LETTERS else 32 for b in range(256))
_IS_LETTER = np.isin(np.arange(256), list(_LETTERS))


def _window_ends(raw: np.ndarray) -> np.ndarray:
    """Places after the windows that end a chunk; polynomials over 16 bytes, built by doubling."""
    h, base, step = _VALUE[raw], _BASE, 1
    while step < WINDOW:
        h = h[:-step] * np.uint32(base) + h[step:] if len(h) > step else h[:0]
        base, step = base * base % 2**32, 2 * step
    return np.flatnonzero(h >> np.uint32(32 - TOP_BITS) == 0) + WINDOW


def chunk_ends(raw: np.ndarray) -> list[int]:
    """Ends of the chunks: ``MIN_CHUNK`` to ``MAX_CHUNK`` bytes each (the last one may be shorter),
    never inside a code point."""
    ends, last, n = [], 0, len(raw)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        back = max(0, lo - WINDOW + 1)
        found = _window_ends(raw[back:hi]) + back
        found = found[found < n]
        found = found[(raw[found] & 0xC0) != 0x80].tolist()
        while True:
            i = bisect_left(found, last + MIN_CHUNK)
            end = found[i] if i < len(found) else hi
            if end - last > MAX_CHUNK:
                end = last + MAX_CHUNK
                while end < n and raw[end] & 0xC0 == 0x80:
                    end += 1
            elif i >= len(found):
                break
            ends.append(end)
            last = end
    if last < n:
        ends.append(n)
    return ends


def summarise(chunk: bytes) -> tuple[int, int, bool, bool]:
    """(tokens, code points, starts with a letter, ends with a letter) of a chunk taken alone."""
    tokens = len(chunk.translate(None, _NO_TOKEN)) + len(chunk.translate(_RUNS).split())
    return tokens, len(chunk.translate(None, _CONTINUED)), chunk[0] in _LETTERS, chunk[-1] in _LETTERS


class ChunkCache:
    """Summaries by content. Beyond ``size`` bytes it starts anew: only work is lost."""

    def __init__(self, size: int = CACHE_BYTES):
        self.size, self.used, self.kept = size, 0, {}

    def summary(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        found = self.kept.get(chunk)
        if found is None:
            found = summarise(chunk)
            if self.used + len(chunk) > self.size:
                self.kept, self.used = {}, 0
            self.kept[chunk] = found
            self.used += len(chunk)
        return found


class TextIndex:
    """The running counts of a text's chunks."""

    def __init__(self, raw: np.ndarray, cache: ChunkCache):
        self.raw, self.ends = raw, chunk_ends(raw)
        self.tokens, self.points, self.joined = [0], [0], []
        lo, letter = 0, False
        for hi in self.ends:
            tokens, points, first, last = cache.summary(raw[lo:hi].tobytes())
            joined = letter and first
            self.joined.append(joined)
            self.tokens.append(self.tokens[-1] + tokens - joined)
            self.points.append(self.points[-1] + points)
            lo, letter = hi, last
        self.n = self.tokens[-1]

    def points_before(self, token: int) -> int:
        """Code points before the token of this number; all of them for the number after the last."""
        if token >= self.n:
            return self.points[-1]
        i = bisect_right(self.tokens, token) - 1
        lo = self.ends[i - 1] if i else 0
        b = self.raw[lo:self.ends[i]]
        lead, letter = (b & 0xC0) != 0x80, _IS_LETTER[b]
        start = lead.copy()
        start[1:] &= ~(letter[1:] & letter[:-1])
        start[0] &= not self.joined[i]
        at = np.flatnonzero(start)[token - self.tokens[i]]
        return self.points[i] + int(np.count_nonzero(lead[:at]))


def _cuts(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Of (text, two hashes): tokens, and the code points before the two cuts."""
    cache = ChunkCache()
    for text, h1, h2 in batches:
        raw, off = buffers(text)
        out = []
        for i, (a, b) in enumerate(zip(h1.to_pylist(), h2.to_pylist(), strict=True)):
            index = TextIndex(raw[off[i]:off[i + 1]], cache)
            one, two = sorted((a % (index.n + 1), b % (index.n + 1)))
            out.append((index.n, index.points_before(one), index.points_before(two)))
        cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 3
        yield pa.StructArray.from_arrays(cols, names=["n", "one", "two"])


def _check(sentinels: tuple[str, str, str]) -> None:
    if len(set(sentinels)) < 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"sentinels {a!r} and {b!r} may overlap, so a text could not be rebuilt")


def fill_in_middle(docs: DataFrame, *, seed: int = 1, percent: int = 90, spm_percent: int = 20,
                   sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    ``percent`` of the texts are rearranged, ``spm_percent`` of these suffix first. ``n`` counts the
    tokens; ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle).
    """
    _check(sentinels)
    p, s, m = (F.lit(x) for x in sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("d"))
    h = [F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    cuts = F.arrow_udf(_cuts, "n long, one long, two long")
    rows = rows.select("id", "text", cuts("text", h[0], h[1]).alias("c"), h[2].alias("h3"), h[3].alias("h4"))
    held = F.contains("text", p) | F.contains("text", s) | F.contains("text", m)
    form = (F.when((F.col("text") == "") | held | (F.col("h3") % 100 >= percent), "plain")
            .when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    rows = rows.select("id", "text", "c", form.alias("form"))
    one, two = F.col("c.one").cast("int"), F.col("c.two").cast("int")
    prefix, middle = F.substring("text", F.lit(1), one), F.substring("text", one + 1, two - one)
    suffix = F.substring("text", two + 1, F.length("text"))
    output = (F.when(F.col("form") == "plain", F.col("text"))
              .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .otherwise(F.concat(s, suffix, p, prefix, m, middle)))
    split = F.col("form") != "plain"
    return rows.select(F.col("id").alias(id_col), F.col("c.n").alias("n"), "form",
                       F.when(split, F.col("c.one")).alias("prefix_chars"),
                       F.when(split, F.col("c.two") - F.col("c.one")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of the given form was made from."""
    _check(sentinels)
    p, s, m = sentinels
    at = {x: F.instr(output, F.lit(x)) for x in sentinels}
    end = F.length(output)

    def part(after: str, until: Column) -> Column:
        lo = at[after] + len(after)
        return F.substring(output, lo, until - lo)

    last = part(m, end + 1)
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(part(p, at[s]), last, part(s, at[m])))
            .otherwise(F.concat(part(p, at[m]), last, part(s, at[p]))))
