"""Vectorised words: 64-bit hashes of all words of a batch of texts, by numpy.

A word's hash is a polynomial over its bytes modulo 2^64 with random byte
values, finished by a mixer; prefix sums give it for all words at once. A-Z
count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U)[_LOWER]
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
SLICE = 1 << 18


def _table(separators) -> np.ndarray:
    word = np.ones(256, dtype=bool)
    word[list(separators)] = False
    return word


#: Words are runs of anything but the space and U+0009 to U+000D.
SPACED = _table([0x20, *range(0x09, 0x0E)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher (murmur3's)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int):
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, _BASE)]), dtype=U)
            self.down = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, _INVERSE)]), dtype=U)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``size`` bytes; a longer text
    is a run of its own."""
    if not len(column):
        return
    raw, off = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def _hash_block(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum(_VALUE[raw] * up[:-1], dtype=U, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def word_spans(raw: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word (with the number of words at the end)."""
    inside = word[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Hashes of the given spans, block by block."""
    if len(raw) <= block or not len(starts):
        return _hash_block(raw, starts, ends)
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, side="right")))
        a, b = starts[i], ends[j - 1]
        out.append(_hash_block(raw[a:b], starts[i:j] - a, ends[i:j] - a))
        i = j
    return np.concatenate(out)


def word_hashes(raw: np.ndarray, off: np.ndarray, word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, each text's first word with the number of words at the end)."""
    starts, ends, bounds = word_spans(raw, off, word)
    return hash_spans(raw, starts, ends), bounds


def shingle_hashes(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a text, and each text's first one with the number at
    the end. A text of fewer words, but not none, has one run of all of them."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(bounds[:-1] - out_bounds[:-1], count) + np.arange(out_bounds[-1])
    width = np.repeat(np.minimum(n, k), count)
    s = width.astype(U) * U(0x2545F4914F6CDD1D)
    for i in range(k):
        ok = width > i
        s[ok] = mix(s[ok] * _BASE + h[at[ok] + i])
    return s, out_bounds


def order_within(group: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """``np.lexsort((key, group))`` for ascending groups, up to the order of equal keys: one sort of group and the
    upper ``bits`` of the 64-bit key, where the groups fit beside them and no two different keys of a group share them."""
    if len(group) and int(group[-1]) >> (64 - bits) == 0:
        joined = group.astype(U) << U(bits) | key >> U(64 - bits)
        order = np.argsort(joined)
        joined, sorted_keys = joined[order], key[order]
        if not ((joined[1:] == joined[:-1]) & (sorted_keys[1:] != sorted_keys[:-1])).any():
            return order
    return np.lexsort((key, group))
