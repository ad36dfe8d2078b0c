"""Language-model scores: an interpolated modified Kneser-Ney model of order two or three.

Counted in Spark, over all training texts:

1. words: every task counts the hashes of its words; reducers own ranges of the
   hash and write them as sorted arrays. A word's id is its place in that order.
2. pairs (word, next word): tasks count pairs of ids; reducers own ranges of
   the pairs in sorted order, cut so that each holds about ``PAIR_MASS`` tokens.
   The cut runs through the followers of a frequent word, so no word is too hot for
   one reducer. They write sorted arrays of pairs with counts, and pass on how
   many followers with counts 1, 2, 3+ a word has and how many predecessors.
3. the latter add up, by ranges of ids, to arrays beside the words.

Order three counts triples (place of the pair, next word) between 2 and 3. Reducers own the triples
of a pair range, cut by the next word where the range holds several times ``PAIR_MASS`` tokens. They
write sorted arrays as for pairs and pass on what belongs beside the pairs: followers of a context
with counts 1, 2, 3+, and how many different words precede a pair. A pair seen once has one follower
and one predecessor, so only repeated pairs have entries. From the predecessors the pair ranges
give each word its followers by continuation count.

The arrays are files in the shared folder. Workers map them into memory
(a folder that is no mounted path is copied into an unlinked temporary file
first) and look up sorted distinct words and pairs of a batch.

Words are runs of anything but white space (space, U+0009 to U+000D), A-Z as a-z; each
text ends with one end token and starts from a start context.

    P(w | v) = max(c(v w) - D(c), 0) / c(v) + g(v) P(w)
    P(w)     = max(a(w) - E(a), 0) / A + h / (V + 1)

with a(w) the number of different words before w, A their sum, D and E the
modified discounts, g and h what the discounts free. An unknown word has the
last term alone; after an unknown word P(w) holds. Probabilities add up to 1
over the V known tokens and one unknown. Order three has above them

    P(w | u v) = max(c(u v w) - T(c), 0) / c(u v) + f(u v) P(w | v)

and P(w | v) with a(v w), the number of different words before v w, in place of c(v w)
(c at the start of a text, where nothing precedes). Where u v is unknown, and
for the first token of a text, P(w | v) holds.

Defined results: a null text is empty, its only token is the end; without training
texts P(w) is 1 / (V + 1) = 1. Repeated rows count as often as they occur and
each get their row. Other columns are dropped. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareshift.llm import tokens
from fareshift.llm.common import materialize, partitions_for, sub_batches, work_path

PAIR_MASS = 4_000_000
WORD_BYTES = 32 << 20  # training text for each range of words
FLUSH = 4_000_000  # entries a task gathers before it hands them on
BATCH = 4 << 20
START, END, WORDS = 0, 1, 2  # ids
U = np.uint64


# Files and packed arrays

def _local(uri: str) -> str | None:
    url = urlparse(uri)
    return url.path if url.scheme in ("", "file") else None


def save(uri: str, array: np.ndarray) -> None:
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(at) as out:
            out.write(np.ascontiguousarray(array).tobytes())
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    array.tofile(part)
    os.replace(part, path)  # a second attempt of the task writes the same bytes


def load(uri: str, dtype) -> np.ndarray:
    path = _local(uri)
    if path is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as copy:
        with store.open_input_stream(at) as stream:
            while chunk := stream.read(16 << 20):
                copy.write(chunk)
        copy.flush()
        return np.memmap(copy, dtype=dtype, mode="r") if copy.tell() else np.zeros(0, dtype)


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array, plane by plane: high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Ascending uint64 keys by differences, uint32 columns."""
    parts = [_planes(np.diff(keys, prepend=U(0)))] + [_planes(v.astype(np.uint32)) for v in values]
    return struct.pack("<qq", len(keys), len(values)) + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    n, k = struct.unpack_from("<qq", blob)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[16:], max_output_size=n * (8 + 4 * k) + 1), np.uint8)
    plane = lambda at, size, t: np.ascontiguousarray(raw[at:at + n * size].reshape(size, n).T).view(t).ravel()
    return [np.cumsum(plane(0, 8, U), dtype=U), *[plane(n * (8 + 4 * i), 4, np.uint32) for i in range(k)]]


def add_up(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct ascending keys and the sums of their values."""
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(np.concatenate([p[i] for p in parts]).astype(np.int64)[order], first) if len(keys)
            else np.zeros(0, np.int64) for i in range(1, len(parts[0]) if parts else 2)]
    return (keys[first], *sums)


class _Gather:
    """Counts of keys, merged now and then, handed out by range when too many."""

    def __init__(self, ranges_of):
        self.parts, self.size, self.ranges_of = [], 0, ranges_of

    def add(self, keys: np.ndarray):
        k, c = np.unique(keys, return_counts=True)
        self.parts.append((k, c))
        self.size += len(k)
        if self.size > FLUSH:
            self.parts = [add_up(self.parts)]
            self.size = len(self.parts[0][0])
            if self.size > FLUSH // 2:
                yield from self.flush()

    def flush(self):
        if self.parts:
            keys, counts = add_up(self.parts)
            at = self.ranges_of(keys)
            if (at[1:] < at[:-1]).any():
                order = np.argsort(at, kind="stable")
                keys, counts, at = keys[order], counts[order], at[order]
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            rows = [(int(at[a]), pack(keys[a:b], counts[a:b])) for a, b in zip(cut, cut[1:], strict=False)]
            self.parts, self.size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                                  pa.array([r[1] for r in rows], pa.binary())], names=["part", "blob"])


# Words

def _word_range(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _count_words(parts: int):
    def run(batches):
        got = _Gather(lambda keys: _word_range(keys, parts))
        for b in sub_batches(batches, BATCH):
            for _, _, raw, off in tokens.slices(b.column("text")):
                yield from got.add(tokens.word_hashes(raw, off)[0])
        yield from got.flush()
    return run


def _write_words(root: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"][0])
        keys, counts = add_up([tuple(unpack(b)) for b in pdf["blob"]])
        save(f"{root}/hash-{part}", keys)
        save(f"{root}/count-{part}", counts.astype(np.uint64))
        return pd.DataFrame({"part": [part], "n": [len(keys)], "total": [int(counts.sum())]})
    return run


class Words:
    """The mapped word arrays. ``meta``: root, and (n, total) of each range."""

    def __init__(self, meta: dict):
        self.meta = meta
        sizes, totals = np.array(meta["n"], dtype=np.int64), np.array(meta["total"], dtype=np.int64)
        self.first = WORDS + np.concatenate([[0], np.cumsum(sizes)])  # id of each range's first word
        self.before = meta["docs"] + np.concatenate([[0], np.cumsum(totals)])  # context tokens before each range
        self._files = {}

    def array(self, name: str, part: int, dtype) -> np.ndarray:
        if (name, part) not in self._files:
            self._files[name, part] = load(f"{self.meta['root']}/{name}-{part}", dtype)
        return self._files[name, part]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ids of ascending hashes; -1 if unknown."""
        out = np.full(len(h), -1, dtype=np.int64)
        at = _word_range(h, len(self.meta["n"]))
        for part in np.unique(at):
            if self.meta["n"][part]:
                known = self.array("hash", part, U)
                q = np.flatnonzero(at == part)
                i = np.minimum(np.searchsorted(known, h[q]), len(known) - 1)
                hit = known[i] == h[q]
                out[q[hit]] = self.first[part] + i[hit]
        return out

    def part_of(self, ids: np.ndarray) -> np.ndarray:
        return np.clip(np.searchsorted(self.first, ids, side="right") - 1, 0, len(self.meta["n"]) - 1)

    def column(self, name: str, ids: np.ndarray, dtype, skip: int = 0) -> np.ndarray:
        """Values of an array beside the words. ``skip``: places of START and END before the first range's."""
        out = np.zeros(len(ids), dtype=dtype)
        at = self.part_of(ids)
        for part in np.unique(at):
            q = np.flatnonzero(at == part)
            base = self.first[part] - (skip if part == 0 else 0)
            out[q] = self.array(name, part, dtype)[ids[q] - base]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Occurrences as a context: of START all texts, of END none."""
        out = np.where(ids == START, self.meta["docs"], 0).astype(np.int64)
        w = np.flatnonzero(ids >= WORDS)
        out[w] = self.column("count", ids[w], U).astype(np.int64)
        return out

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """Context tokens that sort before each (ascending) id."""
        out = np.where(ids == START, 0, self.meta["docs"]).astype(np.int64)
        w = np.flatnonzero(ids >= WORDS)
        at = self.part_of(ids[w])
        for part in np.unique(at):
            q = np.flatnonzero(at == part)
            if ("sum", part) not in self._files:
                c = np.asarray(self.array("count", part, U)).astype(np.int64)
                self._files["sum", part] = np.cumsum(c) - c
            out[w[q]] = self.before[part] + self._files["sum", part][ids[w[q]] - self.first[part]]
        return out

    def pair_range(self, keys: np.ndarray) -> np.ndarray:
        """The reducer of ascending pairs: ascending too, about ``mass`` tokens each."""
        ids, inverse = np.unique((keys >> U(32)).astype(np.int64), return_inverse=True)
        follower = (keys & U(0xFFFFFFFF)).astype(np.float64) / (self.first[-1] + 1)
        mass = self.starts(ids)[inverse] + self.counts(ids)[inverse] * follower
        return np.minimum(mass // self.meta["mass"], self.meta["pair_parts"] - 1).astype(np.int64)


def _sequence(words: Words, raw: np.ndarray, off: np.ndarray):
    """(ids of all tokens with each text's END, ids of what stands before them, each text's first token)."""
    h, wb = tokens.word_hashes(raw, off)
    distinct, inverse = np.unique(h, return_inverse=True)
    ids = words.ids(distinct)[inverse]
    n = len(off) - 1
    bounds = wb + np.arange(n + 1)
    seq = np.full(bounds[-1], END, dtype=np.int64)
    body = np.ones(len(seq), dtype=bool)
    body[bounds[1:] - 1] = False
    seq[body] = ids
    prev = np.empty_like(seq)
    prev[1:] = seq[:-1]
    prev[bounds[:-1]] = START
    return seq, prev, bounds


# Pairs

def _times(counts: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Counts in a narrow type, and the places and counts of those that don't fit."""
    most = np.iinfo(dtype).max
    often = np.flatnonzero(counts >= most)
    return np.minimum(counts, most).astype(dtype), np.concatenate([often, counts[often]]).astype(U)


def _runs(at: np.ndarray):
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else []
    return zip(cut[:-1], cut[1:], strict=True)


class Pairs:
    """The mapped arrays of pairs and triples."""

    def __init__(self, words: Words):
        self.words, self.meta = words, words.meta
        if "pair_n" in self.meta:
            self.first = np.concatenate([[0], np.cumsum(self.meta["pair_n"])]).astype(np.int64)
            self.first_cut = np.concatenate([[0], np.cumsum(self.meta["cuts"])]).astype(np.int64)

    def array(self, name: str, part: int, dtype) -> np.ndarray:
        try:
            return self.words.array(name, part, dtype)
        except FileNotFoundError:  # a range without entries was never written
            self.words._files[name, part] = np.zeros(0, dtype)
            return self.words._files[name, part]

    def _find(self, names: tuple[str, str, str], part: int, keys: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray]:
        """(places, counts) of keys in a range; -1 and 0 if not there."""
        known = self.array(names[0], part, U)
        if not len(known):
            return np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[i] == keys
        return np.where(hit, i, -1), np.where(hit, self.counts(names[1:], part, i, dtype), 0)

    def counts(self, names: tuple[str, str], part: int, i: np.ndarray, dtype) -> np.ndarray:
        times = self.array(names[0], part, dtype)[i].astype(np.int64)
        many = np.flatnonzero(times == np.iinfo(dtype).max)
        if len(many):
            often = self.array(names[1], part, U).reshape(2, -1)
            times[many] = often[1][np.searchsorted(often[0], i[many].astype(U))].astype(np.int64)
        return times

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(range, place in it, count) of ascending pairs."""
        at = self.words.pair_range(keys)
        place, count = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for a, b in _runs(at):
            place[a:b], count[a:b] = self._find(("pair", "times", "often"), int(at[a]), keys[a:b], np.uint16)
        return at, place, count

    def index(self, seq: np.ndarray, prev: np.ndarray) -> np.ndarray:
        """The index among all pairs of each token with the one before; -1 if unknown."""
        out = np.full(len(seq), -1, dtype=np.int64)
        both = np.flatnonzero((seq >= 0) & (prev >= 0))
        keys, back = np.unique(prev[both].astype(U) << U(32) | seq[both].astype(U), return_inverse=True)
        at, place, _ = self.find(keys)
        out[both] = np.where(place >= 0, self.first[at] + place, -1)[back]
        return out

    def part_of(self, index: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, index, side="right") - 1

    def triple_range(self, keys: np.ndarray) -> np.ndarray:
        part = self.part_of((keys >> U(32)).astype(np.int64))
        cuts = np.array(self.meta["cuts"], dtype=np.int64)[part]
        return self.first_cut[part] + (keys & U(0xFFFFFFFF)).astype(np.int64) * cuts // int(self.words.first[-1] + 1)

    def triple_counts(self, keys: np.ndarray) -> np.ndarray:
        at = self.triple_range(keys)
        order = np.argsort(at, kind="stable")
        out = np.zeros(len(keys), dtype=np.int64)
        for a, b in _runs(at[order]):
            q = order[a:b]
            out[q] = self._find(("triple", "triple-times", "triple-often"), int(at[q[0]]), keys[q], np.uint8)[1]
        return out

    def beside(self, at: np.ndarray, place: np.ndarray, count: np.ndarray, *names: str) -> list[np.ndarray]:
        """Values beside the pairs of ascending ranges; those of a pair seen once are 0."""
        out = [np.zeros(len(at), dtype=np.int64) for _ in names]
        for a, b in _runs(at):
            q = a + np.flatnonzero(count[a:b] > 1)
            if len(q):
                i = np.searchsorted(self.array("repeated", int(at[a]), np.uint32), place[q].astype(np.uint32))
                for o, name in zip(out, names, strict=True):
                    o[q] = self.array(name, int(at[a]), np.uint32)[i]
        return out


def _count_triples(meta: dict):
    def run(batches):
        words = Words(meta)
        pairs = Pairs(words)
        got = _Gather(pairs.triple_range)
        for b in sub_batches(batches, BATCH):
            for _, _, raw, off in tokens.slices(b.column("text")):
                seq, prev, bounds = _sequence(words, raw, off)
                index = pairs.index(seq, prev)
                later = np.ones(len(seq), dtype=bool)
                later[bounds[:-1]] = False
                t = np.flatnonzero(later)
                yield from got.add(index[t - 1].astype(U) << U(32) | seq[t].astype(U))
        yield from got.flush()
    return run


def _write_triples(meta: dict):
    """Writes a range's triples; rows for the pair ranges: followers with counts 1, 2, 3+ of each
    repeated context here, and predecessors of each repeated pair."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cut, words = int(pdf["part"][0]), Words(meta)
        pairs = Pairs(words)
        part = int(np.searchsorted(pairs.first_cut, cut, side="right") - 1)
        keys, counts = add_up([tuple(unpack(b)) for b in pdf["blob"]])
        times, often = _times(counts, np.uint8)
        save(f"{meta['root']}/triple-{cut}", keys)
        save(f"{meta['root']}/triple-times-{cut}", times)
        save(f"{meta['root']}/triple-often-{cut}", often)
        rows = [(-1, "coc", pack(np.arange(4).astype(U), np.array(_count_of_counts(counts))))]
        place = (keys >> U(32)).astype(np.int64) - pairs.first[part]
        own, first = np.unique(place, return_index=True)
        repeated = pairs.array("times", part, np.uint16)[own] > 1
        followers = [np.add.reduceat((counts == i) if i < 3 else (counts >= 3), first, dtype=np.int64)[repeated]
                     for i in (1, 2, 3)]
        if repeated.any():
            rows.append((part, "after", pack(own[repeated].astype(U), *followers)))
        v = np.asarray(pairs.array("pair", part, U))[place] & U(0xFFFFFFFF)
        later, before = np.unique(v << U(32) | (keys & U(0xFFFFFFFF)), return_counts=True)
        at, place, count = pairs.find(later)
        keep = count > 1
        at, place, before = at[keep], place[keep], before[keep]
        rows += [(int(at[a]), "before", pack(place[a:b].astype(U), before[a:b])) for a, b in _runs(at)]
        return pd.DataFrame(rows, columns=["range", "kind", "blob"])
    return run


def _write_beside_pairs(meta: dict):
    """Writes what stands beside a range's repeated pairs; rows for the word ranges: of each word its
    followers with continuation counts 1, 2, 3+ and the sum of those counts."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, words = int(pdf["range"][0]), Words(meta)
        pairs = Pairs(words)
        keys = np.asarray(pairs.array("pair", part, U))
        total = pairs.counts(("times", "often"), part, np.arange(len(keys)), np.uint16)
        repeated = np.flatnonzero(total > 1)
        after, before = np.zeros((3, len(repeated)), np.int64), np.zeros(len(repeated), np.int64)
        for kind, blob in zip(pdf["kind"], pdf["blob"], strict=True):
            if kind == "size":
                continue
            place, *values = unpack(blob)
            i = np.searchsorted(repeated, place.astype(np.int64))
            if kind == "after":
                after[:, i] += np.stack(values)
            else:
                before[i] += values[0]
        start = (keys[repeated] >> U(32)) == START
        before[start] = total[repeated][start]
        save(f"{meta['root']}/repeated-{part}", repeated.astype(np.uint32))
        for i in range(3):
            save(f"{meta['root']}/pair-after{i + 1}-{part}", after[i].astype(np.uint32))
        save(f"{meta['root']}/pair-before-{part}", before.astype(np.uint32))
        a = np.ones(len(keys), np.int64)
        a[repeated] = before
        rows = [(-1, "coc", pack(np.arange(4).astype(U), np.array(_count_of_counts(a))))]
        v, first = np.unique((keys >> U(32)).astype(np.int64), return_index=True)
        sums = [np.add.reduceat((a == i) if i < 3 else (a >= 3), first, dtype=np.int64) for i in (1, 2, 3)]
        sums.append(np.add.reduceat(a, first))
        at = words.part_of(v)
        rows += [(int(at[x]), "after", pack(v[x:y].astype(U), *[c[x:y] for c in sums])) for x, y in _runs(at)]
        return pd.DataFrame(rows, columns=["range", "kind", "blob"])
    return run


def _count_pairs(meta: dict):
    def run(batches):
        words = Words(meta)
        got = _Gather(words.pair_range)
        for b in sub_batches(batches, BATCH):
            for _, _, raw, off in tokens.slices(b.column("text")):
                seq, prev, _ = _sequence(words, raw, off)
                yield from got.add(prev.astype(U) << U(32) | seq.astype(U))
        yield from got.flush()
    return run


def _count_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in range(1, 5)]


def _write_pairs(meta: dict):
    """Writes a range's pairs; rows for the next step: of each word here its followers with counts
    1, 2, 3+, and its number of predecessors."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, words = int(pdf["part"][0]), Words(meta)
        keys, counts = add_up([tuple(unpack(b)) for b in pdf["blob"]])
        save(f"{meta['root']}/pair-{part}", keys)
        times, often = _times(counts, np.uint16)
        save(f"{meta['root']}/times-{part}", times)
        save(f"{meta['root']}/often-{part}", often)
        rows = [(-1, "coc", pack(np.arange(4).astype(U), np.array(_count_of_counts(counts)))),
                (part, "size", struct.pack("<qq", len(keys), int(counts.sum())))]
        v, first = np.unique((keys >> U(32)).astype(np.int64), return_index=True)
        followers = [np.add.reduceat((counts == i) if i < 3 else (counts >= 3), first, dtype=np.int64) for i in (1, 2, 3)]
        w, before = np.unique((keys & U(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        for kind, ids, values in (("after", v, followers), ("before", w, [before])):
            if kind == "after" and meta["order"] > 2:
                continue  # counted by predecessors later
            at = words.part_of(ids)
            rows += [(int(at[a]), kind, pack(ids[a:b].astype(U), *[x[a:b] for x in values])) for a, b in _runs(at)]
        return pd.DataFrame(rows, columns=["range", "kind", "blob"])
    return run


def _write_neighbours(meta: dict):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, words = int(pdf["range"][0]), Words(meta)
        base = words.first[part] - (WORDS if part == 0 else 0)
        size = int(words.first[part + 1] - base)
        sums = 3 + (meta["order"] > 2)
        after, before = np.zeros((sums, size), np.int64), np.zeros(size, np.int64)
        for kind, blob in zip(pdf["kind"], pdf["blob"], strict=True):
            keys, *values = unpack(blob)
            at = keys.astype(np.int64) - base
            if kind == "after":
                after[:, at] += np.stack(values)
            else:
                before[at] += values[0]
        for i in range(3):
            save(f"{meta['root']}/after{i + 1}-{part}", after[i].astype(np.uint32))
        if sums > 3:
            save(f"{meta['root']}/continued-{part}", after[3].astype(U))
        save(f"{meta['root']}/before-{part}", before.astype(np.uint32))
        return pd.DataFrame([[part, int(before.sum()), int((before >= 3).sum()), *_count_of_counts(before)]],
                            columns=["range", "total", "n3p", "n1", "n2", "n3", "n4"])
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3+; halves of the count where a
    count of counts is missing."""
    out = [0.0]
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = i - (i + 1) * y * b / a if a and b else i / 2
        out.append(float(min(max(d, 0.05), i - 0.05)))
    return out


def _coc(passed: DataFrame) -> list[int]:
    """The counts of counts that the reducers passed on, added up."""
    rows = passed.where("kind = 'coc'").select("blob").collect()
    return [int(x) for x in np.sum([unpack(r["blob"])[1].astype(np.int64) for r in rows], axis=0)] if rows else [0] * 4


def fit(train: DataFrame, text_col: str = "text", pair_mass: int = PAIR_MASS, order: int = 2) -> dict:
    """Counts the model; returns what workers need to open it. ``pair_mass`` bounds a reducer's tokens."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    text = train.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark, root = train.sparkSession, work_path(train.sparkSession, "kneser-ney")
    docs, size = text.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = partitions_for(size, WORD_BYTES, 1)
    rows = {r["part"]: r for r in text.mapInArrow(_count_words(parts), "part int, blob binary").groupBy("part")
            .applyInPandas(_write_words(root), "part int, n long, total long").collect()}
    meta = {"root": root, "order": order, "docs": docs, "n": [rows[p]["n"] if p in rows else 0 for p in range(parts)],
            "total": [rows[p]["total"] if p in rows else 0 for p in range(parts)]}
    n_tokens = docs + sum(meta["total"])
    meta |= {"N": n_tokens, "V": sum(meta["n"]) + (docs > 0), "mass": pair_mass, "pair_parts": partitions_for(n_tokens, pair_mass, 1)}
    if not docs:
        return meta | {"pairs": [], "T": discounts(0, 0, 0, 0), "D": discounts(0, 0, 0, 0), "E": discounts(0, 0, 0, 0),
                       "A": 0, "h": 1.0}
    counted = text.mapInArrow(_count_pairs(meta), "part int, blob binary").groupBy("part")
    passed = materialize(counted.applyInPandas(_write_pairs(meta), "range int, kind string, blob binary"), "kneser-ney-pairs")
    sides = passed.where("kind in ('after', 'before')")
    if order == 2:
        meta |= {"D": discounts(*_coc(passed))}
    else:
        sizes = {r["range"]: struct.unpack("<qq", r["blob"]) for r in passed.where("kind = 'size'").collect()}
        pair_n, mass = ([sizes.get(p, (0, 0))[i] for p in range(meta["pair_parts"])] for i in (0, 1))
        if sum(pair_n) >= 2**32:
            raise ValueError("more than 2^32 different pairs")
        meta |= {"pair_n": pair_n, "cuts": [max(1, m // pair_mass) for m in mass]}
        triples = text.mapInArrow(_count_triples(meta), "part int, blob binary").groupBy("part")
        found = materialize(triples.applyInPandas(_write_triples(meta), "range int, kind string, blob binary"),
                            "kneser-ney-triples")
        beside = (found.where("kind <> 'coc'").union(passed.where("kind = 'size'")).groupBy("range")
                  .applyInPandas(_write_beside_pairs(meta), "range int, kind string, blob binary"))
        beside = materialize(beside, "kneser-ney-continued")
        meta |= {"T": discounts(*_coc(found)), "D": discounts(*_coc(beside))}
        sides = sides.union(beside.where("kind = 'after'"))
    uni = (sides.groupBy("range")
           .applyInPandas(_write_neighbours(meta), "range int, total long, n3p long, n1 long, n2 long, n3 long, n4 long")
           .collect())
    total = {k: sum(r[k] for r in uni) for k in ("total", "n3p", "n1", "n2", "n3", "n4")}
    e = discounts(*[total[f"n{i}"] for i in range(1, 5)])
    freed = (e[1] * total["n1"] + e[2] * total["n2"] + e[3] * total["n3p"]) / total["total"]
    return meta | {"E": e, "A": total["total"], "h": freed}


class Model:
    def __init__(self, meta: dict):
        self.meta, self.words = meta, Words(meta)
        self.pairs = Pairs(self.words)
        self.D, self.E = np.array(meta["D"]), np.array(meta["E"])

    def single(self, ids: np.ndarray) -> np.ndarray:
        """P(w) of each id (-1: unknown)."""
        rest = self.meta["h"] / (self.meta["V"] + 1)
        p = np.full(len(ids), rest)
        w = np.flatnonzero(ids >= 0)
        if self.meta["A"] and len(w):
            a = self.words.column("before", ids[w], np.uint32, WORDS).astype(np.int64)
            p[w] += np.maximum(a - self.E[np.minimum(a, 3)], 0) / self.meta["A"]
        return p

    def freed(self, ids: np.ndarray) -> np.ndarray:
        """g(v) c(v): what the discounts take from the followers of each context."""
        return sum(self.D[i] * self.words.column(f"after{i}", ids, np.uint32, WORDS) for i in (1, 2, 3))

    def probabilities(self, seq: np.ndarray, prev: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """P of each token after what stands before it. ``starts``: each text's first token."""
        distinct, inverse = np.unique(seq, return_inverse=True)
        low = self.single(distinct)[inverse]
        ctx, where = np.unique(prev, return_inverse=True)
        total, free = np.zeros(len(ctx)), np.zeros(len(ctx))
        known = np.flatnonzero((ctx >= 0) & (self.meta["docs"] > 0))
        if not len(known):
            return low
        three = self.meta["order"] > 2
        total[known] = self.words.column("continued", ctx[known], U, WORDS) if three else self.words.counts(ctx[known])
        free[known] = self.freed(ctx[known])
        both = np.flatnonzero((seq >= 0) & (prev >= 0))
        keys, back = np.unique(prev[both].astype(U) << U(32) | seq[both].astype(U), return_inverse=True)
        at, place, count = self.pairs.find(keys)
        if three:
            *after, before = self.pairs.beside(at, place, count, "pair-after1", "pair-after2", "pair-after3", "pair-before")
        c = np.zeros(len(seq), dtype=np.int64)
        c[both] = (np.where(count == 1, 1, before) if three else count)[back]
        t = total[where]
        high = (np.maximum(c - self.D[np.minimum(c, 3)], 0) + free[where] * low) / np.maximum(t, 1)
        p = np.where(t > 0, high, low)
        if not three:
            return p
        T = np.array(self.meta["T"])
        mine = np.full(len(seq), -1, dtype=np.int64)  # the known pair that ends at each token
        mine[both] = np.where(count > 0, np.arange(len(keys)), -1)[back]
        later = np.ones(len(seq), dtype=bool)
        later[starts] = False
        q = np.flatnonzero(later)
        q = q[mine[q - 1] >= 0]
        ctx = mine[q - 1]
        c, ok = np.zeros(len(q), dtype=np.int64), np.flatnonzero(seq[q] >= 0)
        index = (self.pairs.first[at] + place)[ctx[ok]]
        keys, back = np.unique(index.astype(U) << U(32) | seq[q[ok]].astype(U), return_inverse=True)
        c[ok] = self.pairs.triple_counts(keys)[back]
        free = np.where(count == 1, T[1], sum(T[i + 1] * x for i, x in enumerate(after)))
        p[q] = (np.maximum(c - T[np.minimum(c, 3)], 0) + free[ctx] * p[q]) / count[ctx]
        return p


def _score(meta: dict):
    def run(batches):
        model = Model(meta)
        words, N, V = model.words, meta["N"], meta["V"]
        for b in sub_batches(batches, BATCH):
            for lo, hi, raw, off in tokens.slices(b.column("text"), BATCH):
                seq, prev, bounds = _sequence(words, raw, off)
                at = bounds[:-1]
                distinct, inverse = np.unique(seq, return_inverse=True)
                count = np.where(distinct == END, meta["docs"], words.counts(distinct))[inverse]
                base = np.add.reduceat(np.log10((count + 1) / (N + V + 1)), at)
                own = np.add.reduceat(np.log10(model.probabilities(seq, prev, at)), at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), pa.array(np.diff(bounds)),
                     pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(base), pa.array(own)],
                    names=["id", "n_tokens", "n_known", "base_score", "score"])
    return run


def score(docs: DataFrame, meta: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity): log10 probabilities of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = d.mapInArrow(_score(meta), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))) \
        .withColumnRenamed("id", id_col)
