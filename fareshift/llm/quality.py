"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` reads every whole text once and gives its numbers; ``fit``
learns from a bounded sample of labelled rows (about ``TRAIN_ROWS``, by a
hash of the id, a tenth more at most); the trees are complete binary trees flattened into arrays, and
``predict`` walks them for many rows at once.

Defined results: null and empty texts have all statistics 0 and get a score;
labels other than 0 and 1 teach nothing; without any training row every score
is 0.5. Repeated rows each get their row; other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareshift.llm import tokens
from fareshift.llm.common import hashed_share, sub_batches

TRAIN_ROWS = 20_000
FEATURES = (
    "log_bytes", "log_words", "log_lines", "upper", "digit", "space", "punctuation", "symbol", "high",
    "entropy", "word_mean", "word_sd", "word_max", "short_words", "wordless", "marked_words", "distinct_words",
    "top_word", "distinct_shingles", "distinct_lines", "line_words", "ended_lines", "sentence_marks",
    "repeated_bytes", "capital_words", "pipe", "bang")

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower, 3 digit, 4 space, 5 punctuation, 6 symbol, 7 not ASCII
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_LINES = np.ones(256, dtype=bool)
_LINES[10] = False


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct values, and how often the most frequent one occurs."""
    distinct, most = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if b > a:
            s = np.sort(h[a:b])
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            distinct[i], most[i] = len(at) - 1, np.diff(at).max()
    return distinct, most


def text_statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) numbers of each text."""
    n, size = len(off) - 1, np.diff(off).astype(float)
    one = np.maximum(size, 1)
    kind = _CLASS[raw]
    share = {k: _per_text(kind == k, off) / one for k in (1, 2, 3, 4, 5, 6, 7)}
    row = np.repeat(np.arange(n), np.diff(off))
    freq = np.bincount(row * 256 + raw, minlength=n * 256).reshape(n, 256) / one[:, None]
    entropy = -(freq * np.log2(np.maximum(freq, 1e-12))).sum(axis=1)

    starts, ends, wb = tokens.word_spans(raw, off, tokens.SPACED)
    h = tokens.hash_spans(raw, starts, ends)
    words = np.diff(wb).astype(float)
    w1 = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = _per_text(length, wb) / w1
    sd = np.sqrt(np.maximum(_per_text(length ** 2, wb) / w1 - mean ** 2, 0))
    longest = np.zeros(n)
    some = words > 0
    if len(length):
        longest[some] = np.maximum.reduceat(length, wb[:-1][some])
    letter = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2) | (kind == 7))])
    wordless = (letter[ends] - letter[starts] == 0) if len(starts) else np.zeros(0)
    marked = kind[ends - 1] == 6 if len(ends) else np.zeros(0)
    capital = kind[starts] == 1 if len(starts) else np.zeros(0)
    distinct, most = _repeats(h, wb)
    s, sb = tokens.shingle_hashes(h, wb, 3)
    shingles, _ = _repeats(s, sb)

    ls, le, lb = tokens.word_spans(raw, off, _LINES)
    lines = np.diff(lb).astype(float)
    l1 = np.maximum(lines, 1)
    ended = np.isin(raw[le - 1], [ord(c) for c in ".!?"]) if len(le) else np.zeros(0)
    line_kinds, _ = _repeats(tokens.hash_spans(raw, ls, le), lb)
    same = np.zeros(len(raw))
    if len(raw):
        same[1:] = raw[1:] == raw[:-1]
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), share[1], share[3], share[4], share[5], share[6], share[7],
        entropy, mean, sd, longest, _per_text(length <= 3, wb) / w1, _per_text(wordless, wb) / w1,
        _per_text(marked, wb) / w1, distinct / w1, most / w1, shingles / np.maximum(np.diff(sb), 1),
        line_kinds / l1, words / l1, _per_text(ended, lb) / l1,
        _per_text(np.isin(raw, [ord(c) for c in ".!?"]), off) / w1, _per_text(same, off) / one,
        _per_text(capital, wb) / w1, _per_text(raw == ord("|"), off) / one, _per_text(raw == ord("!"), off) / one])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, f0, f1, ...): the statistics of every whole text, one column for each of FEATURES."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches):
        for b in sub_batches(batches):
            parts = [text_statistics(raw, off) for _, _, raw, off in tokens.slices(b.column("text"))]
            x = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c) for c in x.T]], names=["id", *names])

    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} double" for c in names)).withColumnRenamed("id", id_col)


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 150, depth: int = 4, rate: float = 0.1, bins: int = 64,
              l2: float = 1.0, least: int | None = None) -> dict:
    """Boosted trees for the logistic loss. Node i has the children 2i+1 and 2i+2; a node that is
    not split sends all rows left. A child has at least ``least`` rows: 20, but of a few hundred rows or fewer a
    sixteenth, 5 at least, as 20 would leave nothing to split."""
    if least is None:
        least = min(20, max(5, len(y) // 16))
    inner, leaves = 2**depth - 1, 2**depth
    model = {"feature": np.zeros((trees, inner), np.int32), "cut": np.full((trees, inner), np.inf),
             "leaf": np.zeros((trees, leaves)), "bias": 0.0, "depth": depth}
    if not len(y):
        return model
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model["bias"] = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    feats = x.shape[1]
    flat = code + np.arange(feats) * bins
    raw = np.full(len(y), model["bias"])
    for t in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (feats * bins) + flat).ravel()
            shape, many = (width, feats, bins), width * feats * bins
            G = np.bincount(slot, np.repeat(g, feats), many).reshape(shape).cumsum(axis=2)
            H = np.bincount(slot, np.repeat(h, feats), many).reshape(shape).cumsum(axis=2)
            N = np.bincount(slot, minlength=many).reshape(shape).cumsum(axis=2)
            gt, ht, nt = G[..., -1:], H[..., -1:], N[..., -1:]
            gain = G**2 / (H + l2) + (gt - G)**2 / (ht - H + l2) - gt**2 / (ht + l2)
            gain[(N < least) | (nt - N < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for j in range(width):
                f, b = divmod(int(best[j]), bins)
                if gain[j, f, b] > 1e-9 and b < len(edges[f]):
                    model["feature"][t, first + j], model["cut"][t, first + j] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), model["feature"][t, node]] > model["cut"][t, node])
        at = node - inner
        model["leaf"][t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        raw += model["leaf"][t, at]
    return model


def traverse(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1: all rows go down each tree together."""
    raw, rows = np.full(len(x), model["bias"]), np.arange(len(x))
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"], strict=True):
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        raw += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-raw))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        rows: int = TRAIN_ROWS, **options) -> dict:
    """Learn ``label_col`` of ``labels`` from the statistics of the same ids; ``rows`` bounds the sample."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    names = [c for c in stats.columns if c != id_col]
    labelled = stats.join(known, stats[id_col] == known["_id"])
    # First by a hashed share, so that no task hands the driver more than its part of the sample.
    chosen = labelled.where(hashed_share(F.col("_id"), rows, known.count()))
    sample = (chosen.orderBy(F.xxhash64(F.col("_id")), "_id", "y", *names).limit(rows + rows // 10)
              .select("y", *names).toPandas())
    return fit_trees(sample[names].to_numpy(float), sample["y"].to_numpy(float), **options)


def predict(stats: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """(id_col, score): the probability of label 1."""
    kind = stats.schema[id_col].dataType.simpleString()
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches):
        for b in batches:
            x = np.column_stack([np.asarray(b.column(c), dtype=float) for c in names])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(traverse(model, x))], names=["id", "score"])

    return stats.withColumnRenamed(id_col, "id").mapInArrow(run, f"id {kind}, score double") \
        .withColumnRenamed("id", id_col)


def filter_rows(docs: DataFrame, model: dict, cut: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``cut`` or more, all columns as they are."""
    def run(batches):
        for b in sub_batches(batches):
            x = np.concatenate([text_statistics(raw, off) for _, _, raw, off in tokens.slices(b.column(text_col))])
            yield b.filter(pa.array(traverse(model, x) >= cut))

    return docs.mapInArrow(run, docs.schema)
