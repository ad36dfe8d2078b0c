"""Language identification by nearest centroid.

A text's vector holds hashed byte n-grams (one to three bytes; A-Z as a-z,
everything of ASCII that is no letter as a space), weighted 1 + log(tf) times
the idf over all training texts, and normalised. Each language has several
centroids, found by spherical k-means on a bounded sample of its texts
(about ``SAMPLE`` different rows of each language by a hash of id and text, ``AT_MOST`` times
that at the most; the idf covers all training texts). A text goes to the centroid of the largest cosine, and is
rejected (language ``und``) if its distance to it is beyond ``SLACK`` times
the 0.99 quantile of that centroid's own members.

Defined results: a null text, or one without any letter, is ``und`` with score
0; so is every text if there is no training row. Equal cosines go to the
smaller (language, centroid). Rows with a null language train nothing.
Repeated rows each get their row; other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareshift.llm import tokens
from fareshift.llm.common import sub_batches

DIM = 4096
SAMPLE = 1000
AT_MOST = 2
CENTROIDS = 4
SLACK = 1.5
UND = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def ngram_counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, DIM) counts of the hashed n-grams of each text."""
    n = len(off) - 1
    if not len(raw):
        return np.zeros((n, DIM), dtype=np.int64)
    sizes = np.diff(off)
    b = _FOLD[raw]
    row = np.repeat(np.arange(n, dtype=np.int64) * DIM, sizes)
    inside = np.ones(len(raw), dtype=bool)  # the gram that starts here ends within its text
    slots, gram = [], np.zeros(len(raw), dtype=np.uint32)
    for k in range(3):
        gram = gram[:len(raw) - k] * np.uint32(257) + b[k:] + np.uint32(k + 1)
        if k:
            inside[off[1:][sizes >= k] - k] = False
        slot = row[:len(gram)] + ((gram * np.uint32(2654435761)) >> np.uint32(20))
        slots.append(slot[inside[:len(gram)]] if k else slot)
    return np.bincount(np.concatenate(slots), minlength=n * DIM).reshape(n, DIM)


_WEIGHT = np.concatenate([[0], 1 + np.log(np.arange(1, 4096))]).astype(np.float32)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = _WEIGHT[np.minimum(counts, len(_WEIGHT) - 1)]
    many = counts >= len(_WEIGHT)
    v[many] = 1 + np.log(counts[many])
    v *= idf.astype(np.float32)
    return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]


def _document_frequency(batches):
    df, n = np.zeros(DIM, dtype=np.int64), 0
    for batch in batches:
        for _, _, raw, off in tokens.slices(batch.column("text")):
            counts = ngram_counts(raw, off)
            df += (counts > 0).sum(axis=0)
            n += len(counts)
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.arange(DIM), -1).astype(np.int32)), pa.array(np.append(df, n))],
            names=["slot", "n"])


def _sample_vectors(idf: np.ndarray):
    def run(batches):
        for b in sub_batches(batches):
            for lo, hi, raw, off in tokens.slices(b.column("text")):
                v = _vectors(ngram_counts(raw, off), idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [b.column("lang").slice(lo, hi - lo), b.column("h").slice(lo, hi - lo),
                     pa.array([x.tobytes() for x in v], pa.binary())],
                    names=["lang", "h", "v"])
    return run


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit rows by cosine, started farthest-first; and each row's centroid."""
    c = [x.mean(axis=0)]
    c[0] = c[0] / max(np.linalg.norm(c[0]), 1e-12)
    near = x @ c[0]
    while len(c) < min(k, len(x)):
        i = int(near.argmin())
        if near[i] > 1 - 1e-6:
            break
        c.append(x[i])
        near = np.maximum(near, x @ x[i])
    c = np.array(c)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c, (x @ c.T).argmax(axis=1)


def _cluster(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v", ignore_index=True)  # the same result whatever the order of arrival
        x = np.stack([np.frombuffer(v, dtype=np.float16) for v in pdf["v"]]).astype(np.float32)
        c, own = spherical_kmeans(x, k)
        rows = []
        for j in range(len(c)):
            d = 1 - x[own == j] @ c[j]
            rows.append((pdf["lang"][0], j, c[j].astype(float).tolist(), float(np.quantile(d, 0.99)) if len(d) else 0.0))
        return pd.DataFrame(rows, columns=["lang", "no", "centroid", "spread"])
    return run


def sample_vectors(t: DataFrame, idf: np.ndarray, per_lang: dict[str, int], sample: int) -> DataFrame:
    """(lang, v) of about ``sample`` rows of each language, ``AT_MOST`` times that at the most: those whose
    hash of id and text is small, equal rows once."""
    whole = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, m in per_lang.items() for x in (lang, min(whole, whole * sample // m))])
    hashed = t.select("lang", "text", F.xxhash64("id", "text").alias("h"))
    chosen = hashed.where(F.pmod("h", F.lit(whole)) < F.element_at(share, F.col("lang")))
    vectors = chosen.mapInArrow(_sample_vectors(idf), "lang string, h long, v binary").dropDuplicates(["lang", "h"])
    first = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(whole)), "h")
    return vectors.withColumn("r", F.row_number().over(first)).where(F.col("r") <= AT_MOST * sample).select("lang", "v")


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample: int = SAMPLE, k: int = CENTROIDS) -> dict:
    """The model: idf, centroids, their languages and rejection distances. ``sample`` bounds the
    texts of each language that are clustered."""
    t = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    t = t.where(F.col("text").rlike(r"\p{L}"))
    df = {r["slot"]: r["n"] for r in t.select("text").mapInArrow(_document_frequency, "slot int, n long")
          .groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    n = df.pop(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([df.get(i, 0) for i in range(DIM)]))) + 1
    per_lang = {r["lang"]: r["n"] for r in t.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, centroids, spreads = [], [], []
    if per_lang:
        rows = (sample_vectors(t, idf, per_lang, sample)
                .groupBy("lang").applyInPandas(_cluster(k), "lang string, no int, centroid array<double>, spread double")
                .collect())
        for r in sorted(rows, key=lambda r: (r["lang"], r["no"])):
            langs.append(r["lang"])
            centroids.append(r["centroid"])
            spreads.append(r["spread"])
    return {"idf": idf, "langs": langs, "centroids": np.array(centroids, dtype=np.float32).reshape(-1, DIM),
            "spreads": np.array(spreads)}


def _predict(model: dict, slack: float):
    def run(batches):
        for b in sub_batches(batches):
            nearest, score, out = [], [], []
            letters = np.asarray(b.column("letters"))
            for lo, hi, raw, off in tokens.slices(b.column("text")):
                if not model["langs"]:
                    near, cos, far = np.zeros(hi - lo, int), np.zeros(hi - lo), np.ones(hi - lo, bool)
                else:
                    sim = _vectors(ngram_counts(raw, off), model["idf"]) @ model["centroids"].T
                    near = sim.argmax(axis=1)
                    cos = np.clip(sim[np.arange(len(sim)), near], 0, 1).astype(float)
                    far = 1 - cos > slack * model["spreads"][near] + 1e-6
                ok = letters[lo:hi] & bool(model["langs"])
                names = [model["langs"][i] if o else UND for i, o in zip(near, ok, strict=True)]
                nearest += names
                score += np.where(ok, cos, 0.0).tolist()
                out += [UND if f else x for f, x in zip(far, names, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(out, pa.string()), pa.array(nearest, pa.string()),
                 pa.array(score, pa.float64())], names=["id", "lang", "nearest", "score"])
    return run


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
             slack: float = SLACK) -> DataFrame:
    """(id_col, lang, nearest, score): ``lang`` is ``und`` where the nearest centroid is too far;
    ``nearest`` is its language all the same, ``score`` the cosine."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    return d.mapInArrow(_predict(model, slack), f"id {kind}, lang string, nearest string, score double") \
        .withColumnRenamed("id", id_col)
