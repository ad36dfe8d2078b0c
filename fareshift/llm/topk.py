"""Exact top-k inner products with a pivot-distance index.

Vectors are lifted by one coordinate, sqrt(M^2 - |x|^2) with M the largest
norm, a query by 0. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x: the largest inner
products are the nearest lifted vectors, and the triangle inequality bounds
them. The index keys every vector by its nearest pivot and its distance to it;
each pivot's distances are cut into annuli, and each annulus into blocks of
bounded size. A search looks first into the annulus the query falls in, which
gives a k-th best score; then it expands, at every pivot p, only the annuli
that meet [d(q,p) - R, d(q,p) + R], where R is the distance of that score.
Beyond these annuli no vector can reach the score, so the result is exact.

Pivots come from a bounded sample (about ``PIVOT_SAMPLE`` vectors of a length, by a
hash of the id, twice that at most); every vector is indexed. Blocks hold about ``BLOCK_ROWS`` vectors: a
group of equal vectors shares one distance and is cut by a hash of the id.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; vectors meet only vectors of the same length; equal
scores rank by the smaller id; rows with the query's own id are no candidates;
a repeated (id, vector) row counts once, so does an id whose vectors score alike; null ids take no part. Every finite
component counts, as long as ``scale`` times it is finite. Scores are exact whatever the components' size; one that does
not fit a long is given, and ranked, as +-(2^63 - 1).

Vectors hold whole numbers as doubles, which ``scale`` times a double is without rounding. Distances are doubles too:
``_slack`` bounds what they can be off by, and the bounds are widened by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareshift.llm.common import hashed_share, materialize, partitions_for, sub_batches

PIVOT_SAMPLE = 4096
PIVOTS = 32
BLOCK_ROWS = 1024
QUERY_BLOCK = 1024


LONGEST = 2**63 - 1
WIDE = 2.0**20  # vectors with larger components are scored apart, by wider arithmetic


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, dim, v): components floor(scale * x) as whole doubles, only whole vectors."""
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    v = v.withColumn("x", F.transform("x", lambda x: x * F.lit(float(scale))))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)
    return (v.where(F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", fine))
            .select("id", F.size("x").alias("dim"), F.transform("x", whole).alias("v")).distinct())


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _slack(total, dim: int, unit: float):
    """What a sum of ``dim`` rounded products can be off by, if their sizes add up to ``total``; sums of whole
    numbers below 2^53 are exact."""
    exact = (unit == 1) & (np.asarray(total) < 2.0**53)
    return np.where(exact, 0.0, 4 * (dim + 4) * np.finfo(float).eps * total)


def _lifted_distances(m: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of lifted rows to lifted pivots, by differences (no cancellation)."""
    x = np.column_stack([m, lift])
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first traversal from the sample's first vector."""
    chosen = [0]
    d = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(sample)):
        i = int(d.argmax())
        if d[i] == 0:
            break
        chosen.append(i)
        d = np.minimum(d, ((sample - sample[i]) ** 2).sum(axis=1))
    return sample[chosen]


def fit_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> dict:
    """{dim: (M^2, lifted pivots, unit)} from per-dim norms and a bounded sample. Distances are taken of the vectors
    times ``unit``: 1, or a power of two where squares would not be finite."""
    peak = vectors.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    unit = 1.0 if peak <= 2.0**480 else 2.0**-550
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x * F.lit(unit)) * (x * F.lit(unit)))
    by_dim = vectors.groupBy("dim").agg(F.max(norm).alias("m"), F.count("*").alias("n")).collect()
    out = {}
    for dim, m2, n in by_dim:
        top = (vectors.where((F.col("dim") == dim) & (hashed_share(F.col("id"), sample, n) | F.lit(n <= 2 * sample)))
               .orderBy(F.xxhash64("id"), "v").limit(2 * sample).select("v").collect())
        x = np.array([r["v"] for r in top], dtype=np.float64) * unit
        lift = np.sqrt(np.maximum(m2 - (x ** 2).sum(axis=1), 0))
        out[dim] = (m2, _choose_pivots(np.column_stack([x, lift]), pivots), unit)
    return out


def key_by_pivot(vectors: DataFrame, model: dict) -> DataFrame:
    """Add the nearest pivot and the distance to it."""
    def assign(batches):
        for b in sub_batches(batches):
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                m2, pivots, unit = model[int(dim)]
                x = _matrix(part.column("v"), int(dim)) * unit
                lift = np.sqrt(np.maximum(m2 - (x ** 2).sum(axis=1), 0))
                d = _lifted_distances(x, lift, pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("dim"), part.column("v"), pa.array(near.astype(np.int32)),
                     pa.array(d[np.arange(len(near)), near])],
                    names=["id", "dim", "v", "pivot", "dist"])
    return vectors.mapInArrow(assign, "id long, dim int, v array<double>, pivot int, dist double")


def build_index(vectors: DataFrame, model: dict, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, dict]:
    """The block table (dim, pivot, annulus, salt, ids, values) and, per (dim, pivot), the annuli's
    edges. Edges are quantiles of the distances, so annuli hold about ``block_rows`` vectors; the
    number of edges is bounded by rows / block_rows."""
    keyed = materialize(key_by_pivot(vectors, model), "topk-keyed")
    counts = {(r["dim"], r["pivot"]): (r["n"], r["lo"], r["hi"]) for r in keyed.groupBy("dim", "pivot").agg(
        F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()}
    most = max((n for n, _, _ in counts.values()), default=0)
    cuts = partitions_for(most, block_rows)
    edges = {}
    if counts:
        q = [i / cuts for i in range(1, cuts)]
        rows = keyed.groupBy("dim", "pivot").agg(
            (F.percentile_approx("dist", q, 10 * cuts) if q else F.array().cast("array<double>")).alias("q")).collect()
        for r in rows:
            n, lo, hi = counts[r["dim"], r["pivot"]]
            step = max(1, most // max(1, n))  # a small pivot keeps every step-th edge
            edges[r["dim"], r["pivot"]] = np.unique(np.array([lo, *r["q"][step - 1::step], hi]))

    def annuli(batches):
        for b in batches:
            if not b.num_rows:
                continue
            near, dims = np.asarray(b.column("pivot")), np.asarray(b.column("dim"))
            d, a = np.asarray(b.column("dist")), np.zeros(b.num_rows, dtype=np.int32)
            for key in {*zip(dims.tolist(), near.tolist(), strict=True)}:
                m = (dims == key[0]) & (near == key[1])
                e = edges[key]
                a[m] = np.clip(np.searchsorted(e, d[m], side="right") - 1, 0, max(0, len(e) - 2))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a)], names=[*b.schema.names, "annulus"])

    placed = keyed.mapInArrow(annuli, "id long, dim int, v array<double>, pivot int, dist double, annulus int")
    sizes = placed.groupBy("dim", "pivot", "annulus").agg(F.count("*").alias("n"))
    salted = (placed.join(sizes, ["dim", "pivot", "annulus"])
              .withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block_rows)).cast("int")))

    blocks = (salted.groupBy("dim", "pivot", "annulus", "salt")
              .agg(F.collect_list(F.struct("id", "v")).alias("members"))
              .select("dim", "pivot", "annulus", "salt", F.col("members.id").alias("ids"),
                      F.flatten("members.v").alias("values")))
    return materialize(blocks, "topk-blocks"), edges


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point, long or Python's integers, whichever holds every sum."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q @ x.T).astype(np.int64)
    if top < 2**62 and max(np.abs(q).max(), np.abs(x).max()) < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    rows, columns = ([[int(c) for c in v] for v in m.tolist()] for m in (q, x))
    return np.array([[min(max(sum(map(int.__mul__, a, b)), -LONGEST), LONGEST) for b in columns] for a in rows], dtype=np.int64)


def _exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of all rows of ``q`` and ``x``; those with large components meet the others apart."""
    def parts(m: np.ndarray) -> list[np.ndarray]:
        wide = np.abs(m).max(axis=1) > WIDE
        return [p for p in (np.flatnonzero(~wide), np.flatnonzero(wide)) if len(p)]

    out = np.empty((len(q), len(x)), dtype=np.int64)
    for i in parts(q):
        for j in parts(x):
            out[np.ix_(i, j)] = _scores(q[i], x[j])
    return out


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, least: np.ndarray, k: int):
    """Per query (row) its k best candidates at or above ``least``; ties to the smaller id. Vectors of
    one id with equal scores are one candidate."""
    for i in range(len(scores)):
        ok = np.flatnonzero((scores[i] >= least[i]) & (ids != own[i]))
        if len(ok):
            ok = ok[np.lexsort((ids[ok], -scores[i][ok]))]
            new = np.ones(len(ok), dtype=bool)
            new[1:] = (ids[ok][1:] != ids[ok][:-1]) | (scores[i][ok][1:] != scores[i][ok][:-1])
            take = ok[new][:k]
            yield own[i], ids[take], scores[i][take]


RESULT = "query_id long, vec_id long, score long"


def _scan(k: int):
    """Rows: a block and one chunk of the queries that have to look into it."""
    def scan(batches):
        for b in sub_batches(batches):
            qid, vid, val = [], [], []
            for r in range(b.num_rows):
                dim = b.column("dim")[r].as_py()
                own = np.asarray(b.column("q_ids")[r].values)
                q = np.asarray(b.column("q_values")[r].values).reshape(-1, dim)
                least = np.asarray(b.column("q_least")[r].values)
                ids = np.asarray(b.column("ids")[r].values)
                x = np.asarray(b.column("values")[r].values).reshape(-1, dim)
                for one, take, s in _best(_exact_scores(q, x), ids, own, least, k):
                    qid.append(np.full(len(take), one))
                    vid.append(take)
                    val.append(s)
            if qid:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (qid, vid, val)],
                                                 names=["query_id", "vec_id", "score"])
    return scan


def _search(visits: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """``visits``: (dim, pivot, annulus, q_id, v, least). Queries of an annulus go in chunks, each
    chunk meets each block of the annulus; every meeting gives k rows a query at most."""
    at = ["dim", "pivot", "annulus"]
    per = visits.groupBy(*at).agg(F.count("*").alias("n"))
    chunks = (visits.join(per, at)
              .withColumn("chunk", F.pmod(F.xxhash64("q_id"), F.ceil(F.col("n") / QUERY_BLOCK)).cast("int"))
              .groupBy(*at, "chunk").agg(F.collect_list(F.struct("q_id", "v", "least")).alias("qs"))
              .select(*at, F.col("qs.q_id").alias("q_ids"), F.flatten("qs.v").alias("q_values"),
                      F.col("qs.least").alias("q_least")))
    return chunks.join(blocks, at).select("dim", "q_ids", "q_values", "q_least", "ids", "values") \
        .mapInArrow(_scan(k), RESULT)


def _visits(queries: DataFrame, model: dict, edges: dict, k: int, home: bool) -> DataFrame:
    """The annuli each query has to look into: the one it falls in at its nearest pivot (``home``),
    or all that its k-th best score so far (``least``, null if unknown) cannot exclude."""
    def plan(batches):
        for b in sub_batches(batches):
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                m2, pivots, unit = model[int(dim)]
                x = _matrix(part.column("v"), int(dim)) * unit
                d = _lifted_distances(x, np.zeros(len(x)), pivots)
                least = np.asarray(part.column("least").fill_null(-LONGEST))
                known = least > -LONGEST
                own, score = (x ** 2).sum(axis=1), 2 * least.astype(np.float64) * unit * unit
                radius = np.sqrt(np.maximum(own + m2 - score, 0) + _slack(own + m2 + np.abs(score), int(dim), unit))
                radius = np.where(known, radius * (1 + 1e-9) + 1e-6, np.inf)
                off = np.sqrt(_slack(m2, int(dim), unit))  # of a lift, the root of a difference
                rows, piv, ann = [], [], []
                for p in range(len(pivots)):
                    e = edges.get((int(dim), p))
                    if e is None:
                        continue
                    last = max(0, len(e) - 2)
                    if home:
                        r = np.flatnonzero(d.argmin(axis=1) == p)
                        a = np.clip(np.searchsorted(e, d[r, p], side="right") - 1, 0, last)
                        lo, hi = a, a
                    else:
                        slack = 1e-9 * (1 + d[:, p]) + off
                        low, high = d[:, p] - radius - slack, d[:, p] + radius + slack
                        r = np.flatnonzero((high >= e[0]) & (low <= e[-1]))
                        lo = np.clip(np.searchsorted(e, low[r], side="left") - 1, 0, last)
                        hi = np.clip(np.searchsorted(e, high[r], side="right") - 1, 0, last)
                    for i, f, t in zip(r, lo, hi, strict=True):
                        ann.append(np.arange(f, t + 1))
                        rows.append(np.full(t - f + 1, i))
                        piv.append(np.full(t - f + 1, p))
                if rows:
                    take = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("dim").take(take), pa.array(np.concatenate(piv).astype(np.int32)),
                         pa.array(np.concatenate(ann).astype(np.int32)), part.column("id").take(take),
                         part.column("v").take(take), pa.array(least).take(take)],
                        names=["dim", "pivot", "annulus", "q_id", "v", "least"])
    return queries.mapInArrow(plan, "dim int, pivot int, annulus int, q_id long, v array<double>, least long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each of ``queries``; both are
    (id, dim, v) as ``quantised`` makes them."""
    vectors = materialize(vectors, "topk-vectors")
    queries = materialize(queries, "topk-queries")
    model = fit_pivots(vectors, pivots)
    blocks, edges = build_index(vectors, model, block_rows)
    queries = queries.where(F.col("dim").isin([*model]))
    first = materialize(_search(_visits(queries.withColumn("least", F.lit(None).cast("long")), model, edges, k, True),
                                blocks, k), "topk-first")
    kth = (first.distinct().withColumn("r", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") == k)
        .select(F.col("query_id").alias("id"), F.col("score").alias("least")))
    rest = _search(_visits(queries.join(kth, "id", "left").select("id", "dim", "v", "least"), model, edges, k, False),
                   blocks, k)
    ranked = rest.distinct().withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
