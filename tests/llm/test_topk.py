"""Exact top-k against all pairs."""

import math

import pytest
from pyspark.sql import functions as F

from fareshift.llm import topk

SCHEMA = "vec_id long, embedding array<float>, dim string, pivot int, least long"


def data():
    import random

    rng = random.Random(3)
    v = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(150)]
    rows = [(i, x) for i, x in enumerate(v)]
    rows += [(200 + i, v[7]) for i in range(60)]                     # a hot vector, ties
    rows += [(300, None), (301, []), (302, [1.0, None] + [0.0] * 6), (303, [math.nan] * 8), (304, [math.inf] * 8),
             (305, [0.5, 0.25]), (306, [0.5, -0.25]), (310, [0.0] * 8), (None, v[3])]
    return rows + [rows[5], rows[10]]


def brute(k):
    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows_as_float()
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, q in good:
        if i % 10 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in good if j != i and len(x) == len(q))
            out |= {(i, r + 1, j, -t) for r, (t, j) in enumerate(s[:k])}
    return out


def rows_as_float():
    import struct

    narrow = lambda x: struct.unpack("f", struct.pack("f", x))[0] if x is not None else None
    return [(i, None if v is None else [narrow(x) for x in v]) for i, v in data()]


@pytest.mark.parametrize("k, pivots, block", [(5, 8, 16), (300, 3, 32)])
def test_top_k_equals_all_pairs(spark, k, pivots, block):
    df = spark.createDataFrame([(i, v, "clash", 1, 2) for i, v in data()], SCHEMA).repartition(3)
    vectors = topk.quantised(df, "vec_id", "embedding")
    out = topk.top_k(vectors, vectors.where(F.col("id") % 10 == 0), k, pivots, block)
    assert {tuple(r) for r in out.collect()} == brute(k)


@pytest.mark.parametrize("block", [4, 1024])
def test_vectors_of_one_id_with_equal_scores_are_one_candidate(spark, block):
    rows = [(0, [1.0, 0.0])] + [(1, [9.0, float(y)]) for y in range(8)] + [(i, [10.0 - i, 0.0]) for i in range(2, 10)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    out = topk.top_k(vectors, vectors.where("id = 0"), 5, 3, block).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in out) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_top_k_of_nothing(spark):
    vectors = topk.quantised(spark.createDataFrame([], SCHEMA), "vec_id", "embedding")
    assert topk.top_k(vectors, vectors).count() == 0


@pytest.mark.parametrize("block", [2, 1024])
def test_large_components_take_part(spark, block):
    rows = [(0, [1.0, 0.0]), (10, [0.0, 1.0]), (20, [2.0**60, 3.0]), (1, [2e13, 1.0]), (2, [5.0, 2.0]), (3, [-3e18, 2.5]),
            (4, [1e200, 7.0]), (5, [-1e300, 0.5]), (6, [0.25, 2.0**52 + 1]), (7, [4.0, 2.0]), (8, [2e13, 1.0]), (9, [math.inf, 1.0])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    out = topk.top_k(vectors, vectors.where(F.col("id") % 10 == 0), 20, 3, block)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i != 9]
    want = set()
    for i, q in whole:
        if i % 10 == 0:
            score = lambda x, q=q: max(-topk.LONGEST, min(topk.LONGEST, sum(a * b for a, b in zip(q, x, strict=True))))
            found = sorted((-score(x), j) for j, x in whole if j != i)
            want |= {(i, r + 1, j, -t) for r, (t, j) in enumerate(found)}
    assert {tuple(r) for r in out.collect()} == want
    best = topk.top_k(vectors.where("id < 4"), vectors.where("id = 0"), 1, 2, block).first()
    assert tuple(best) == (0, 1, 1, 256 * math.floor(256 * 2e13))
