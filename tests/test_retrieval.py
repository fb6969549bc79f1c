"""Blocked retrieval against every pair by itself."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from blastradius.operators import retrieval as B

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.StringType())])
QUERIES = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("q", T.ArrayType(T.FloatType()))])


def cosine(a, b):
    n = np.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n else 0.0


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(3)
    grid = lambda n: [float(r.choice([-1, 0, 1, 2])) for _ in range(n)]  # noqa: E731 (few values: many ties)
    rows = [(i, grid(3), r.choice([None, "a", "b"])) for i in range(150)] + [(200, grid(2), "a"), (201, None, "a"), (202, [], "b"), (203, [1.0, None, 2.0], "b"), (204, [0.0] * 3, None)]
    queries = [(i, r.choice([0.5, 0.9, 1.0]), grid(3)) for i in range(37)] + [(90, 1.0, grid(2)), (91, 1.0, None), (92, 1.0, [0.0] * 3)]
    whole = lambda v: v and all(x is not None for x in v)
    pairs = [(q, w, v, lab, cosine(a, b)) for q, w, a in queries if whole(a) for v, b, lab in rows if whole(b) and len(a) == len(b)]
    return spark.createDataFrame(rows, VECTORS).repartition(3), spark.createDataFrame(queries, QUERIES).repartition(2), pairs


@pytest.mark.parametrize("block", [1024, 10])
def test_blocks_equal_pairs(data, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK", block)
    vectors, queries, pairs = data
    by_query = {}
    for p in pairs:
        by_query.setdefault(p[0], []).append(p)
    want = {(q, v, s, i + 1) for q, some in by_query.items() for i, (_, _, v, _, s) in enumerate(sorted(some, key=lambda p: (-p[4], p[2]))[:4])}
    assert {(r.query_id, r.vec_id, r.similarity, r["rank"]) for r in B.nearest(vectors, queries, 4).collect()} == want
    assert {(r.query_id, r.vec_id, r.label, r.similarity) for r in B.above(vectors, queries, 0.5).collect()} == {(q, v, lab, s) for q, _, v, lab, s in pairs if s >= 0.5}
    best = {}
    for _, w, v, _, s in pairs:
        best[v] = max(best.get(v, (-9, -9)), (round(s * w, 8), s))
    assert {r.vec_id: (r.ranked, r.similarity) for r in B.best_weighted(vectors, queries).collect()} == best
    most = {}
    for _, _, v, _, s in pairs:
        most[v] = max(most.get(v, -9), s)
    assert {r.vec_id: r.similarity for r in B.best_by_vector(vectors, queries).collect()} == most


def test_no_queries_or_vectors(data):
    vectors, queries, _ = data
    assert B.nearest(vectors, queries.limit(0), 3).count() == 0 and B.nearest(vectors.limit(0), queries, 3).count() == 0
