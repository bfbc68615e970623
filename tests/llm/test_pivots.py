"""Exact top-k against brute force: documents' vectors, many small blocks, hostile rows; and that bounds eliminate."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from ledgerloom.llm import pivots
from ledgerloom.llm.common import ship
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _whole(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    out = [math.floor(256 * float(np.float32(x))) for x in v]
    return out if sum(x * x for x in out) < 2**62 else None


def _brute(rows, every, k):
    good = [(i, _whole(v)) for i, v in rows]
    good = [(i, v) for i, v in good if i is not None and v is not None]
    out = []
    for i, q in good:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def _got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_vectors_of_documents(spark):
    ship(spark)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = _got(pivots.top_k(df, F.col("vec_id") % 50 == 0))
    assert got == _brute([(r.vec_id, r.embedding) for r in df.collect()], 50, 5) and len(got) == 50


def _clusters(n=700, dims=12, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dims))
    return [(int(k), [float(x) for x in centres[k % 8] * r.choice([0.3, 1, 2]) + r.normal(size=dims) * 0.05]) for k in r.permutation(n)]


@pytest.mark.parametrize(("block", "queries", "count", "k"), [(4096, 4096, 24, 5), (16, 8, 5, 5), (7, 3, 1, 2), (50, 1, 64, 30)])
def test_blocks_change_nothing(spark, monkeypatch, block, queries, count, k):
    """Many small blocks, few and many pivots, a third of all rows one vector, some of these under one id."""
    ship(spark)
    for name, value in (("BLOCK", block), ("QUERIES", queries), ("PIVOTS", count), ("SAMPLE", 64)):
        monkeypatch.setattr(pivots, name, value)
    rows = _clusters()
    same = rows[0][1]
    rows += [(2000 + j, same) for j in range(300)] + [(3000, same)] * 40 + [(3001, rows[1][1])] * 9
    got = _got(pivots.top_k(_frame(spark, rows).repartition(5), F.col("vec_id") % 21 == 0, k=k))
    assert got == _brute(rows, 21, k)


def test_hostile_rows(spark):
    """Nulls, non-finite and huge components, empty vectors, unlike lengths, ties, repeated queries, rows without an id."""
    ship(spark)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (6, [0.001, -0.001]), (7, [1.0]), (8, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (10, [1e30, 0.0]), (12, [8e6, 1.0])]
    rows += [(14, [1.0, 2.0]), (14, [1.0, 2.0]), (0, [1.0, 2.0]), (-2, [-1.0, -2.0]), (20, [1.0, 2.0]), (18, [1.0, 2.0]), (16, [1.0, 2.0])]
    df = _frame(spark, rows).withColumns({c: F.lit("x") for c in ("row", "v", "norm", "dist", "home", "asks", "cb", "qb", "score", "rank", "a.b")})
    for every, k in ((2, 3), (1, 50), (100, 5)):
        got = _got(pivots.top_k(df, F.col("vec_id") % every == 0, k=k))
        assert got == _brute(rows, every, k) and got
    assert pivots.top_k(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0
    assert pivots.top_k(df.filter("vec_id = 6"), F.col("vec_id") % 2 == 0).count() == 0
    assert pivots.top_k(df, F.lit(None).cast("boolean")).count() == 0


def _side(v, p, at=0):
    d = pivots.distances(v, p)
    lists = lambda m, kind: pa.array([list(x) for x in m.tolist()], pa.list_(kind))
    ids = pa.array(np.arange(at, at + len(v)))
    return pivots.Side(pa.table({"vec_id": ids, "norm": pa.array((v.astype(float) ** 2).sum(1)), "row": ids, "v": lists(v, pa.int64()), "dist": lists(d, pa.float64())}))


def test_bounds_hold_and_eliminate():
    """No score is above its bound, for small and for very large numbers; among clusters few scores are computed."""
    r = np.random.default_rng(5)
    for scale in (1, 300, 2**24, 2**27):
        v = np.floor(r.normal(size=(400, 9)) * scale).astype(np.int64)
        p = np.vstack((pivots.choose(v[:100], 6), np.full((1, 9), 2**28, np.int64)))
        q, x = _side(v[:40], p), _side(v[40:], p, 40)
        exact = np.array([[sum(int(a) * int(b) for a, b in zip(i, j, strict=True)) for j in x.v] for i in q.v], dtype=object)
        assert (pivots.bounds(q, x, slice(0, 40)) >= exact).all()
        hits, _ = pivots.search(q, np.full(40, -np.inf), x, 5)
        assert [[s for a, _, _, s in hits if a == i] for i in range(40)] == [sorted(row, reverse=True)[:5] for row in exact]
    rows = sorted(_clusters(4000))
    v = np.floor(256 * np.array([x for _, x in rows])).astype(np.int64)
    p = pivots.choose(v[:500], 24)
    q, x = _side(v[:40], p), _side(v, p)
    hits, scored = pivots.search(q, np.full(40, -np.inf), x, 5)
    assert len(hits) == 200 and scored < 0.25 * 40 * 4000, scored


def test_pivots_are_apart():
    v = np.array([[0, 0], [10, 0], [10, 0], [0, 10], [5, 5], [0, 0]])
    got = pivots.choose(v, 24)
    assert len(got) == 4 and len({tuple(x) for x in got.tolist()}) == 4
    assert pivots.matrix(pa.array([[1], [], [2, 3]], pa.list_(pa.int64()))).tolist() == [[1, 0], [0, 0], [2, 3]]
