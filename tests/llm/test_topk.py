from __future__ import annotations

import math

import numpy as np
import pytest

from runhealth.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, block int, score long"


def brute(rows, every=50, k=5):
    vectors = []
    for vec_id, x, *_ in rows:
        if vec_id is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            vectors.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for at, (q, x) in enumerate(vectors):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for j, (i, y) in enumerate(vectors) if j != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def rows(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 16))
    return [(i, [float(np.float32(c)) for c in centres[i % 6] + spread * rng.normal(size=16)], 0, "v", 1, 2) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
@pytest.mark.parametrize("block", [64, 8192])
def test_equals_brute_force(spark, monkeypatch, spread, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    found = rows(600, 1, spread)
    found += [(1000 + i, found[50][1], 0, "v", 1, 2) for i in range(9)]  # ties
    got = topk.top_k(spark.createDataFrame(found, SCHEMA))
    assert sorted(map(tuple, got.collect())) == brute(found)


def test_edges(spark):
    odd = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf"), 0.0]), (None, [1.0, 1.0]),
           (1, [3.0]), (250, []), (2, [-1.0, -5.0, 4.0]), (300, [0.0, 0.0]), (0, [1.0, 2.0]), (2, [-1.0, -6.0]), (0, [1.0, 3.0]), (350, [2.0 ** 22, 1.0]), (351, [2.0 ** 22, 1.0])]
    found = [(i, x, 0, "v", 1, 2) for i, x in odd]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(found, SCHEMA)).collect())) == brute(found)
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_search_stops_early_only_with_proof():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-300, 300, size=(3000, 24))
    vectors[:8] = vectors[0] * 4 + rng.integers(-3, 3, size=(8, 24))
    index = topk.ImpactIndex(np.arange(3000), vectors)
    scores = vectors @ vectors[0]
    scores[0] = -(1 << 60)
    want = np.lexsort((np.arange(3000), -scores))[:5]
    rows_, got = index.search(vectors[0], 0, 5)
    assert rows_.tolist() == want.tolist() and got.tolist() == scores[want].tolist()


def test_large_components_are_scored_in_full_or_raise(spark):
    found = [(0, [2.0 ** 50, 1.0]), (50, [3.0, 2.0]), (1, [2.0, -5.0]), (2, [5.0, 1.0])]
    rows_ = [(i, x, 0, "v", 1, 2) for i, x in found]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(rows_[1:], SCHEMA)).collect())) == brute(rows_[1:])
    for bad in (2.0 ** 50, 2.0 ** 60):
        with pytest.raises(Exception, match="fit a long"):
            topk.top_k(spark.createDataFrame([(0, [bad], 0, "v", 1, 2), (1, [bad], 0, "v", 1, 2)], SCHEMA)).collect()
