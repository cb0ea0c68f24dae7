from __future__ import annotations

import math

import numpy as np
import pytest

from runhealth.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row long, block int, score long, anchor string"


def brute(rows, every=100, n_positives=5, k=5):
    sound = [(i, label, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x, label, *_ in rows
             if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for a, (anchor, label, v) in enumerate(sound):
        if anchor % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, j) for j, (i, _, w) in enumerate(sound) if j != a)
        for s, positive, _ in [x for x in scored if sound[x[2]][1] == label][:n_positives]:
            fits = [x for x in scored if sound[x[2]][1] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(anchor, positive, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **more):
    return sorted(map(tuple, hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), **more).collect()))


def vectors(n, seed, spread, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, 12)) + 1
    return [(i, [float(np.float32(c)) for c in centres[i % labels] + spread * rng.normal(size=12)], int(rng.integers(labels)), 7, 8, 9, "x")
            for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.5, 2.0])
@pytest.mark.parametrize("block", [40, 8192])
def test_equals_brute_force(spark, monkeypatch, spread, block):
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(hn, "TILE", 2)
    rows = vectors(500, 3, spread)
    rows += [(1000 + i, rows[100][1], i % 3, 0, 0, 0, "") for i in range(20)]  # ties of anchor, positives and negatives
    got = mined(spark, rows)
    assert got == brute(rows) and got


def test_overlapping_windows_share_slots(spark):
    rows = [(0, [1.0], 1)] + [(i, [s / 256], 1) for i, s in enumerate([100, 99, 98, 90, 60], 1)]
    rows += [(50 + s, [s / 256], 2) for s in range(40, 103)]
    rows = [(*r, 0, 0, 0, "") for r in rows]
    got = mined(spark, rows)
    assert got == brute(rows) and sum(r[0] == 0 for r in got) == 25


def test_edges(spark):
    odd = [(0, [1.0, 2.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [float("nan"), 1.0], 1), (400, [float("inf"), 0.0], 1),
           (None, [1.0, 1.0], 1), (1, [3.0], 2), (500, [], 1), (2, [-1.0, -5.0, 4.0], 2), (600, [0.0, 0.0], 2), (0, [1.0, 2.0], 1),
           (0, [1.0, 2.0], 2), (2, [-1.0, -6.0], 1), (7, [1.0, 2.0], None), (8, [1.0, 1.9], 2), (9, [1.0, 1.8], 2), (700, [-1.0, -2.0], 1),
           (8, [1.0, 1.9], 2)]
    rows = [(*r, 0, 0, 0, "") for r in odd]
    assert mined(spark, rows) == brute(rows) and brute(rows)
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_scores_are_exact_or_raise():
    a, b = np.array([[2.0 ** 40, 1.0]]), np.array([[2.0 ** 20 + 1, 3.0], [2.0 ** 13, 1.0]])
    assert hn.scores(a, b).tolist() == [[2 ** 60 + 2 ** 40 + 3, 2 ** 53 + 1]]
    with pytest.raises(OverflowError):
        hn.scores(np.array([[2.0 ** 40]]), np.array([[2.0 ** 40]]))
    assert [hn.bar(x) for x in (100, 99, 1, 0, -1, -10)] == [80, 80, 1, 0, 0, -8]
