from __future__ import annotations

import random

import pytest

from runhealth.llm.components import components


def brute(links):
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        label[max(a, b)] = min(a, b)
    return {x: root(x) for x in label if root(x) != x}


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(200)], [(500, i) for i in range(100)],
    [(random.Random(i).randrange(300), random.Random(-i).randrange(300)) for i in range(200)]])
def test_components(spark, links):
    found = components(spark.createDataFrame(links, "u long, v long"))
    assert {r["u"]: r["v"] for r in found.collect()} == brute(links)
