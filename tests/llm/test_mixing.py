from __future__ import annotations

import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, strategies as st

from runhealth.llm import mixing


@given(st.lists(st.integers(0, 10_000), max_size=12))
def test_targets(sizes):
    found = mixing.targets(sizes)
    assert all(t <= 2 * s + 1e-6 for t, s in zip(found, sizes))
    assert sum(found) == pytest.approx(1.5 * sum(sizes))
    free = [t / (3, 1, 2)[i % 3] for i, (t, s) in enumerate(zip(found, sizes)) if t < 2 * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))
    level = max(free, default=0)
    assert all(t / (3, 1, 2)[i % 3] <= level + 1e-6 for i, (t, s) in enumerate(zip(found, sizes)) if free)


def test_targets_exact_example():
    found = mixing.targets([100, 100, 100])
    assert [Fraction(x).limit_denominator(1000) for x in found] == [200, Fraction(250, 3), Fraction(500, 3)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations(n):
    one, two = (mixing.permuted(np.arange(n), n, key) for key in (1, 2))
    assert sorted(one.tolist()) == sorted(two.tolist()) == list(range(n))
    assert n < 64 or (one.tolist() != two.tolist() and np.corrcoef(one, np.arange(n))[0, 1] < 0.3)


def check(got, rows):
    sizes = Counter()
    for doc_id, text, _, source, *_ in rows:
        sizes[source] += len(re.findall(mixing.WORD, text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(order, mixing.targets([sizes[s] for s in order])))
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - wanted[s]) <= mixing.BLOCK_WORDS + 1


def test_edges(edge_docs, edge_rows):
    got = mixing.taken_words(edge_docs).collect()
    check(got, edge_rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter(
        (d, len(re.findall(mixing.WORD, t or ""))) for d, t, *_ in edge_rows)


def test_reruns_agree(edge_docs):
    runs = [sorted(map(tuple, mixing.taken_words(frame).collect()), key=repr)
            for frame in (edge_docs, edge_docs.repartition(3))]
    assert runs[0] == runs[1]


def test_test_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(mixing.taken_words(docs).collect(), [tuple(r) for r in docs.collect()])


def test_mixed_documents_hold_the_taken_words(edge_docs):
    taken = Counter()
    for r in mixing.taken_words(edge_docs).collect():
        taken[r["doc_id"]] += r["taken"]
    found = Counter()
    texts = defaultdict(set)
    for r in edge_docs.collect():
        texts[r["doc_id"]].add(r["text"])
    for r in mixing.mixed_documents(edge_docs).collect():
        found[r["doc_id"]] += len(re.findall(mixing.WORD, r["text"]))
        assert any(r["text"] in (t or "") for t in texts[r["doc_id"]])
    assert found == +taken


def test_empty_table(no_docs):
    assert mixing.taken_words(no_docs).count() == mixing.mixed_documents(no_docs).count() == 0
