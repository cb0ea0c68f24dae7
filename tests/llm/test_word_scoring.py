from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from runhealth.llm import word_scoring
from runhealth.llm.common import words


def brute_model(texts, vocabulary):
    one, two, head = Counter(), Counter(), Counter()
    for t in texts:
        found = words(t)
        for pair in zip([None, *found], found):
            one[pair[1]] += 1
            head[pair[0]] += 1
            two[pair] += 1
    n = sum(one.values())

    def bits(found):
        total = 0.0
        for pair in zip([None, *found], found):
            p1 = (one[pair[1]] + 1) / (n + vocabulary)
            total -= math.log2((two[pair] + 8 * p1) / (head[pair[0]] + 8))
        return total / len(found)

    return bits


@pytest.mark.parametrize("size", [300, 12 << 20])
def test_equals_brute_force(spark, monkeypatch, edge_docs, edge_rows, size):
    monkeypatch.setattr(word_scoring, "BLOCK_BYTES", size)
    targets = {0, 7, 60, 50}
    frame = spark.createDataFrame([(i, 1) for i in [*targets, 0, None, 999]], "doc_id long, quality int")
    vocabulary = len({w for _, t, *_ in edge_rows for w in words(t)})
    target = brute_model([t for d, t, *_ in edge_rows if d in targets], vocabulary)
    every = brute_model([t for _, t, *_ in edge_rows], vocabulary)
    want = []
    for d, t, *_ in edge_rows:
        found = words(t)
        a, b = (target(found), every(found)) if found else (None, None)
        want.append((d, len(found), a, b, a - b if found else None))
    got = [tuple(r) for r in word_scoring.score_documents(edge_docs, frame).collect()]
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], -1 if r[2] is None else round(r[2], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:2] == b[:2] and all((x is None and y is None) or x == pytest.approx(y, abs=1e-8) for x, y in zip(a[2:], b[2:]))


def test_query_sees_word_order(spark, tmp_path):
    """Two texts of the same words: only the one in the target's order is near to it."""
    from runhealth.llm import queries

    order = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    texts = {1: " ".join(order * 20), 2: " ".join(order[::-1] * 20), 3: " ".join(order * 9), 4: " ".join(order[::-1] * 9)}
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()],
                          "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got[3]["n_tokens"] == 54 and got[3]["score"] < 0 < got[4]["score"]


def test_no_targets_and_no_documents(spark, edge_docs, edge_rows, no_docs):
    nobody = spark.createDataFrame([], "doc_id long")
    size = len({w for _, t, *_ in edge_rows for w in words(t)})
    r = word_scoring.score_documents(edge_docs, nobody).where("n_tokens > 0").first()
    assert r["target_loss"] == pytest.approx(math.log2(size))
    assert word_scoring.score_documents(no_docs, nobody).count() == 0


def test_events_of_a_block_are_counted():
    reader = word_scoring.Reader()
    for doc, text, target in ((1, "a b a b a c", True), (2, None, True), (3, "a b", False)):
        reader.add({"doc_id": doc, "text": text, "target": target})
    block = reader.block()
    words_, heads, pairs = block.sections
    assert (words_, heads, pairs) == (3, 3, 4)  # a b c; start a b; start-a a-b b-a a-c
    assert sorted(block.every[:3]) == [1, 3, 4] and sorted(block.chosen[:3]) == [1, 2, 3]
    assert sorted(block.every[6:]) == [1, 2, 2, 3] and block.every[:3].sum() == block.every[3:6].sum() == block.every[6:].sum() == 8
    again = word_scoring.Block(block.hashes, block.codes, block.n_words, block.target)
    assert (again.keys == block.keys).all() and (again.every == block.every).all()
    for n in (1, 3, 7):
        split = list(block.buckets(n))
        assert sorted(i for _, mine in split for i in mine) == list(range(10)) and len({b for b, _ in split}) == len(split)


def test_equal_blocks_are_scored_each(spark, monkeypatch):
    monkeypatch.setattr(word_scoring, "BLOCK_BYTES", 5)
    frame = spark.createDataFrame([(1, "a b c")] * 4 + [(2, "c b a")] * 2, "doc_id long, text string").repartition(3)
    got = word_scoring.score_documents(frame, spark.createDataFrame([(1,)], "doc_id long")).collect()
    assert len(got) == 6 and len({tuple(r) for r in got}) == 2 and all((r["score"] < 0) == (r["doc_id"] == 1) for r in got)
