from __future__ import annotations

import random

import numpy as np
import pytest

from runhealth.llm import near_dups

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, bucket int"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def brute(texts):
    """Components of similarity 0.8; None for a component in which some pair is within 0.02 of it."""
    sets = {k: shingles(t) for k, t in texts.items()}
    label = {k: k for k in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {root(k) for k in texts}


def changed(rng, words, k):
    out = list(words)
    for at in rng.sample(range(len(out)), k):
        out[at] = "changed%d" % rng.randrange(10**9)
    return out


def corpus(n_copies):
    rng = random.Random(4)
    texts = {}
    for i in range(60):
        words = ["w%d" % rng.randrange(4000) for _ in range(rng.choice([8, 60, 200, 400]))]
        texts[len(texts)] = " ".join(words)
        if i % 4 == 0:
            for _ in range(rng.randint(1, 5)):
                texts[len(texts)] = " ".join(changed(rng, words, rng.randint(0, len(words) // 45)))
    words = ["h%d" % rng.randrange(4000) for _ in range(300)]
    for _ in range(n_copies):
        texts[len(texts)] = " ".join(changed(rng, words, rng.randint(0, 7)))
    return texts


@pytest.mark.parametrize("block", [8192, 40])
def test_one_of_each_group_stays(spark, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    texts = corpus(150)
    rows = [(k, t, "en", "s", len(t), 1, 2) for k, t in texts.items()]
    left = {r["doc_id"] for r in near_dups.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert left == brute(texts)


def test_edges(edge_docs, no_docs, spark):
    left = near_dups.drop_near_duplicates(edge_docs).collect()
    ids = [r["doc_id"] for r in left]
    assert 7 in ids and not {100, 101, 103, 64} & set(ids)
    assert 102 in ids  # only A-Z are lower-cased
    assert len([i for i in ids if i in (50, 51, 52)]) == 1 and ids.count(None) == 1
    assert near_dups.drop_near_duplicates(no_docs).count() == 0


def test_sketches_estimate_similarity():
    rng = random.Random(8)
    words = ["w%d" % rng.randrange(4000) for _ in range(400)]
    for k in (0, 2, 8, 20):
        a, b = " ".join(words), " ".join(changed(rng, words, k))
        alike = float((near_dups.sketch(a) == near_dups.sketch(b)).mean())
        assert abs(alike - near_dups.similarity(a, b)) < 0.12
        one, two = shingles(a), shingles(b)
        assert near_dups.similarity(a, b) == pytest.approx(len(one & two) / len(one | two))


def test_large_buckets_give_fewer_pairs_than_rows():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, near_dups.VALUES).astype(np.uint16)
    marks = np.tile(base, (500, 1))
    for row in marks[1:]:
        row[rng.choice(near_dups.VALUES, 40, replace=False)] = 1
    sure, open_ = near_dups.proposed(marks)
    assert len(sure) + len(open_) <= 1000


def test_pairs_across_blocks_of_a_dense_group(spark, monkeypatch):
    """All texts are 0.78 alike; true pairs lie in buckets of many blocks, away from the pivots."""
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    monkeypatch.setattr(near_dups, "PIVOTS", 2)
    rng = random.Random(6)
    shared = ["b%d" % i for i in range(260)]
    texts = {}
    for i in range(80):
        own = ["o%d" % rng.randrange(10**9) for _ in range(36)]
        texts[2 * i] = " ".join(shared + own)
        texts[2 * i + 1] = " ".join(shared + own[:10] + ["p%d" % rng.randrange(10**9) for _ in range(26)])
    rows = [(k, t, "en", "s", len(t), 1, 2) for k, t in texts.items()]
    left = {r["doc_id"] for r in near_dups.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert left == brute(texts) == set(range(0, 160, 2))


def test_simhash_proposes_and_exact_sets_decide(spark):
    rng = random.Random(9)
    words = ["s%d" % rng.randrange(4000) for _ in range(400)]
    other = " ".join("t%d" % rng.randrange(4000) for _ in range(400))
    for _ in range(200):
        texts = {1: " ".join(words), 2: " ".join(changed(rng, words, 1)), 3: other}
        fps = {k: near_dups.marks(t)[1] for k, t in texts.items()}
        if bin((fps[1] ^ fps[2]) & ((1 << 64) - 1)).count("1") <= near_dups.REACH:
            break
    assert bin((fps[1] ^ fps[2]) & ((1 << 64) - 1)).count("1") <= near_dups.REACH
    classes = spark.createDataFrame([(k, fps[k]) for k in texts], "id long, fp long")
    found = spark.createDataFrame(list(texts.items()), "id long, text string")
    assert {tuple(r) for r in near_dups.simhash_links(classes, found).collect()} == {(2, 1)}
    # Equal fingerprints of texts under 0.8 alike are no link.
    tied = spark.createDataFrame([(1, 5), (3, 5)], "id long, fp long")
    assert near_dups.simhash_links(tied, found).count() == 0
