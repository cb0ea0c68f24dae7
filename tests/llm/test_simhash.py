from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from runhealth.llm import simhash


def brute_fingerprint(text, size=3):
    words = [re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    grams = [words[i:i + size] for i in range(len(words) - size + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def expected(rows):
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    root = brute_components(prints)
    least = {}
    for r, (doc_id, *_) in zip(root, rows):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return sorted(((d, f"{p:016x}", least.get(r)) for (d, *_), p, r in zip(rows, prints, root)), key=repr)


def test_edges(edge_docs, edge_rows):
    assert sorted(map(tuple, simhash.simhash_components(edge_docs).collect()), key=repr) == expected(edge_rows)


def test_test_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(map(tuple, simhash.simhash_components(docs).collect()), key=repr) == expected(rows)


def clustered(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 30])):
            out.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    return list(out)


@pytest.mark.parametrize("leaf, direct", [(4096, 512), (8, 4)])
def test_tree_finds_all_links(spark, monkeypatch, leaf, direct):
    monkeypatch.setattr(simhash, "LEAF_ROWS", leaf)
    prints = clustered(700, leaf)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.fingerprint_links(frame, 2).collect()]
    at = {p: i for i, p in enumerate(prints)}
    label = simhash.least_linked(len(prints), np.array([at[u] for u, _ in links]), np.array([at[v] for _, v in links]))
    assert label.tolist() == brute_components(prints)


def test_near_pairs_with_local_trees(monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 8)
    points = np.array(clustered(400, 9), np.uint64)
    home = np.arange(len(points)) % 3 > 0
    a, b = simhash.near_pairs(points, home, 2)
    want = {(i, j) for i in range(len(points)) for j in range(i)
            if (home[i] or home[j]) and int(points[i] ^ points[j]).bit_count() <= 2}
    assert {(max(p), min(p)) for p in zip(a.tolist(), b.tolist())} == want


def test_empty_table(no_docs):
    assert simhash.simhash_components(no_docs).count() == 0
