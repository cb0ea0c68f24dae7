"""SimHash near-dedup: fingerprints, sharded by a vantage-point tree, linked exactly within a Hamming radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from runhealth.llm.common import kept, map_rows, words
from runhealth.llm.components import components

SEED = 42
CHUNK = 1 << 16
# The tree is fitted on a hash sample of this many fingerprints at most, down to leaves of
# LEAF_SAMPLE of them or of about LEAF_ROWS rows, whichever comes first.
TREE_SAMPLE = 1 << 18
LEAF_SAMPLE = 8
LEAF_ROWS = 4096
# Inside a leaf, points are cut further until blocks are this small and compared directly.
DIRECT = 512


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of ``size`` words, repeats included, in parts of bounded size.

    A-Z are lower-cased and no other letter. Fewer words make one shingle of them all; none make none.
    """
    found = [w.lower() for w in words(text)]  # bytes.lower changes A-Z only
    if not found:
        return
    joined = b" ".join(found)
    end = np.cumsum([len(w) + 1 for w in found])
    begins = [0, *end[:-size].tolist()]
    ends = (end[size - 1:] - 1).tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends), CHUNK):
        yield np.array([digest(joined[b:e], SEED) for b, e in zip(begins[at:at + CHUNK], ends[at:at + CHUNK])], np.uint64)


def fingerprint(text: str | None, size: int) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; no words give zero."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, size):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def distance(a: np.ndarray, b: np.uint64 | np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split_radius(d: np.ndarray) -> int | None:
    """The radius that comes nearest to halving points at distances ``d``; None if all are equally far."""
    inside = np.cumsum(np.bincount(d, minlength=65))
    radii = np.flatnonzero((inside > 0) & (inside < len(d)))
    return int(radii[np.argmin(np.abs(inside[radii] - len(d) / 2))]) if len(radii) else None


class VantageTree:
    """Nodes (vantage point, radius, inside child, outside child); a negative child is leaf number -child - 1."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple] = []
        self.n_leaves = 0
        self.root = self._grow(sample, max(LEAF_SAMPLE, len(sample) // max(1, leaves)))

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        radius = None
        if len(points) > leaf:
            d = distance(points, points[0])
            radius = split_radius(d)
        if radius is None:
            self.n_leaves += 1
            return -self.n_leaves
        at = len(self.nodes)
        self.nodes.append(())
        self.nodes[at] = (points[0], radius, self._grow(points[d <= radius], leaf), self._grow(points[d > radius], leaf))
        return at

    def route(self, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, positions, home): each point at home in one leaf, and as a guest wherever it may have partners.

        Two points within ``reach`` part at one node at most. The inner one is then a guest outside, if
        the triangle bound allows a partner there; guests go wherever the bound allows one.
        """
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows, home
                continue
            vantage, radius, inside, outside = self.nodes[node]
            d = distance(points[rows], vantage).astype(np.int16)
            todo.append((inside, *_parted(rows, home, d <= radius, ~home & (d <= radius + reach))))
            todo.append((outside, *_parted(rows, home, d > radius, d > radius - reach)))


def _parted(rows: np.ndarray, home: np.ndarray, here: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = home & here
    taken = own | near
    return rows[taken], own[taken]


def near_pairs(points: np.ndarray, home: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within ``reach`` of which one is at home; larger sets are cut by a vantage point."""
    first, second = [], []
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, guests = todo.pop()
        radius = None
        if len(own) > DIRECT:
            d = distance(points[own], points[own[0]]).astype(np.int16)
            radius = split_radius(d)
        if radius is not None:
            g = distance(points[guests], points[own[0]]).astype(np.int16)
            todo.append((own[d <= radius], guests[g <= radius + reach]))
            todo.append((own[d > radius], np.concatenate([guests[g > radius - reach],
                                                          own[(d <= radius) & (d > radius - reach)]])))
            continue
        for at in range(0, len(own), DIRECT):
            block = own[at:at + DIRECT]
            others = np.concatenate([own[at:], guests])
            i, j = np.nonzero(distance(points[block][:, None], points[others][None, :]) <= reach)
            first.append(block[i])
            second.append(others[j])
    a, b = np.concatenate(first or [own]), np.concatenate(second or [own])
    apart = a != b
    return a[apart], b[apart]


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For positions 0..n-1, the least position of each one's component under the links a-b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if np.array_equal(label, before):
            return label


def fingerprint_links(prints: DataFrame, reach: int) -> DataFrame:
    """(u, v): links that connect all fingerprints within ``reach`` of each other, directly or by steps.

    ``prints`` holds distinct fingerprints (fp). The tree is fitted on a bounded sample; every
    fingerprint is routed through it. Each leaf is one group: its pairs are found with local trees
    and reduced to a star per local component, so a dense leaf hands on fewer links than points.
    """
    n = prints.count()
    leaves = -(-n // LEAF_ROWS)
    size = min(TREE_SAMPLE, 32 * leaves, n)
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(size).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = prints.sparkSession.sparkContext.broadcast(VantageTree(sample, leaves))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = frame["fp"].to_numpy(np.int64)
            for leaf, rows, home in tree.value.route(points.view(np.uint64), reach):
                yield pd.DataFrame({"leaf": leaf, "fp": points[rows], "home": home})

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        points = frame["fp"].to_numpy(np.int64)
        a, b = near_pairs(points.view(np.uint64), frame["home"].to_numpy(bool), reach)
        label = least_linked(len(points), a, b)
        moved = np.flatnonzero(label != np.arange(len(points)))
        return pd.DataFrame({"u": points[moved], "v": points[label[moved]]})

    return prints.mapInPandas(route, "leaf int, fp long, home boolean") \
        .groupBy("leaf").applyInPandas(link, "u long, v long")


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, fp): each row's fingerprint as a signed 64-bit number."""
    def rows(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            fp = fingerprint(row["text"], size)
            yield row["doc_id"], fp - (1 << 64) if fp >> 63 else fp

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, fp long", rows)


def simhash_components(docs: DataFrame, size: int = 3, reach: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Fingerprints within ``reach`` bits are linked; component_id is the least doc_id that links reach.
    Null and empty texts have fingerprint zero, linked like any other. Repeated rows and equal
    fingerprints are one node with all their rows. A row without doc_id keeps its place and never
    names a component; a component of such rows alone has a null id. An empty table gives no rows.
    Other columns are ignored.
    """
    marked = kept(fingerprints(docs, size), "simhash-fingerprints")
    prints = kept(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(fingerprint_links(prints.select("fp"), reach))
    classes = prints.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = classes.join(named, "root").select("fp", "component_id")
    return marked.join(known, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
