"""Exact top-k by inner product: impact-ordered posting segments, processed score at a time until a proof."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from runhealth.llm.common import kept

BLOCK_ROWS = 8192
QUERY_ROWS = 4096
LEVELS = 16
# Possible members that are rescored at once rather than narrowed down further.
RESCORE = 1024
SEEN_BITS = 48
SEEN = 1 << SEEN_BITS


class ImpactIndex:
    """Postings of one block of integer vectors.

    Each component's values are cut into ``LEVELS`` quantised impacts. A segment is the rows of
    one component and level. For a query, a segment's impact is the most it can add above the
    component's least contribution; segments run in descending impact.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.rows = self.ids if rows is None else rows[order]
        self.low, self.high = self.vectors.min(axis=0), self.vectors.max(axis=0)
        self.largest = int(np.abs(self.vectors).max(initial=0))
        width = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS))
        level = (self.vectors - self.low) // width
        self.segments, at, floor, top = [], [], [], []
        for j in range(vectors.shape[1]):
            rows = np.argsort(level[:, j], kind="stable")
            cuts = np.searchsorted(level[rows, j], np.arange(LEVELS + 1))
            for k in range(LEVELS):
                if cuts[k] < cuts[k + 1]:
                    values = self.vectors[rows[cuts[k]:cuts[k + 1]], j]
                    self.segments.append(rows[cuts[k]:cuts[k + 1]])
                    at.append(j)
                    floor.append(values.min())
                    top.append(values.max())
        self.at, self.floor, self.top = np.array(at, dtype=np.int64), np.array(floor), np.array(top)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of the k best rows but row ``own``; ties go to the smaller id."""
        base = np.where(query >= 0, query * self.low, query * self.high)  # least contribution of each component
        weight = query[self.at]
        impact = np.where(weight >= 0, weight * self.top, weight * self.floor) - base[self.at]
        order = np.argsort(-impact, kind="stable")
        others = self.rows != own
        n_others = int(others.sum())
        # Where the packed sums could meet the counter, every row is scored.
        if n_others <= k or len(query) >= 1 << 14 or sum(map(int, np.abs(query))) * 2 * self.largest >= SEEN:
            return self._best(np.flatnonzero(others), query, k)
        # Each step adds a segment's impact to its rows, and SEEN to count the components done.
        impact = impact[order].tolist()
        done = np.zeros(len(self.ids), dtype=np.int64)
        checks = {len(order) * share // 32 for share in range(18, 32, 2)}
        for place, (segment, gain) in enumerate(zip(order.tolist(), impact)):
            if place in checks:
                rows = self._candidates(done, others, query, k, gain, int(base.sum()))
                if len(rows) <= RESCORE:
                    return self._best(rows, query, k)
            done[self.segments[segment]] += SEEN + gain
        return self._best(self._candidates(done, others, query, k, 0, int(base.sum())), query, k)

    def _candidates(self, done: np.ndarray, others: np.ndarray, query: np.ndarray, k: int, rest: int, base: int) -> np.ndarray:
        """Rows that may be members: what they have and ``rest`` for each open component reaches the k-th best
        exact score among the rows that lead now. No open segment adds more than ``rest``."""
        bound = (done & (SEEN - 1)) + (len(query) - (done >> SEEN_BITS)) * rest + base
        leading = np.where(others, bound, np.iinfo(np.int64).min)
        lead = np.argpartition(leading, -k)[-k:]
        bar = np.sort(self.vectors[lead] @ query)[0]
        return np.flatnonzero(others & (bound >= bar))

    def _best(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if self.largest * sum(map(int, np.abs(query))) >= 1 << 62:
            found = self.vectors[rows].astype(object) @ query.astype(object)
            if max(map(abs, found.tolist()), default=0) >= 1 << 63:
                raise OverflowError("a score does not fit a long")
            scores = found.astype(np.int64)
        else:
            scores = self.vectors[rows] @ query
        first = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[first], scores[first]


def quantised(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, v): floor(256 x) of every component, each row with a number of its own, written out so that it keeps it.

    Rows without an id or a vector, or with a null or non-finite component, take no part. A component that
    no long holds raises.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))

    def whole(c: Column) -> Column:
        return F.when(F.abs(c) * 256 < float(1 << 62), F.floor(c * 256).cast("long")).otherwise(
            F.raise_error(F.lit("a component does not fit a long")).cast("long"))
    rows = embeddings.select(F.col("vec_id").cast("long"), x.alias("embedding")).where("vec_id is not null").where(sound)
    return kept(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("embedding", whole).alias("v")), "topk-rows")


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Shorter vectors count as ending in zeros."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the exact k best rows for each row whose id is divisible by ``every``.

    ``embeddings`` has vec_id and embedding; other columns are ignored. Rows are dealt by a hash
    of their number to blocks of about ``BLOCK_ROWS``, queries to blocks of ``QUERY_ROWS``; each pair of
    blocks is one task group, indexed there, and hands on its k best. Ties go to the smaller id; a
    query with fewer than k other rows gets all of them. Rows that share an id all take part, each as a query and as
    a candidate; only the query's own row does not. Vectors too large or long for the packed sums of the proof are scored in
    full; a score beyond a long raises. An empty table gives no rows. The number of blocks takes one counting job.
    """
    vectors = quantised(embeddings)
    n = vectors.count()
    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n // every // QUERY_ROWS))
    spread = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    rows = vectors.select("row", "vec_id", "v", spread.alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    queries = vectors.where(F.col("vec_id") % every == 0).select(
        F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"),
        F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int").alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if len(asked) and len(held):
            width = max(int(held["v"].str.len().max()), int(asked["q"].str.len().max()))
            index = ImpactIndex(held["vec_id"].to_numpy(), _matrix(held["v"], width), held["row"].to_numpy())
            for own, query_id, q in zip(asked["query_row"].tolist(), asked["query_id"].tolist(), _matrix(asked["q"], width)):
                found, scores = index.search(q, own, k)
                out.extend(zip([own] * len(found), [query_id] * len(found), index.ids[found].tolist(), scores.tolist()))
        return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"]).astype("int64")

    found = queries.groupBy("block", "query_block").cogroup(rows.groupBy("block", "query_block")) \
        .applyInPandas(search, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
