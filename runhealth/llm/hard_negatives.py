"""Hard-negative mining: an anchor's positives cut the score line into disjoint slots, and a few rows a slot answer
every positive's window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from runhealth.llm.common import kept

BLOCK_ROWS = 8192
ANCHOR_ROWS = 16_384
TILE = 256
EXACT = 1 << 53


def sound(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, embedding) of the rows that take part, each with a number of its own, written out
    so that the number stays the same."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding") \
        .where("vec_id is not null and label is not null").where(fine)
    return kept(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "negatives-rows")


def matrix(vectors: pd.Series) -> np.ndarray:
    """floor(256 x) of each component as whole doubles; shorter vectors count as ending in zeros."""
    width = int(vectors.str.len().max()) if len(vectors) else 0
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return np.floor(256 * out)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where every sum stays below 2**53, else in whole numbers.

    A score that no long holds raises OverflowError.
    """
    width = min(anchors.shape[1], rows.shape[1])
    anchors, rows = anchors[:, :width], rows[:, :width]
    largest = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * width
    if largest < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    found = whole(anchors).astype(object) @ whole(rows).astype(object).T
    if max(map(abs, found.ravel().tolist()), default=0) >= 1 << 63:
        raise OverflowError("a score does not fit a long")
    return found.astype(np.int64)


def best(of: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k positions in ``at`` with the highest scores ``of``; ties go to the smaller id."""
    if len(at) > 4 * k:
        at = at[of[at] >= np.partition(of[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -of[at]))[:k]]


def bar(limit: int) -> int:
    """The least whole score of which 100 parts are at least 80 of ``limit``."""
    return -(-4 * int(limit) // 5)


def tiles(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(position of an anchor, its scores with all rows), a bounded tile at a time."""
    left, right = matrix(anchors["anchor"]), matrix(rows["embedding"])
    for first in range(0, len(left), TILE):
        for i, found in enumerate(scores(left[first:first + TILE], right)):
            yield first + i, found


FOUND = "anchor_row long, slot int, row long, vec_id long, score long"


def _frame(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["anchor_row", "slot", "row", "vec_id", "score"]).astype(
        {"anchor_row": "int64", "slot": "int32", "row": "int64", "vec_id": "int64", "score": "int64"})


def in_blocks(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, search) -> DataFrame:
    """``search(anchors, rows)`` for each block of anchors against each block of rows, a task group each."""
    blocks, anchor_blocks = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_anchors // ANCHOR_ROWS))

    def dealt(row: str, n: int) -> Column:
        return F.pmod(F.xxhash64(row), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = anchors.withColumns({"anchor_block": dealt("anchor_row", anchor_blocks)}).withColumn("block", every(blocks))
    held = rows.withColumns({"block": dealt("row", blocks)}).withColumn("anchor_block", every(anchor_blocks))
    return asked.groupBy("block", "anchor_block").cogroup(held.groupBy("block", "anchor_block")).applyInPandas(search, FOUND)


def first_k(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The k best rows per key; Spark cuts each task to k a key before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def positives_in(k: int):
    def search(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(anchors) and len(rows):
            ids, labels, numbers = (rows[c].to_numpy() for c in ("vec_id", "label", "row"))
            own, wanted = anchors["anchor_row"].tolist(), anchors["anchor_label"].tolist()
            for i, of in tiles(anchors, rows):
                at = best(of, np.flatnonzero((labels == wanted[i]) & (numbers != own[i])), ids, k)
                out.extend(zip([own[i]] * len(at), [0] * len(at), numbers[at].tolist(), ids[at].tolist(), of[at].tolist()))
        return _frame(out)

    return search


def negatives_in(k: int):
    def search(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(anchors) and len(rows):
            ids, labels, numbers = (rows[c].to_numpy() for c in ("vec_id", "label", "row"))
            own, other = anchors["anchor_row"].tolist(), anchors["anchor_label"].tolist()
            limits = [list(map(int, found)) for found in anchors["limits"]]
            for i, of in tiles(anchors, rows):
                negative = labels != other[i]
                for slot, high in enumerate(limits[i]):
                    low = max(bar(high), limits[i][slot + 1] + 1 if slot + 1 < len(limits[i]) else bar(high))
                    at = best(of, np.flatnonzero(negative & (of <= high) & (of >= low)), ids, k)
                    out.extend(zip([own[i]] * len(at), [slot] * len(at), numbers[at].tolist(), ids[at].tolist(), of[at].tolist()))
        return _frame(out)

    return search


def hard_negatives(embeddings: DataFrame, every: int = 100, n_positives: int = 5, k: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): per anchor and positive the k
    best rows of other labels that score between 80 and 100 hundredths of the positive's score.

    ``embeddings`` has vec_id, label and embedding; other columns are ignored. Anchors are the rows whose
    vec_id is divisible by ``every``; an anchor's positives are its ``n_positives`` best other rows of the same label.
    Scores are exact inner products of floor(256 x); a score beyond a long raises. Higher scores come
    first, ties go to the smaller vec_id. Rows without vec_id, label or vector, or with a null or non-finite component, take no part; a
    vector shorter than another counts as ending in zeros. Repeated rows, and rows that share a vec_id, all take part,
    each under a row number; only the anchor's own row is not its positive. Fewer rows than asked are returned
    as they are; a positive whose window is empty, as below zero, has no row. An empty table gives no rows.

    The limits of an anchor's windows, its positives' scores, cut the score line into disjoint slots, so a row is
    kept for one slot at most. A window is its own slot and all below, down to its bar: the k best of a window are
    among the k best of these slots, so k rows a slot answer all windows, however they overlap. Each block of rows
    cuts to k a slot before anything is shuffled. Two passes over pairs of blocks, no product of the whole
    tables; two counting jobs set the number of blocks.
    """
    rows = sound(embeddings)
    anchors = rows.where(F.col("vec_id") % every == 0).select(
        F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"),
        F.col("embedding").alias("anchor"))
    n_rows, n_anchors = rows.count(), anchors.count()
    near = in_blocks(anchors.drop("anchor_id"), rows, n_anchors, n_rows, positives_in(n_positives))
    positives = kept(first_k(near, ["anchor_row"], n_positives, "place"), "negatives-positives")

    limits = positives.groupBy("anchor_row").agg(F.sort_array(F.collect_set("score"), asc=False).alias("limits"))
    asking = anchors.drop("anchor_id").join(limits, "anchor_row")
    in_slots = first_k(in_blocks(asking, rows, n_anchors, n_rows, negatives_in(k)), ["anchor_row", "slot"], k, "in_slot")

    windows = positives.join(limits, "anchor_row").select(
        "anchor_row", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        (F.array_position("limits", F.col("score")) - 1).alias("window_slot"))
    # The suffix of a window's slot: at most n_positives x k rows an anchor and window.
    suffix = windows.join(in_slots, "anchor_row") \
        .where((F.col("slot") >= F.col("window_slot"))
               & (F.col("score") >= F.ceil(F.col("positive_score").cast("decimal(20,0)") * 4 / 5)))
    return first_k(suffix, ["anchor_row", "place"], k, "rank").join(anchors.select("anchor_row", "anchor_id"), "anchor_row") \
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score"))
