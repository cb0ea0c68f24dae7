"""Near duplicates by similarity of shingle sets: SimHash fingerprints and min-hash bands of the shingle hashes propose,
exact sets decide.

The Hamming radius that reaches a similarity of 0.8 is about 16 of 64 bits. Distances between
unrelated fingerprints lie at 32 +- 4, so no vantage point can prune at that radius; hence the
bands here, while ``simhash`` serves small radii.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from runhealth.llm.common import kept, map_rows, row_keys, words
from runhealth.llm.components import components
from runhealth.llm.simhash import fingerprint_links, shingle_hashes

SIZE = 5
SIMILARITY = 0.8
VALUES, BANDS, ROWS = 256, 25, 5
# Fingerprints within REACH bits propose a pair.
REACH = 3
# An estimate from VALUES values is off by 0.025 at 0.8. From SURE on a pair is compared first; below UNLIKELY
# there is none. Every link is decided on the exact sets.
SURE, UNLIKELY = 0.92, 0.68
# Buckets up to SMALL compare all pairs. Larger ones are first cut into blocks of BLOCK rows that share
# PIVOTS rows; what stays apart is then compared over all pairs of blocks.
SMALL, BLOCK, PIVOTS = 32, 8192, 16
_RNG = np.random.Generator(np.random.Philox(key=[7, VALUES]))
FACTORS = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
OFFSETS = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def sketch(text: str | None) -> np.ndarray | None:
    """The least of each of VALUES linear hashes over the shingles; None without words."""
    return marks(text)[0]


def marks(text: str | None) -> tuple[np.ndarray | None, int]:
    """The sketch and the signed SimHash fingerprint (a bit is 1 if set in over half the shingle hashes)."""
    least, ones, n = None, np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, SIZE):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 1024):
            part = (short[at:at + 1024, None] * FACTORS + OFFSETS).min(axis=0)
            least = part if least is None else np.minimum(least, part)
    return least, int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def similarity(a: str, b: str) -> float:
    one, two = (np.unique(np.concatenate(list(shingle_hashes(t, SIZE)))) for t in (a, b))
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return shared / (len(one) + len(two) - shared)


def proposed(marks: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(sure, open) pairs of rows of one bucket, from their sketches.

    The row nearest to the bucket's commonest values is compared first, then each row with the rows
    of other components that have not been compared yet; sure pairs join components. Of the
    open pairs a small bucket gives all, a larger one the best of each row.
    """
    n = len(marks)
    label, sure, open_ = np.arange(n), [], []
    first = 0
    if n > SMALL:
        ranked = np.sort(marks[:2048], axis=0)
        middle = ranked[len(ranked) // 2]
        first = int(np.argmax((marks == middle).sum(axis=1)))
    todo = np.ones(n, bool)
    best, best_at = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in [first, *(i for i in range(n) if i != first)]:
        todo[i] = False
        others = np.flatnonzero(todo & (label != label[i]))
        if not len(others):
            continue
        alike = (marks[others] == marks[i]).sum(axis=1, dtype=np.int32)
        near = others[alike >= SURE * VALUES]
        for j in near.tolist():
            if label[j] != label[i]:
                sure.append((i, j))
                label[label == label[j]] = label[i]
        maybe = alike >= UNLIKELY * VALUES
        if n <= SMALL:
            open_.extend((i, j) for j in others[maybe & (alike < SURE * VALUES)].tolist())
        elif maybe.any():
            rows, values = others[maybe], alike[maybe]
            better = values > best[rows]
            best[rows[better]], best_at[rows[better]] = values[better], i
            if values.max() > best[i]:
                best[i], best_at[i] = values.max(), rows[values.argmax()]
    if n > SMALL:
        open_ = [(i, int(best_at[i])) for i in np.flatnonzero(best).tolist()]
    return sure, [(i, j) for i, j in open_ if label[i] != label[j]]


def still_open(left: np.ndarray, left_roots: np.ndarray, marks: np.ndarray, roots: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of a row of ``left`` and one of ``marks`` that lie in different components and whose sketches leave the link open."""
    for i in range(len(left)):
        others = np.flatnonzero(roots != left_roots[i])
        alike = (marks[others] == left[i]).sum(axis=1, dtype=np.int32)
        yield from ((i, j) for j in others[alike >= UNLIKELY * VALUES].tolist())


def near_links(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): links between classes (id, sketch, bands) of different texts (id, text).

    Small buckets hand on all their open pairs and large ones each row's best, block by block. Where a large
    bucket's rows are then still in different components, its open pairs between these are decided too, over
    all its blocks.
    """
    held = classes.select("id", F.explode("bands").alias("bucket"))
    crowded = held.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id"), "id")).alias("x")) \
        .where("n > 1").drop("x")
    rows = held.join(crowded, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    place = F.xxhash64("id", "bucket")
    # The rows with the least hashes of a large bucket stand in all its blocks and tie them together.
    pivot = (F.col("blocks") > 1) & (F.pmod(place, F.col("n")) < PIVOTS)
    rows = rows.withColumn("block", F.explode(
        F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1))
        .otherwise(F.array(F.pmod(F.shiftright(place, 20), F.col("blocks").cast("long")).cast("int")))))
    places = rows.select("bucket", "block", "id", (F.col("n") > SMALL).alias("large"))
    marks = classes.select("id", "sketch")
    dealt = places.join(marks, "id").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "id")

    def compare(stream: Iterator[dict]) -> Iterator[tuple]:
        for _, group in groupby(stream, key=lambda r: (r["bucket"], r["block"])):
            ids, marks = zip(*((r["id"], r["sketch"]) for r in group))
            sure, open_ = proposed(np.frombuffer(b"".join(marks), np.uint16).reshape(-1, VALUES))
            for pairs, known in ((sure, True), (open_, False)):
                yield from ((max(ids[i], ids[j]), min(ids[i], ids[j]), known) for i, j in pairs)

    pairs = kept(map_rows(dealt, "u long, v long, sure boolean", compare)
                 .groupBy("u", "v").agg(F.max("sure").alias("sure")), "near-pairs")
    one = texts.select(F.col("id").alias("u"), F.col("text").alias("one"))
    two = texts.select(F.col("id").alias("v"), F.col("text").alias("two"))

    def decide(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            if similarity(row["one"], row["two"]) >= SIMILARITY:
                yield row["u"], row["v"]

    def linked(unsure: DataFrame) -> DataFrame:
        return map_rows(unsure.join(one, "u").join(two, "v"), "u long, v long", decide)

    links = kept(linked(pairs.select("u", "v")), "near-links")
    roots = components(links).select(F.col("u").alias("id"), F.col("v").alias("root"))
    named = kept(held.join(crowded.where(F.col("n") > SMALL), "bucket").join(roots, "id", "left")
                 .select("bucket", "id", F.coalesce("root", "id").alias("root")), "near-places")
    # Rows outside a bucket's largest component meet all its rows: blocks of the former by blocks of the latter.
    parts = named.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket") \
        .agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n")).where("n > most.n") \
        .select("bucket", F.col("most.root").alias("most"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("a"),
                F.ceil(F.col("n") / BLOCK).alias("b"))
    spread = F.shiftright(F.xxhash64("id", "bucket"), 20)
    met = named.join(parts, "bucket")
    sides = met.where("root != most").select("bucket", "id", "root", F.lit(True).alias("open"), F.pmod(spread, "a").alias("one"),
                                             F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("two")) \
        .unionByName(met.select("bucket", "id", "root", F.lit(False).alias("open"), F.pmod(spread, "b").alias("two"),
                                F.explode(F.sequence(F.lit(0).cast("long"), F.col("a") - 1)).alias("one")))
    again = sides.join(marks, "id") \
        .repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "open", "id")

    def compare_parted(stream: Iterator[dict]) -> Iterator[tuple]:
        for _, group in groupby(stream, key=lambda r: (r["bucket"], r["one"], r["two"])):
            held: dict[bool, tuple[list, list, list]] = {True: ([], [], []), False: ([], [], [])}
            for r in group:
                for column, name in zip(held[r["open"]], ("id", "root", "sketch")):
                    column.append(r[name])
            (ids, left_roots, left), (others, roots, right) = held[True], held[False]
            found = still_open(np.frombuffer(b"".join(left), np.uint16).reshape(-1, VALUES), np.array(left_roots, np.int64),
                               np.frombuffer(b"".join(right), np.uint16).reshape(-1, VALUES), np.array(roots, np.int64))
            yield from ((max(ids[i], others[j]), min(ids[i], others[j])) for i, j in found)

    more = map_rows(again, "u long, v long", compare_parted).distinct().join(pairs, ["u", "v"], "left_anti")
    return links.unionByName(linked(more))


def simhash_links(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): links between classes (id, fp) of different texts (id, text) whose fingerprints lie within REACH bits.

    Classes of one fingerprint meet its least class; the tree's links between fingerprints join their least classes.
    Each proposed pair is decided on the exact sets.
    """
    prints = kept(classes.groupBy("fp").agg(F.min("id").alias("least")), "near-prints")
    same = classes.join(prints, "fp").where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    tied = fingerprint_links(prints.select("fp"), REACH)
    across = tied.join(prints.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u") \
        .join(prints.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v").select("a", "b")
    pairs = same.unionByName(across).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    one = texts.select(F.col("id").alias("u"), F.col("text").alias("one"))
    two = texts.select(F.col("id").alias("v"), F.col("text").alias("two"))

    def decide(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            if similarity(row["one"], row["two"]) >= SIMILARITY:
                yield row["u"], row["v"]

    return map_rows(pairs.join(one, "u").join(two, "v"), "u long, v long", decide)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: columns of ``documents``.

    A group is a connected component of documents whose sets of five-word shingles (A-Z lower-cased;
    fewer words count as one shingle) have a similarity of 0.8 or more. The least doc_id stays; a
    row without doc_id stays only if no other of its group has one. Texts without words, null and
    empty ones, are one group. Of equal rows one stays. An empty table stays empty.
    """
    def marked(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            name = xxhash.xxh64_intdigest(b" ".join(w.lower() for w in words(row["text"])))
            least, fp = marks(row["text"])
            bands, values = [], None
            if least is not None:
                bands = [xxhash.xxh64_intdigest(least[ROWS * b:ROWS * (b + 1)].tobytes(), b) - (1 << 63)
                         for b in range(BANDS)]
                values = (least & np.uint32(0xFFFF)).astype(np.uint16).tobytes()
            yield row["key"], row["key2"], row["doc_id"], name - (1 << 63), values, bands, fp

    frame = docs.select(F.col("doc_id").cast("long"), "text", *row_keys("doc_id", "text"))
    rows = kept(map_rows(frame, "key long, key2 long, doc_id long, id long, sketch binary, bands array<long>, fp long",
                         marked), "near-sketches")
    classes = rows.groupBy("id").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands"),
                                     F.first("fp").alias("fp"), F.min(F.struct("key", "key2")).alias("row"))
    kept_rows = classes.select("id", "row.key", "row.key2")
    texts = frame.join(kept_rows, ["key", "key2"]).select("id", "text").dropDuplicates(["id"])
    worded = classes.where("sketch is not null")
    links = near_links(worded.select("id", "sketch", "bands"), texts) \
        .unionByName(simhash_links(worded.select("id", "fp"), texts))
    roots = components(links).select(F.col("u").alias("id"), F.col("v").alias("root"))
    stays = rows.join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")) \
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "key2")).alias("least")) \
        .select("least.key", "least.key2")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars", *row_keys("doc_id", "text"))
    return plain.join(stays, ["key", "key2"]).dropDuplicates(["key", "key2"]).drop("key", "key2")
