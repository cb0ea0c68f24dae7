"""Line dedup: winnowed line hashes find shared runs of lines; later copies of a run are deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from runhealth.llm.common import kept, map_rows, row_keys, words

# A shared run counts from this many words on. Lines shorter than SHORT_WORDS become a
# fingerprint only where a window has no longer line.
MIN_WORDS = 40
SHORT_WORDS = 5
# Occurrences of one fingerprint that one window task puts in order.
SALT_ROWS = 20_000


def line_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line number, hash, words) of each line that has a word. White space between words does not count."""
    numbers, hashes, counts = [], [], []
    for number, line in enumerate((text or "").split("\n")):
        if found := words(line):
            numbers.append(number)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(found)))
            counts.append(len(found))
    return np.array(numbers, np.int32), np.array(hashes, np.uint64), np.array(counts, np.int32)


def window_ends(counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Running word counts, and the end of the window at each line: the shortest stretch from there with ``min_words`` words."""
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return total, np.searchsorted(total, total[:-1] + min_words)  # past the last line: no window


def selections(hashes: np.ndarray, counts: np.ndarray, min_words: int) -> list[int]:
    """The position that each window selects: its minimum.

    It depends on the window's lines alone: the least hash among its long lines, if it has any,
    and the last such line among equal ones.
    """
    def least(begin: int, end: int) -> int:
        return end - 1 - int(np.argmin(order[begin:end][::-1]))

    _, last = window_ends(counts, min_words)
    order = (hashes >> np.uint64(1)) | (np.uint64(1) << np.uint64(63)) * (counts < SHORT_WORDS).astype(np.uint64)
    chosen: list[int] = []
    best = -1
    for i in range(int(np.searchsorted(last, len(hashes), side="right"))):
        end = int(last[i])
        if best < i:
            best = least(i, end)
        else:
            start = int(last[i - 1])
            if start < end:
                new = least(start, end)
                if order[new] <= order[best]:
                    best = new
        chosen.append(best)
    return chosen


def fingerprints(hashes: np.ndarray, counts: np.ndarray, min_words: int) -> list[int]:
    """Positions of window minima; any run of lines with ``min_words`` words or more holds one."""
    return list(dict.fromkeys(selections(hashes, counts, min_words)))


def stretches(hashes: np.ndarray, counts: np.ndarray, min_words: int, at: list[int]) -> Iterator[tuple[int, int]]:
    """(position, hash of the lines) for each shortest stretch of ``min_words`` words that selects a position of ``at``.

    Stretches from a line on and up to a line; the latter selects what the window at its first
    line does. Together they cover every line of every longer run.
    """
    total, last = window_ends(counts, min_words)
    chosen = selections(hashes, counts, min_words)
    ends = np.flatnonzero(total >= min_words)
    begins = np.searchsorted(total, total[ends] - min_words, side="right") - 1
    spans = {*enumerate(last[:len(chosen)].tolist()), *zip(begins.tolist(), ends.tolist())}
    wanted = set(at)
    for begin, end in sorted(spans):
        if chosen[begin] in wanted:
            yield chosen[begin], xxhash.xxh64_intdigest(hashes[begin:end].tobytes()) - (1 << 63)


def shared_runs(later: np.ndarray, earlier: np.ndarray, counts: np.ndarray, anchors: list[tuple[int, int]],
                min_words: int, same: bool) -> list[tuple[int, int]]:
    """Extend each anchor (position in later, in earlier) both ways; [begin, end) runs of ``later`` that are long enough."""
    runs, reached = [], {}
    for at, to in sorted(anchors):
        shift = at - to
        if same and shift <= 0 or reached.get(shift, -1) > at:
            continue
        n = min(len(later) - at, len(earlier) - to)
        differs = np.flatnonzero(later[at:at + n] != earlier[to:to + n])
        end = at + (int(differs[0]) if len(differs) else n)
        m = min(at, to)
        differs = np.flatnonzero(later[at - m:at] != earlier[to - m:to])
        begin = at - m + (int(differs[-1]) + 1 if len(differs) else 0)
        reached[shift] = end
        if int(counts[begin:end].sum()) >= min_words:
            runs.append((begin, end))
    return runs


def repeated_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, key2, lines): numbers of the lines that each document loses."""
    def hashed(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            numbers, hashes, counts = line_hashes(row["text"])
            if len(hashes):
                yield (row["key"], row["key2"], row["doc_id"], numbers.tobytes(), hashes.tobytes(), counts.tobytes(),
                       fingerprints(hashes, counts, min_words))

    lines = kept(map_rows(
        docs.select(F.col("doc_id").cast("long"), "text", *row_keys("doc_id", "text")),
        "key long, key2 long, doc_id long, numbers binary, hashes binary, counts binary, chosen array<int>", hashed,
    ).dropDuplicates(["key", "key2"]), "lines")

    # Window minima by hash: the eight bytes of the line's hash as they stand in the array.
    marks = lines.select("key", "key2", "doc_id", "hashes", F.explode("chosen").alias("at")) \
        .select("key", "key2", "doc_id", "at", F.substring("hashes", F.col("at") * 8 + 1, F.lit(8)).alias("mark"))
    place = F.struct("doc_id", "key", "key2", "at")
    often = marks.groupBy("mark").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    found = kept(marks.join(often, "mark"), "line-marks")
    # Each occurrence meets the first one and the one before it: pairs grow with occurrences, not their square.
    before = F.lag(place).over(Window.partitionBy("mark", "salt").orderBy("doc_id", "key", "key2", "at"))
    met = found.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.ceil(F.col("n") / SALT_ROWS).cast("long"))) \
        .withColumn("before", before).withColumn("partner", F.explode(F.array("first", "before")))

    # With over two occurrences, a run may share its minimum with other texts than its own copy. There
    # whole stretches tell them apart, and the first holder of a stretch suffices.
    def told_apart(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            hashes, counts = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], np.int32)
            for at, mark in stretches(hashes, counts, min_words, row["crowded"]):
                yield row["key"], row["key2"], row["doc_id"], at, mark

    crowded = found.where("n > 2").groupBy("key", "key2").agg(F.collect_list("at").alias("crowded"))
    whole = kept(map_rows(crowded.join(lines.drop("numbers", "chosen"), ["key", "key2"]),
                          "key long, key2 long, doc_id long, at int, mark long", told_apart), "line-stretches")
    holders = whole.groupBy("mark").agg(F.count("*").alias("n"), F.min(place).alias("partner")).where("n > 1")
    pairs = met.select("key", "key2", "doc_id", "at", "partner") \
        .unionByName(whole.join(holders, "mark").select("key", "key2", "doc_id", "at", "partner")) \
        .where(F.col("partner").isNotNull() & (F.col("partner") != place)) \
        .groupBy("key", "key2", F.col("partner.key").alias("e_key"), F.col("partner.key2").alias("e_key2")) \
        .agg(F.collect_set(F.struct("at", F.col("partner.at").alias("to"))).alias("anchors"))

    texts = lines.select("key", "key2", "numbers", "hashes", "counts")
    others = lines.select(F.col("key").alias("e_key"), F.col("key2").alias("e_key2"), F.col("hashes").alias("earlier"))
    both = pairs.join(texts, ["key", "key2"]).join(others, ["e_key", "e_key2"])

    def extended(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            later, earlier = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["earlier"], np.uint64)
            same = (row["key"], row["key2"]) == (row["e_key"], row["e_key2"])
            anchors = [(a["at"], a["to"]) for a in row["anchors"]]
            counts, numbers = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["numbers"], np.int32)
            for begin, end in shared_runs(later, earlier, counts, anchors, min_words, same):
                yield row["key"], row["key2"], numbers[begin:end].tolist()

    return map_rows(both, "key long, key2 long, lines array<int>", extended) \
        .groupBy("key", "key2").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) without later copies of runs of lines, plus n_lines and n_removed.

    A run is consecutive lines, blank ones aside, of ``min_words`` words or more together. Order is
    doc_id, then a hash of the row; the first copy stays, later ones go, also inside one document.
    Runs are found at window minima of line hashes, matched with the first and the preceding
    document that holds the same minimum (of more than two, also with the first that holds the same
    whole stretch), and extended both ways line by line; no repeated run is missed. A document may be
    left with empty text; null text stays null. Repeated rows count as one document and lose the
    same lines. Rows without doc_id come first in order. n_chars follows the text.
    """
    gone = repeated_lines(docs, min_words)
    keyed = docs.select("doc_id", "text", "lang", "source", "n_chars", *row_keys("doc_id", "text"))

    def rows(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            text, n_chars, removed = row["text"], row["n_chars"], set(row["lines"] or ())
            lines = text.count("\n") + 1 if text else 0
            if removed:
                text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in removed)
                n_chars = len(text)
            yield row["doc_id"], text, row["lang"], row["source"], n_chars, lines, len(removed)

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").schema
    schema = plain.add("n_lines", "long").add("n_removed", "long")
    return map_rows(keyed.join(gone, ["key", "key2"], "left").drop("key", "key2"), schema, rows)
