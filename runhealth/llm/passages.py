"""Passage dedup: winnowed word shingles find repeated passages word by word; later copies are deleted."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from runhealth.llm.blocks import ragged
from runhealth.llm.common import SPACES, encoded, kept, map_rows, row_keys

# A passage counts from this many words on. Windows of that size are found at the least of their
# shingles of SHINGLE words.
MIN_WORDS = 40
SHINGLE = 20
# Bytes of text that are hashed at a time; a longer word is hashed on its own.
PIECE = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Odd bases of the polynomials over bytes and words, modulo 2^64.
_BYTE_BASE, _WORD_BASE, _CHECK_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES.encode())] = False
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _FACTOR
    return h ^ (h >> np.uint64(29))


@cache
def _held_powers(base: int) -> np.ndarray:
    return _new_powers(base, PIECE + 1)


def _new_powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)])) if n else np.zeros(0, np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    return _held_powers(base)[:n] if n <= PIECE + 1 else _new_powers(base, n)


class Stretches:
    """Hashes of any stretches of a sequence, from sums over its beginnings."""

    def __init__(self, values: np.ndarray, base: int):
        self.inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.total[1:])

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.total[ends] - self.total[begins]) * self.inverse[begins] + (ends - begins).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """The hash of each stretch of ``size``."""
        n = max(len(self.total) - size, 0)
        return _mixed((self.total[size:] - self.total[:n]) * self.inverse[:n] + np.uint64(size))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after it."""
    inside = _IS_WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edges[::2], edges[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw, out, i = np.frombuffer(data, np.uint8), np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        begin = int(starts[i])
        j = int(np.searchsorted(ends, begin + PIECE, "right"))
        if j <= i:
            out[i] = xxhash.xxh64_intdigest(data[begin:int(ends[i])])
            i += 1
            continue
        sums = Stretches(_BYTES[raw[begin:int(ends[j - 1])]], _BYTE_BASE)
        out[i:j] = sums.hashes(starts[i:j] - begin, ends[i:j] - begin)
        i = j
    return out


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each stretch of ``size`` words."""
    return Stretches(hashes, _WORD_BASE).windows(size)


def least(grams: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` grams by the upper half of their bits, the last of equal ones."""
    low = np.uint64(0xFFFFFFFF)
    held, reach, n = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64)), 1, len(grams) - width + 1
    while 2 * reach <= width:
        held, reach = np.minimum(held[:-reach], held[reach:]), 2 * reach
    return (low - (np.minimum(held[:n], held[width - reach:width - reach + n]) & low)).astype(np.int64)


def selected(hashes: np.ndarray, bounds: np.ndarray, min_words: int, shingle: int) -> tuple[np.ndarray, ...]:
    """(mark, cover, first word, word after the last) of each run of windows of ``min_words`` words that select the same shingle.

    ``bounds`` cut the words into documents; no window crosses them. A window selects its least shingle, so it depends on the
    window's words alone. ``cover`` is a hash of all words of the run's windows.
    """
    sums = Stretches(hashes, _WORD_BASE)
    grams, sizes = sums.windows(shingle), np.maximum(np.diff(bounds) - min_words + 1, 0)
    if not sizes.sum():
        none = np.zeros(0, np.int64)
        return grams[:0], grams[:0], none, none
    at = ragged(bounds[:-1], sizes).astype(np.int64)
    chosen = least(grams, min_words - shingle + 1)[at]
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    begins, ends = at[first], at[np.append(first[1:], len(at)) - 1] + min_words
    return grams[chosen[first]], Stretches(hashes, _CHECK_BASE).hashes(begins, ends), begins, ends


def without(data: bytes, begins: np.ndarray, span_ends: np.ndarray) -> tuple[bytes, int]:
    """The text without the words [begin, end) of each span, and how many lines lost all their words.

    Such lines go with their line end. In a line that keeps words, the space after a deleted word goes, or
    before it at the end of the line.
    """
    starts, ends = word_places(data)
    n = len(starts)
    gone = np.cumsum(np.bincount(begins, minlength=n + 1) - np.bincount(span_ends, minlength=n + 1))[:n] > 0
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line_begins, line_ends = np.append(0, breaks + 1).tolist(), np.append(breaks, len(data)).tolist()
    first = np.append(np.searchsorted(starts, line_begins), len(starts))
    lost = np.diff(np.append(0, np.cumsum(gone))[first])
    out, removed, at = [], 0, 0
    for k in np.flatnonzero(lost).tolist():
        if at < k:
            out.append(data[line_begins[at]:line_ends[k - 1]])
        a, b, at = int(first[k]), int(first[k + 1]), k + 1
        if lost[k] == b - a:
            removed += 1
            continue
        edges = np.flatnonzero(np.diff(~gone[a:b], prepend=False, append=False)) + a
        parts = [data[line_begins[k]:starts[a]]]
        for i, j in edges.reshape(-1, 2).tolist():
            end = line_ends[k] if j == b else int(ends[j - 1] if j == edges[-1] else starts[j])
            parts.append(data[int(starts[i]):end])
        out.append(b"".join(parts))
    if at < len(line_begins):
        out.append(data[line_begins[at]:])
    return b"\n".join(out), removed


def released(df: DataFrame, purpose: str) -> DataFrame:
    """``kept``, after which Spark may delete the shuffle files that led to it: it does so when the driver collects garbage."""
    out = kept(df, purpose)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _same(a: DataFrame, b: DataFrame) -> Column:
    """The same document: equal doc_id, or none, and hash."""
    return (a["key"] == b["key"]) & a["doc_id"].eqNullSafe(b["doc_id"])


MARKED = "key long, doc_id long, mark array<long>, cover array<long>, at array<int>, reach array<int>"


def _marked(min_words: int, shingle: int):
    """Arrow map from (doc_id, text, key) to MARKED, a group of documents of about PIECE bytes at a time."""
    arrow = to_arrow_schema(StructType.fromDDL(MARKED))

    def group(part: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
        data = b"\n".join(texts)
        starts, ends = word_places(data)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        bounds = np.searchsorted(starts, offsets)
        marks, covers, begins, after = selected(word_hashes(data, starts, ends), bounds, min_words, shingle)
        of = np.searchsorted(bounds, begins, "right") - 1
        has, counts = np.unique(of, return_counts=True)
        if not len(has):
            return None
        cuts = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        lists = [marks.view(np.int64), covers.view(np.int64), (begins - bounds[of]).astype(np.int32), (after - begins).astype(np.int32)]
        whole = [part.column(name).take(pa.array(has)) for name in ("key", "doc_id")]
        return pa.RecordBatch.from_arrays(whole + [
            pa.ListArray.from_arrays(cuts, pa.array(x), type=field.type) for x, field in zip(lists, list(arrow)[2:])], schema=arrow)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + PIECE, "right")))
                if out := group(batch.slice(at, end - at)):
                    yield out
                at = end

    return mapped


def repeated_words(docs: DataFrame, min_words: int, shingle: int) -> DataFrame:
    """(key, doc_id, spans): stretches [begin, end) of words that each document loses."""
    frame = docs.select(F.col("doc_id").cast("long"), "text", row_keys("doc_id", "text")[0])
    place = F.struct("doc_id", "key", "at")

    # What all windows of a mark cover, as a whole: where it is repeated, each window is. Where a mark stands in
    # different covers, the first holder of each gives its windows one by one.
    held = released(frame.mapInArrow(_marked(min_words, shingle), MARKED), "passage-marks")
    often = held.select(F.explode("mark").alias("mark")).groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    marks = held.select("key", "doc_id", F.inline(F.arrays_zip("mark", "cover", "at", "reach")))
    covered = released(marks.join(often, "mark"), "passage-covers")
    holders = released(covered.groupBy("mark", "cover").agg(F.count("*").alias("n"), F.min(place).alias("first"),
                                                           F.max("reach").alias("reach")), "passage-holders")
    whole = covered.join(holders.where("n > 1").select("mark", "cover", "first"), ["mark", "cover"]) \
        .where(place != F.col("first")).select("key", "doc_id", "at", "reach")

    mixed = holders.groupBy("mark").agg(F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    parted = holders.join(mixed, "mark").select("first.doc_id", "first.key", "first.at", "reach")

    def windows(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            data = encoded(row["text"])
            hashes = word_hashes(data, *word_places(data))
            spans = np.array([(a["at"], a["reach"] - min_words + 1) for a in row["spans"]], np.int64)
            at = np.unique(ragged(spans[:, 0], spans[:, 1]))
            mark, check = (Stretches(hashes, base).hashes(at, at + min_words) for base in (_WORD_BASE, _CHECK_BASE))
            yield row["key"], row["doc_id"], mark.view(np.int64), (check >> np.uint64(32)).astype(np.uint32).view(np.int32), at.astype(np.int32)

    asked = parted.groupBy("key", "doc_id").agg(F.collect_set(F.struct("at", "reach")).alias("spans"))
    texts = asked.join(frame, _same(asked, frame)).select(asked["key"], asked["doc_id"], "spans", "text")
    single = released(map_rows(texts, "key long, doc_id long, mark array<long>, check array<int>, at array<int>", windows, flush=256),
                      "passage-windows")
    each = single.select("key", "doc_id", F.inline(F.arrays_zip("mark", "check", "at")))
    twice = each.groupBy("mark", "check").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = released(each.join(twice, ["mark", "check"]), "passage-repeated")
    firsts = repeated.groupBy("mark", "check").agg(F.min(place).alias("first"))
    later = repeated.join(firsts, ["mark", "check"]).where(place != F.col("first")) \
        .select("key", "doc_id", "at", F.lit(min_words).alias("reach"))

    span = F.struct(F.col("at").alias("begin"), (F.col("at") + F.col("reach")).alias("end"))
    return released(whole.unionByName(later).groupBy("key", "doc_id").agg(F.collect_set(span).alias("spans")),
                    "passage-spans")


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) without later copies of passages, plus n_lines and n_removed.

    A passage is ``min_words`` consecutive words or more, wherever lines begin and end in it. Every word of a
    stretch of ``min_words`` words of which an earlier copy exists goes; order is doc_id, then a hash of the row,
    then the place in the text, so the first copy stays, also inside one document. Lines that lose all
    their words go and count in n_removed; of others the rest stays. A document may be left with empty text; null
    text stays null. Repeated rows count as one document and lose the same words. Rows without doc_id come first
    in order. n_chars follows the text. Words and covers are compared by 64-bit hashes,
    single stretches by 96 bits.
    """
    gone = repeated_words(docs, min_words, shingle)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    keyed = plain.withColumn("key", row_keys("doc_id", "text")[0])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = batch.column("text"), batch.column("spans")
            lines = pc.if_else(pc.greater(pc.fill_null(pc.binary_length(text), 0), 0), pc.add(pc.count_substring(text, "\n"), 1), 0)
            removed = np.zeros(batch.num_rows, np.int64)
            n_chars, hit = batch.column("n_chars"), pc.is_valid(spans)
            at = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
            if len(at):
                places = spans.filter(hit)
                begins, ends = (places.flatten().field(i).to_numpy() for i in range(2))
                cuts = np.append(0, np.cumsum(pc.list_value_length(places).to_numpy())).tolist()
                left = [without(data, begins[a:b], ends[a:b])
                        for data, a, b in zip(text.filter(hit).cast(pa.binary()).to_pylist(), cuts, cuts[1:])]
                removed[at] = [n for _, n in left]
                rest = pa.array([data for data, _ in left], pa.binary()).cast(pa.string())
                text = pc.replace_with_mask(text, hit, rest.cast(text.type))
                n_chars = pc.replace_with_mask(n_chars, hit, pc.utf8_length(rest).cast(n_chars.type))
            held = {"text": text, "n_chars": n_chars, "n_lines": lines, "n_removed": pa.array(removed)}
            yield pa.RecordBatch.from_arrays([
                (held[f.name] if f.name in held else batch.column(f.name)).cast(f.type) for f in arrow], schema=arrow)

    columns = [keyed[c] for c in plain.columns]
    both = keyed.join(gone, _same(keyed, gone), "left").select(*columns, "spans")
    schema = plain.schema.add("n_lines", "long").add("n_removed", "long")
    arrow = to_arrow_schema(schema)
    return both.mapInArrow(cut, schema)
