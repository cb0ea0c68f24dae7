"""LM scoring by words: loss under a target and a background bigram model over one vocabulary, compared per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from runhealth.llm.blocks import Numbers, loosen, loosen_planes, squeeze, squeeze_planes
from runhealth.llm.common import kept, map_rows, words

# Counts that the share of a word alone stands for in the share of a pair.
STRENGTH = 8.0
BROADCAST_IDS = 1 << 21
BLOCK_BYTES = 12 << 20
# Stands before the first word of a text; part of no vocabulary.
START = np.uint64(0)
WORD, HEAD, PAIR = (np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_ASK, _LAYOUT, _ANSWER, _SIZES = range(4)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0xFF51AFD7ED558CCD)) ^ (b + np.uint64(0x2545F4914F6CDD1D) + (a << np.uint64(6)) + (a >> np.uint64(2)))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


class Block:
    """Documents of one task: words as 64-bit hashes, numbered, and the events they make up.

    Three kinds of events are counted: a word, a word before another one, and a pair. Each has a 64-bit key and how often it
    occurs in all documents and in the targets.
    """

    def __init__(self, hashes: np.ndarray, codes: np.ndarray, n_words: np.ndarray, target: np.ndarray):
        self.hashes, self.codes, self.n_words, self.target = hashes, codes.astype(np.int64), n_words.astype(np.int64), target
        here = hashes[self.codes]
        before = np.concatenate([[START], here[:-1]]).astype(np.uint64)[:len(here)]
        firsts = np.cumsum(self.n_words) - self.n_words
        before[firsts[self.n_words > 0]] = START
        chosen = np.repeat(target, self.n_words).astype(bool)
        self.pair_keys, self.pairs = np.unique(mixed(before ^ PAIR, here), return_inverse=True)
        self.heads, self.before = np.unique(before, return_inverse=True)
        self.word_keys, self.head_keys = mixed(hashes, np.full(len(hashes), WORD)), mixed(self.heads, np.full(len(self.heads), HEAD))
        n = len(hashes), len(self.heads), len(self.pair_keys)
        inverse = [self.codes, self.before, self.pairs]
        self.keys = np.concatenate([self.word_keys, self.head_keys, self.pair_keys])
        self.every = np.concatenate([np.bincount(i, minlength=m) for i, m in zip(inverse, n)])
        self.chosen = np.concatenate([np.bincount(i[chosen], minlength=m) for i, m in zip(inverse, n)])
        self.is_word = np.arange(sum(n)) < n[0]
        self.sections = n
        self.order = np.argsort(self.keys, kind="stable")

    def buckets(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """Places in ``keys`` of each bucket's events, in order of their keys: buckets are ranges of keys."""
        of = bucket_of(self.keys[self.order], n)
        cuts = np.flatnonzero(np.diff(of)) + 1
        for mine in np.split(self.order, cuts) if len(of) else []:
            yield int(bucket_of(self.keys[mine[:1]], n)[0]), mine

    def losses(self, every: np.ndarray, chosen: np.ndarray, total: int, chosen_total: int, vocabulary: int) -> Iterator[np.ndarray]:
        """Summed bits per document under the target and the background model, given all events' counts."""
        some = self.n_words > 0
        begins = (np.cumsum(self.n_words) - self.n_words)[some]
        a, b, _ = np.cumsum(self.sections)
        for counts, size in ((chosen, chosen_total), (every, total)):
            one, head, pair = counts[:a], counts[a:b], counts[b:]
            p1 = (one[self.codes] + 1) / (size + vocabulary)
            bits = np.log2(head[self.before] + STRENGTH) - np.log2(pair[self.pairs] + STRENGTH * p1)
            sums = np.zeros(len(some))
            if len(begins):
                sums[some] = np.add.reduceat(bits, begins)
            yield sums


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


class Reader:
    """Gathers documents until a block is full."""

    def __init__(self) -> None:
        self.numbers, self.codes, self.rows, self.size = Numbers(), [], [], 0

    def add(self, row: dict) -> None:
        found = words(row["text"])
        self.codes.append(np.fromiter(map(self.numbers.__getitem__, found), "<u4", len(found)))
        self.rows.append((row["doc_id"], len(found), bool(row["target"])))
        self.size += len(row["text"] or "")

    def block(self) -> Block:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.numbers), np.uint64, len(self.numbers))
        hashes[hashes == START] = 1
        codes = np.concatenate(self.codes)
        # Equal hashes are one word, as everywhere else.
        hashes, number = np.unique(hashes, return_inverse=True)
        order = np.argsort(-np.bincount(number[codes], minlength=len(hashes)), kind="stable")
        rank = np.empty(len(hashes), np.int64)
        rank[order] = np.arange(len(hashes))
        return Block(hashes[order], rank[number[codes]] if len(codes) else codes.astype(np.int64),
                     np.array([n for _, n, _ in self.rows], np.int64), np.array([t for _, _, t in self.rows], bool))


SENT = "block string, bucket int, kind int, payload binary"


def _blocks(docs: DataFrame, buckets: int, layout: bool) -> DataFrame:
    """A block's events by bucket, or what it takes to make the block again; named by a hash of its content."""
    def sent(reader: Reader) -> Iterator[tuple]:
        block = reader.block()
        doc_ids = np.array([0 if d is None else d for d, _, _ in reader.rows], "<i8")
        no_id = np.array([d is None for d, _, _ in reader.rows], "u1")
        plan = [squeeze_planes(block.hashes), squeeze_planes(block.codes.astype("<u4")), squeeze_planes(block.n_words.astype("<u4")),
                squeeze(block.target.astype("u1").tobytes()), squeeze(doc_ids.tobytes()), squeeze(no_id.tobytes())]
        state = xxhash.xxh3_128()
        for part in plan:
            state.update(part)
        name = state.hexdigest()
        if layout:
            yield name, -1, _LAYOUT, b"".join(plan)
            return
        for bucket, mine in block.buckets(buckets):
            keys = block.keys[mine]
            yield name, bucket, _ASK, b"".join([
                squeeze_planes(np.diff(keys, prepend=np.uint64(0))), squeeze_planes(block.every[mine].astype("<u4")),
                squeeze_planes(block.chosen[mine].astype("<u4")), squeeze(np.packbits(block.is_word[mine]).tobytes())])

    def rows(stream: Iterator[dict]) -> Iterator[tuple]:
        reader = Reader()
        for row in stream:
            reader.add(row)
            if reader.size >= BLOCK_BYTES:
                yield from sent(reader)
                reader = Reader()
        if reader.rows:
            yield from sent(reader)

    return map_rows(docs, SENT, rows)


def _sums(asked: DataFrame, buckets: int) -> DataFrame:
    """Each bucket's event counts over all blocks, sent back to the blocks that asked, in their order; and the bucket's
    number of words, total and chosen, for the vocabulary's sizes. A bucket's events are in memory."""
    def rows(stream: Iterator[dict]) -> Iterator[tuple]:
        held: list[tuple] = []
        bucket = None
        for row in stream:
            if row["bucket"] != bucket:
                yield from answered(bucket, held)
                held, bucket = [], row["bucket"]
            delta, at = loosen_planes(row["payload"], 8)
            every, at = loosen_planes(row["payload"], 4, at)
            chosen, at = loosen_planes(row["payload"], 4, at)
            flags, _ = loosen(row["payload"], at)
            is_word = np.unpackbits(np.frombuffer(flags, "u1"), count=len(delta)).astype(bool)
            held.append((row["block"], np.cumsum(delta, dtype=np.uint64), every, chosen, is_word))
        yield from answered(bucket, held)

    def answered(bucket: int | None, held: list[tuple]) -> Iterator[tuple]:
        if not held:
            return
        names, keys, every, chosen, is_word = zip(*held)
        known, where = np.unique(np.concatenate(keys), return_inverse=True)
        every, chosen = (np.bincount(where, np.concatenate(c), len(known)).astype(np.int64) for c in (every, chosen))
        at = 0
        for name, mine in zip(names, keys):
            here = where[at:at + len(mine)]
            at += len(mine)
            yield name, bucket, _ANSWER, squeeze_planes(every[here].astype("<u8")) + squeeze_planes(chosen[here].astype("<u8"))
        word = np.zeros(len(known), bool)
        word[where[np.concatenate(is_word)]] = True
        yield "", bucket, _SIZES, np.array([word.sum(), every[word].sum(), chosen[word].sum()], "<i8").tobytes()

    return map_rows(asked.repartition(buckets, "bucket").sortWithinPartitions("bucket"), SENT, rows)


SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def score_documents(docs: DataFrame, targets: DataFrame, buckets: int | None = None, stored: bool = False) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for every row of ``docs`` (doc_id, text).

    Tokens are words; the vocabulary is all words of ``docs``, for both models. ``targets`` (doc_id) names
    the documents the target model is made from; the background model is made from all. Both are bigram models:
    a pair's share of its first word, smoothed by ``STRENGTH`` counts of the word's own share, which adds one
    to each word. Losses are bits per word; score is target minus background loss, so lower is nearer to the
    target. A target's own words are in both models, so its score is lower than a like document's that is none. Text
    without words has no tokens and null losses and score; without targets their model is uniform. Rows with a null doc_id are
    counted and scored and are never targets. Repeated rows count each time. Other columns are ignored. Words and pairs
    are told apart by 64-bit hashes. ``docs`` is read twice: unless it is ``stored``, read from files as it is,
    it is written out first, since rows that come in another order the second time raise.

    A task cuts its documents into blocks of BLOCK_BYTES. A block's distinct events, words, first words and pairs, go once each to
    ``buckets`` (the session's shuffle partitions) by ranges of their hashes, so the commonest pair weighs a row per block like any
    other; sums over all blocks come back in the order asked and meet the block's layout. Texts are never
    shuffled. Per bucket three sums come to the driver.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = targets.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids) if small else ids.hint("merge"), "doc_id", "left")
    if not (stored and small):
        marked = kept(marked, "scoring-documents")
    sums = kept(_sums(_blocks(marked, buckets, False), buckets), "event-sums")
    sizes = [np.frombuffer(bytes(r["payload"]), "<i8") for r in sums.where(F.col("kind") == _SIZES).select("payload").collect()]
    vocabulary, total, chosen_total = (int(x) for x in np.sum(sizes, axis=0)) if sizes else (0, 0, 0)

    def scored(stream: Iterator[dict]) -> Iterator[tuple]:
        name, block, rows, copies, mine = None, None, None, 0, {}
        every = chosen = answered = None
        for row in stream:
            if row["block"] != name:
                if block:
                    yield from finish(block, rows, copies, every, chosen, answered)
                name, block, copies = row["block"], None, 0
            if row["kind"] == _LAYOUT:
                copies += 1
                if block is None:
                    block, rows = remade(row["payload"])
                    mine = dict(block.buckets(buckets))
                    every, chosen = (np.zeros(len(block.keys), np.int64) for _ in range(2))
                    answered = np.zeros(len(block.keys), bool)
            elif block is None or row["bucket"] not in mine:
                raise ValueError("counts without a block: the documents changed while they were read, write them to a table first")
            else:
                at = mine[row["bucket"]]
                every[at], end = loosen_planes(row["payload"], 8)
                chosen[at], _ = loosen_planes(row["payload"], 8, end)
                answered[at] = True
        if block:
            yield from finish(block, rows, copies, every, chosen, answered)

    def finish(block: Block, rows: list, copies: int, every: np.ndarray, chosen: np.ndarray, answered: np.ndarray) -> Iterator[tuple]:
        if not answered.all():
            raise ValueError("events without counts: the documents changed while they were read, write them to a table first")
        target, background = block.losses(every, chosen, total, chosen_total, vocabulary)
        for doc_id, n, t, b in zip(rows, block.n_words.tolist(), target.tolist(), background.tolist()):
            for _ in range(copies):
                yield (doc_id, n, t / n, b / n, (t - b) / n) if n else (doc_id, 0, None, None, None)

    both = sums.where(F.col("kind") == _ANSWER).unionByName(_blocks(marked, buckets, True))
    return map_rows(both.repartition("block").sortWithinPartitions("block", "bucket"), SCORES, scored)


def remade(payload: bytes) -> tuple[Block, list[int | None]]:
    hashes, at = loosen_planes(payload, 8)
    codes, at = loosen_planes(payload, 4, at)
    n_words, at = loosen_planes(payload, 4, at)
    target, at = loosen(payload, at)
    doc_ids, at = loosen(payload, at)
    no_id, _ = loosen(payload, at)
    rows = [None if none else d for d, none in zip(np.frombuffer(doc_ids, "<i8").tolist(), np.frombuffer(no_id, "u1").tolist())]
    return Block(hashes, codes, n_words, np.frombuffer(target, "u1").astype(bool)), rows
