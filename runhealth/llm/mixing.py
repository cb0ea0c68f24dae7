"""Mixing sources to target weights: blocks of words, multinomial draws per shard, permuted block numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from runhealth.llm.common import WORD, kept, map_rows, row_keys

# Weights of the sources in order, repeating; total share of all words; most uses of a word.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_USES = 2
BLOCK_WORDS = 32
SHARD_SLOTS = 1 << 14
TASK_SLOTS = 1 << 18
CHUNKS = 1024
SEED = 20
MASK = (1 << 64) - 1


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: int = MOST_USES) -> list[float]:
    """Words to take of each source: by weight, none above ``most`` times its size, the excess shared out again."""
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        part = {i: left * weights[i % len(weights)] / total for i in open_}
        over = [i for i in open_ if part[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = part[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in over]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 given by ``key``: a Feistel network, walked until it lands below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for turn in range(4):
            salt = np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 & MASK)
            left, right = right, left ^ (_mixed(right + salt) & low)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, key2, size, chunk) per row; the keys hash the row, chunk is a hash of the id."""
    return docs.select(
        F.col("doc_id").cast("long"), "source", *row_keys("doc_id", "source", "text"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.pmod(F.xxhash64("doc_id"), F.lit(CHUNKS)).cast("int").alias("chunk"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start``, the words of the same source before each row.

    Words of a source run in the order (chunk, doc_id, key). Sums per chunk come first, so a
    window holds one chunk of a source and not a whole source. Equal rows may change places.
    """
    chunks = rows.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("source", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "chunk").orderBy("doc_id", "key", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = [own["source"].eqNullSafe(chunks["source"]), own["chunk"] == chunks["chunk"]]
    return own.join(chunks, same).select(own["*"], (F.col("inner") + F.col("base")).alias("start")).drop("inner")


def plan(rows: DataFrame) -> list[tuple]:
    """Per source (number, source, size, target, blocks, slots), in the order of code points, null last.

    One row per source comes to the driver; a corpus names few sources, and their number is held to a million.
    """
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(1_000_001).collect()
    if len(found) > 1_000_000:
        raise ValueError("over a million sources: mix groups of sources instead")
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    wanted = targets([r["size"] for r in found])
    out = []
    for i, (r, target) in enumerate(zip(found, wanted)):
        n = -(-r["size"] // BLOCK_WORDS)
        out.append((i, r["source"], r["size"], target, n, min(MOST_USES * n, round(target * n / max(1, r["size"])))))
    return out


def shard_draws(spark, sources: list[tuple]) -> DataFrame:
    """(shard, number, first, n): how many slots each output shard gives each source, and which of the source's.

    Each shard draws multinomial counts with its own generator. Counts beyond a source's slots
    fall away and what a source lacks goes to further shards, so totals are met exactly.
    """
    slots = [s[5] for s in sources]
    total = sum(slots)
    share = np.array(slots, dtype=np.float64) / max(1, total)
    shards = -(-total // SHARD_SLOTS)

    def draw(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            shard = row["id"]
            size = min(SHARD_SLOTS, total - shard * SHARD_SLOTS)
            counts = np.random.Generator(np.random.Philox(key=[SEED, shard])).multinomial(size, share)
            yield from ((shard, int(i), int(counts[i])) for i in np.flatnonzero(counts))

    drawn = map_rows(spark.range(shards), "shard long, number int, n long", draw)
    limits = spark.createDataFrame([(s[0], s[5]) for s in sources if s[5]], "number int, slots long")
    before = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).join(limits, "number")
    inside = drawn.select("shard", "number", "first", F.least("n", F.col("slots") - F.col("first")).alias("n")) \
        .where("n > 0")
    total_drawn = drawn.groupBy("number", "slots").agg(F.sum("n").alias("n"))
    short = limits.join(total_drawn.drop("slots"), "number", "left") \
        .select("number", F.coalesce("n", F.lit(0)).alias("from"), "slots").where(F.col("from") < F.col("slots"))
    more = short.withColumn("first", F.explode(F.expr(f"sequence(from, slots - 1, {SHARD_SLOTS}L)"))).select(
        (F.lit(shards) + F.floor(F.col("first") / SHARD_SLOTS)).alias("shard"), "number", "first",
        F.least(F.lit(SHARD_SLOTS).cast("long"), F.col("slots") - F.col("first")).alias("n"))
    return inside.unionByName(more)


def drawn_blocks(spark, sources: list[tuple]) -> DataFrame:
    """(shard, number, block, use): each slot's block, by the source's own permutation; ``use`` counts passes over it."""
    blocks = {s[0]: s[4] for s in sources}

    def rows(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            number, n = row["number"], blocks[row["number"]]
            slot = np.arange(row["first"], row["first"] + row["n"], dtype=np.int64)
            for use in range(int(slot[0]) // n, int(slot[-1]) // n + 1):
                part = slot[slot // n == use] % n
                found = permuted(part, n, SEED * 1_000_003 + number * MOST_USES + use)
                yield from ((row["shard"], number, block, use) for block in found.tolist())

    tasks = max(1, -(-sum(s[5] for s in sources) // TASK_SLOTS))
    return map_rows(shard_draws(spark, sources).repartition(tasks, "shard", "number"),
                    "shard long, number int, block long, use int", rows, flush=1 << 15)


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, uses) of the mix of ``docs`` (doc_id, text, source; other columns are ignored).

    documents: per row doc_id, source, key, key2, size, number, start, source_size, target. uses: per
    block of ``BLOCK_WORDS`` words in the mix its source number, block, and the passes that take it
    (``use`` 0, 1). Sources weigh ``WEIGHTS`` in the order of their code points, null last, and share
    ``SHARE`` of all words, each at most ``MOST_USES`` times. The last block of a source may be short.
    Null or empty texts hold no words and are never taken; an empty table gives empty frames.
    """
    spark = docs.sparkSession
    rows = kept(sized(docs), "mix-sizes")
    sources = plan(rows)
    known = spark.createDataFrame([s[:4] for s in sources], "number int, name string, source_size long, target double")
    documents = placed(rows).join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name"))).drop("name", "chunk")
    return documents, drawn_blocks(spark, sources)


def touched(documents: DataFrame) -> DataFrame:
    """(number, start, keys, size, block, begin, words): the blocks in which each document has words, and how many."""
    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    begin: Column = F.greatest("start", F.col("block") * BLOCK_WORDS)
    end: Column = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    return documents.where("size > 0") \
        .select("number", "start", "key", "key2", "size", F.explode(F.sequence(first, last)).alias("block")) \
        .withColumn("begin", begin - F.col("start")).withColumn("words", end - begin)


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``."""
    documents, uses = mix(docs)
    documents = kept(documents, "mix-documents")
    per_block = uses.groupBy("number", "block").agg(F.count("*").alias("uses"))
    taken = touched(documents).hint("merge").join(per_block, ["number", "block"]) \
        .groupBy("number", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    full = documents.where("size > 0").join(taken, ["number", "start"], "left")
    rest = documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return full.unionByName(rest).select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass, every stretch of a document's words that it takes in one run of blocks.

    Columns of ``documents``; a document taken whole keeps its text as it is, and rows repeat for a
    second pass. Documents of which no block is drawn, those without words included, are not in the mix.
    """
    documents, uses = mix(docs)
    # Both sides grow with the corpus, and Spark cannot know the size of drawn blocks.
    used = touched(documents).hint("merge").join(uses.select("number", "block", "use"), ["number", "block"]) \
        .groupBy("key", "key2", "number", "start").agg(
            F.sort_array(F.collect_list(F.struct("use", "begin", "words"))).alias("spans"))
    # Equal rows have equal keys: number them, so that each copy meets its own spans.
    copies = Window.partitionBy("key", "key2")
    used = used.withColumn("copy", F.row_number().over(copies.orderBy("start")))
    texts = docs.select("doc_id", "text", "lang", "source", "n_chars", *row_keys("doc_id", "source", "text")) \
        .withColumn("copy", F.row_number().over(copies.orderBy("lang", "n_chars")))
    joined = texts.join(used, ["key", "key2", "copy"]).select("doc_id", "text", "lang", "source", "n_chars", "spans")
    word = re.compile(WORD)

    def rows(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            text = row["text"]
            at = [m.span() for m in word.finditer(text)]
            for _, spans in groupby(row["spans"], key=lambda s: s["use"]):
                runs: list[list[int]] = []
                for span in spans:
                    if runs and runs[-1][1] == span["begin"]:
                        runs[-1][1] += span["words"]
                    else:
                        runs.append([span["begin"], span["begin"] + span["words"]])
                for begin, end in runs:
                    whole = (begin, end) == (0, len(at))
                    piece = text if whole else text[at[begin][0]:at[end - 1][1]]
                    yield row["doc_id"], piece, row["lang"], row["source"], row["n_chars"] if whole else len(piece)

    schema = docs.select("doc_id", "text", "lang", "source", "n_chars").schema
    return map_rows(joined, schema, rows)
