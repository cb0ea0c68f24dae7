from __future__ import annotations

import hashlib
import struct
import unicodedata
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from runhealth.llm import blocks, byte_pairs as bp

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
CHARS = st.sampled_from(list("ab'st  \n\t\r.,!1٣é\xa0\x1c\x1f\x85 　\U0001f600\x00中"))


def plain(text):
    return bp.tokenizer(PATH, PATTERN).encode_ordinary(text or "")


def brute(rows):
    out = Counter()
    for doc_id, text, *_ in rows:
        ids = plain(text)
        out[doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest()] += 1
    return out


def found(frame):
    return Counter(tuple(r) for r in bp.round_trip(frame, PATH, PATTERN).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(CHARS, max_size=12).map("".join), max_size=4))
def test_words_of_a_block_are_the_pattern_matches(texts):
    block = bp.Block()
    for text in texts:
        block.add(1, text)
    words, codes, n_words = block.words(PATTERN)
    got = [words[i].decode() for i in codes]
    assert got == [w for t in texts for w in bp.splitter(PATTERN).findall(t)]
    assert n_words.tolist() == [len(bp.splitter(PATTERN).findall(t)) for t in texts]
    assert [i for w in got for i in plain(w)] == [i for t in texts for i in plain(t)]


@given(st.lists(st.integers(0, 2 ** 32 - 1), max_size=50))
def test_numbers_come_back(numbers):
    for width in (4, 8):
        got, _ = blocks.loosen_planes(blocks.squeeze_planes(bp.np.array(numbers, f"<u{width}")), width)
        assert got.tolist() == numbers


@pytest.mark.parametrize("size,most", [(300, 7), (32 << 20, 1 << 22)])
def test_equals_the_library(spark, monkeypatch, edge_docs, edge_rows, size, most):
    monkeypatch.setattr(bp, "BLOCK_BYTES", size)
    monkeypatch.setattr(bp, "DECODE_TOKENS", most)
    assert found(edge_docs) == brute(edge_rows)


def test_long_words_and_texts(spark):
    rows = [(1, "a" * 60_000), (2, "\n" * 30_000 + "x"), (3, "é!" * 30_000), (4, "the cat " * 100_000), (None, None), (None, ""), (4, " "), (4, " ")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_each_distinct_word_is_asked_once_a_block(spark, no_docs):
    rows = spark.createDataFrame([(i, "the the cat the") for i in range(50)], "doc_id long, text string").coalesce(1)
    asked = bp._blocks(rows, PATTERN, 8, False).collect()
    words = []
    for r in asked:
        lengths, at = blocks.loosen_planes(r["payload"])
        words.append(len(lengths))
    assert sum(words) == 3 and len({r["block"] for r in asked}) == 1  # "the", " the", " cat"
    assert bp.encode(no_docs, PATH, PATTERN).count() == 0


def test_decode_joins_any_ids(spark):
    ranks = {i: t for t, i in bp.read_ranks(PATH).items()}
    rows = [(1, [1, 1, 50255, 0], "a"), (2, [], "b"), (3, None, "c"), (4, list(range(50_000)), None), (1, [7], "a"), (5, None, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, ids array<int>, token string").repartition(2)
    got = Counter((r["doc_id"], r["token"], bytes(r["decoded"])) for r in bp.decode(frame, PATH).collect())
    assert got == Counter((d, t, b"".join(ranks[i] for i in ids or [])) for d, ids, t in rows)
    for bad in ([50256], [-1], [None]):
        with pytest.raises(Exception, match="no token"):
            bp.decode(spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>"), PATH).collect()


def test_every_code_point_splits_as_in_the_library():
    block, texts = bp.Block(), []
    # Every character that has a name, and one of 64 others.
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) not in ("Cn", "Co") or c % 64 == 0)]
    for i in range(0, len(points), 5000):
        texts.append("".join(f"x{chr(c)}y {chr(c)}1 {chr(c)}{chr(c)}! \n{chr(c)}" for c in points[i:i + 5000]))
        block.add(i, texts[-1])
    words, codes, n_words = block.words(PATTERN)
    ids = [plain(w.decode()) for w in words]
    ends = bp.np.cumsum(n_words)
    for text, begin, end in zip(texts, [0, *ends[:-1]], ends):
        assert [i for c in codes[begin:end] for i in ids[c]] == plain(text)


def test_equal_blocks_are_told_apart_by_nothing_and_kept_each(spark, monkeypatch):
    monkeypatch.setattr(bp, "BLOCK_BYTES", 10)
    rows = [(1, "the same text"), (1, "the same text"), (2, "another text")] * 3
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_changed_documents_raise(spark, monkeypatch):
    reads, real = [], bp._blocks

    def moving(docs, *rest):
        reads.append(1)
        return real(docs.withColumn("text", F.concat("text", F.lit(f" {len(reads)}"))), *rest)
    monkeypatch.setattr(bp, "_blocks", moving)
    frame = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    with pytest.raises(Exception, match="changed while they were read"):
        bp.encode(frame, PATH, PATTERN).count()
