from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from runhealth.llm import packing
from runhealth.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path())
    found.encode_special_tokens = True
    return found


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab I'll\t\n   \x1c\x85é1.!<|endoftext|>"), max_size=60))
def test_cached_words_encode_like_whole_texts(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path()) if not hasattr(packing, "_whole") else packing._whole
    packing._whole = whole
    whole.encode_special_tokens = True
    ids = whole.encode(text, add_special_tokens=False).ids
    assert packing.encoder(tokenizer_path()).encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_cache_overflow_keeps_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MAX_CACHED", 3)
    small = packing.Encoder(tokenizer_path())
    for text in ("a b c d e f g", "a b c d e f g h i", "a b", "zz yy xx a b c"):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert small.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_pieces_are_binary_digits(n):
    found = list(packing.pieces(n, 1024))
    assert sum(length for _, length in found) == n
    assert [start for start, _ in found] == [sum(length for _, length in found[:i]) for i in range(len(found))]
    assert all(length & (length - 1) == 0 for _, length in found)
    assert len(found) == n // 1024 + bin(n % 1024).count("1")


def test_every_id_is_in_one_piece(edge_docs, edge_rows, tokenizer):
    got = packing.pack(edge_docs, tokenizer_path()).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert all(r["offset"] == 0 and 1 << r["bucket"] == r["length"] == len(r["ids"]) // 4 for r in got)
    want: Counter = Counter()
    for doc_id, text, *_ in edge_rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for start, length in packing.pieces(len(ids), 1024):
            want[doc_id, start, struct.pack(f"<{length}I", *ids[start:start + length]), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"]) for r in got) == want


def test_digest_is_the_crc_of_the_ids(edge_docs):
    packed = packing.pack(edge_docs, tokenizer_path())
    ids = defaultdict(list)
    for r in packed.collect():
        ids[r["doc_id"], r["start"], r["length"], r["doc_tokens"]].append(zlib.crc32(bytes(r["ids"])))
    for r in packing.digests(packed).collect():
        assert r["ids_crc32"] in ids[r["doc_id"], r["start"], r["length"], r["doc_tokens"]]


def test_empty_table(no_docs):
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_block_must_be_a_power_of_two(no_docs):
    with pytest.raises(ValueError):
        packing.pack(no_docs, tokenizer_path(), 1000)
