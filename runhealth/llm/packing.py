"""Packing: cut each document's tokens into power-of-two pieces, each a sequence of its own length bucket."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from runhealth.llm.common import map_rows

END_ID = struct.pack("<I", 0)
# A space between two characters that no library counts as white space always starts a new
# pre-token, so the text on each side of it encodes alone. A single line end between two such
# characters is a pre-token of its own.
CUT = re.compile(r"(?<=\S) (?=\S)")
LINE_END = 198
MAX_CACHED = 1_000_000
MAX_CACHED_CHARS = 64


class Encoder:
    """Ids as little-endian 32-bit bytes, with a bounded cache of words between spaces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _new(self, words: list[str]) -> list[bytes]:
        """Space-led words whose every line begins and ends with no white space, encoded as lines of one text."""
        ids = self._ids(" " + "\n ".join(words) + "\n")
        data, ends = ids.tobytes(), (4 * np.flatnonzero(ids == LINE_END)).tolist()
        out, begin, line = [], 0, 0
        for word in words:
            line += word.count("\n")
            out.append(data[begin:ends[line]])
            begin = ends[line] + 4
            line += 1
        return out

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        ids = list(map(self.cache.get, rest))
        if None in ids or not first or first[-1].isspace():
            missing = [w for w, i in zip(rest, ids) if i is None]
            if not first or first[-1].isspace() or any(not w or w[0].isspace() or w[-1].isspace() for w in missing):
                return self._cut(text)
            ids = self._filled(rest, ids, missing)
        return self._ids(first).tobytes() + b"".join(ids)

    def _cut(self, text: str) -> bytes:
        """For spaces beside white space: cut only where it is safe to."""
        first, *rest = CUT.split(text)
        ids = list(map(self.cache.get, rest))
        return self._ids(first).tobytes() + b"".join(self._filled(rest, ids, [w for w, i in zip(rest, ids) if i is None]))

    def _filled(self, words: list[str], ids: list[bytes | None], missing: list[str]) -> list[bytes]:
        known: dict[str, bytes] = dict.fromkeys(missing)
        plain = [w for w in known if "\n" not in w or all(x and not x[0].isspace() and not x[-1].isspace() for x in w.split("\n"))]
        if plain:
            known.update(zip(plain, self._new(plain)))
        for word in [w for w, i in known.items() if i is None]:
            known[word] = self._ids(" " + word).tobytes()
        if len(self.cache) + len(known) > MAX_CACHED:
            self.cache.clear()
        self.cache.update((w, i) for w, i in known.items() if len(w) <= MAX_CACHED_CHARS)
        return [known[w] if i is None else i for w, i in zip(words, ids)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(n: int, block: int) -> Iterator[tuple[int, int]]:
    """(start, length): as many whole blocks as fit, then the binary digits of the rest, largest first."""
    start = 0
    size = block
    while start < n:
        while size > n - start:
            size //= 2
        yield start, size
        start += size


PIECE = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
         "bucket int")


def pack(docs: DataFrame, tokenizer_path: str, block: int = 1024) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset, bucket): one row per piece.

    ``docs`` has doc_id and text; other columns are ignored. A document is its ids and then id 0;
    null or empty text gives one piece, id 0 alone. ``ids`` holds little-endian unsigned 32-bit
    ids. Each piece has a power-of-two length up to ``block`` (itself a power of two) and is one
    whole sequence: sequences need no padding and hold one document each, and ``bucket``, the
    length's exponent, gathers equal lengths (write with ``partitionBy("bucket")``). Repeated rows
    are packed again. ``sequence_id`` is the task's number and a running number in it. No shuffle;
    a task holds one document and the cache at a time.
    """
    if block & (block - 1):
        raise ValueError("block is a power of two")

    def rows(stream: Iterator[dict]) -> Iterator[tuple]:
        encode = encoder(tokenizer_path).encode
        sequence = TaskContext.get().partitionId() << 40
        for row in stream:
            ids = (encode(row["text"]) if row["text"] else b"") + END_ID
            n = len(ids) // 4
            for start, length in pieces(n, block):
                yield (row["doc_id"], start, length, ids[4 * start:4 * (start + length)], n, sequence, 0,
                       length.bit_length() - 1)
                sequence += 1

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), PIECE, rows)


def digests(packed: DataFrame) -> DataFrame:
    """Each piece with the CRC-32 of its ids in their place."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "bucket")
