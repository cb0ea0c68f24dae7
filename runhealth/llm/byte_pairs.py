"""Byte-level BPE: pre-tokens leave their documents, every distinct one is encoded once where its hash puts it, and ids
come back by position; decoding joins ids with the table of token bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from runhealth.llm.blocks import Numbers, loosen, loosen_planes, ragged, squeeze, squeeze_planes
from runhealth.llm.common import encoded, kept, map_rows

# A space between two characters that no library counts as white space starts a new pre-token, whatever stands around.
CUT = re.compile(r"(?<=\S) (?=\S)")
BLOCK_BYTES = 12 << 20
# White space that texts seldom hold.
SEPARATORS = "\x0b\x0c\x85\u2028\u2029\u1680"
DECODE_TOKENS = 1 << 22
REQUEST, LAYOUT, REPLY = 0, 1, 2


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64, a space and the id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@cache
def tokenizer(path: str, pattern: str):
    """One per Python worker."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@cache
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def spaced(text: str) -> list[str]:
    """The text cut before safe spaces; each part but the first goes without its space."""
    # Printable texts have no white space but spaces, and line ends, which the first test takes out.
    if text.replace("\n", "").isprintable() and text[0] != " " != text[-1] and not any(x in text for x in ("  ", " \n", "\n ")):
        return text.split(" ")
    return CUT.split(text)


class Block:
    """Documents of one task, up to BLOCK_BYTES of text or one longer document, as numbered parts between spaces."""

    def __init__(self) -> None:
        self.doc_ids: list[int | None] = []
        self.n_parts: list[int] = []
        self.numbers = Numbers()
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        self.doc_ids.append(doc_id)
        parts = spaced(text) if text else []
        self.n_parts.append(len(parts))
        if parts:
            parts[0] = " " + parts[0]  # no other part starts with a space
            self.codes.append(np.fromiter(map(self.numbers.__getitem__, parts), "<u4", len(parts)))
            self.size += len(text)

    def _split(self, pattern: str) -> tuple[Numbers, np.ndarray, np.ndarray]:
        """Pre-tokens by number, those of all distinct parts in a row, and how many each part has."""
        find = splitter(pattern).findall
        texts = [part[1:] if part[0] == " " else " " + part for part in self.numbers]
        self.numbers.clear()  # no part is added after this
        # White space that no text holds is a pre-token of its own between texts that neither begin nor end with white space but
        # one space, so these are split as one.
        odd = {i for i, t in enumerate(texts) if t[-1].isspace() or t[1:2].isspace() or (t[0] != " " and t[0].isspace())}
        even = [t for i, t in enumerate(texts) if i not in odd] if odd else texts
        whole = "".join(even)
        mark = next((c for c in SEPARATORS if c not in whole), None)
        if mark is None:
            odd, even = set(range(len(texts))), []
        words = Numbers()
        found = find(mark.join([*even, ""])) if even else []
        codes = np.fromiter(map(words.__getitem__, found), "<u4", len(found))
        del found, whole
        ends = np.flatnonzero(codes == words[mark]) if even else np.zeros(0, np.int64)
        sizes = np.zeros(len(texts), np.int64)
        is_even = np.ones(len(texts), bool)
        is_even[list(odd)] = False
        sizes[is_even] = np.diff(ends, prepend=-1) - 1
        flat = [np.delete(codes, ends)]
        # The others follow, one by one.
        starts = np.zeros(len(texts), np.int64)
        starts[is_even] = np.cumsum(sizes[is_even]) - sizes[is_even]
        at = len(flat[0])
        for i in sorted(odd):
            mine = [words[word] for word in find(texts[i])]
            starts[i], sizes[i] = at, len(mine)
            flat.append(np.array(mine, "<u4"))
            at += len(mine)
        return words, np.concatenate(flat), np.stack([starts, sizes])

    def words(self, pattern: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct pre-tokens, commonest first; their numbers in the order of the texts; how many each document has."""
        words, flat, (starts, sizes) = self._split(pattern)
        parts = np.concatenate(self.codes) if self.codes else np.zeros(0, "<u4")
        codes = flat[ragged(starts[parts], sizes[parts])]
        counts = np.bincount(codes, minlength=len(words))
        order = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts)]
        rank = np.zeros(len(words), "<u4")
        rank[order] = np.arange(len(order))
        listed = list(words)
        ends = np.concatenate([[0], np.cumsum(sizes[parts])])[np.concatenate([[0], np.cumsum(self.n_parts, dtype=np.int64)])]
        return [encoded(listed[i]) for i in order], rank[codes], np.diff(ends)


def _packed(numbers: np.ndarray) -> bytes:
    return squeeze_planes(numbers.astype("<u4"))


def buckets_of(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)) % np.uint64(n)


SENT = "block string, bucket int, kind int, payload binary"


def _blocks(docs: DataFrame, pattern: str, buckets: int, layout: bool) -> DataFrame:
    """Requests: a block's distinct pre-tokens, a row per bucket. Layouts: a block's documents and word numbers.

    Both come from the same rows. A block is named by a 128-bit hash of its content, so a request and a layout
    that differ, because the rows changed between two reads, never meet; equal blocks have the same answers.
    """
    def sent(block: Block) -> Iterator[tuple]:
        words, codes, n_words = block.words(pattern)
        at = buckets_of(words, buckets)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        doc_ids = np.array([-1 if d is None else d for d in block.doc_ids], "<i8")
        no_id = np.array([d is None for d in block.doc_ids], "u1")
        content = [b"".join(words), lengths.tobytes(), codes.tobytes(), n_words.tobytes(), doc_ids.tobytes(), no_id.tobytes()]
        state = xxhash.xxh3_128()
        for part in content:
            state.update(len(part).to_bytes(8, "little"))
            state.update(part)
        name = state.hexdigest()
        if layout:
            yield name, -1, LAYOUT, b"".join([
                _packed(codes), _packed(at), _packed(n_words), squeeze(doc_ids.tobytes()), squeeze(no_id.tobytes())])
            return
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order])) + 1
        for mine in np.split(order, cuts) if len(order) else []:
            yield name, int(at[mine[0]]), REQUEST, _packed(lengths[mine]) + squeeze(b"".join([words[i] for i in mine.tolist()]))

    def rows(stream: Iterator[dict]) -> Iterator[tuple]:
        block = Block()
        for row in stream:
            block.add(row["doc_id"], row["text"])
            if block.size >= BLOCK_BYTES:
                yield from sent(block)
                block = Block()
        if block.doc_ids:
            yield from sent(block)

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), SENT, rows)


def _answers(requests: DataFrame, path: str, pattern: str, buckets: int) -> DataFrame:
    """Ids of each request's words in its order; a bucket's task encodes each of its distinct words once."""
    def rows(stream: Iterator[dict]) -> Iterator[tuple]:
        encode = tokenizer(path, pattern).encode_ordinary
        known: dict[bytes, list[int]] = {}
        bucket = None
        for row in stream:
            if row["bucket"] != bucket:
                known, bucket = {}, row["bucket"]
            lengths, at = loosen_planes(row["payload"])
            text, _ = loosen(row["payload"], at)
            ids, begin = [], 0
            for end in np.cumsum(lengths, dtype=np.int64).tolist():
                word = text[begin:end]
                begin = end
                found = known.get(word)
                if found is None:
                    found = known[word] = encode(word.decode())
                ids.append(found)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            yield row["block"], bucket, REPLY, _packed(sizes) + _packed(np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum())))

    return map_rows(requests.repartition(buckets, "bucket").sortWithinPartitions("bucket"), SENT, rows)


class Answered:
    """A block's layout with the ids of its words as they come in."""

    def __init__(self, layout: bytes):
        self.codes, at = loosen_planes(layout)
        self.bucket, at = loosen_planes(layout, 4, at)
        self.n_words, at = loosen_planes(layout, 4, at)
        doc_ids, at = loosen(layout, at)
        no_id, _ = loosen(layout, at)
        self.doc_ids = [None if none else d for d, none in zip(np.frombuffer(doc_ids, "<i8").tolist(), np.frombuffer(no_id, "u1").tolist())]
        self.order = np.argsort(self.bucket, kind="stable")
        self.first = np.searchsorted(self.bucket[self.order], np.arange(int(self.bucket.max(initial=0)) + 2))
        self.sizes = np.zeros(len(self.bucket), np.int64)
        self.starts = np.zeros(len(self.bucket), np.int64)
        self.answered = np.zeros(len(self.bucket), bool)
        self.ids: list[np.ndarray] = []
        self.held = 0
        self.copies = 1

    def add(self, bucket: int, payload: bytes) -> None:
        mine = self.order[self.first[bucket]:self.first[bucket + 1]]
        if self.answered[mine].all():  # asked by an equal block
            return
        sizes, at = loosen_planes(payload)
        ids, _ = loosen_planes(payload, 4, at)
        self.sizes[mine] = sizes
        self.starts[mine] = self.held + np.cumsum(sizes, dtype=np.int64) - sizes
        self.answered[mine] = True
        self.ids.append(ids)
        self.held += len(ids)

    def documents(self) -> Iterator[tuple]:
        if not self.answered.all():
            raise ValueError("words without ids: the documents changed while they were read, write them to a table first")
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, "<u4")
        at = 0
        for doc_id, n in zip(self.doc_ids, self.n_words.tolist()):
            words = self.codes[at:at + n]
            at += n
            found = ids[ragged(self.starts[words], self.sizes[words])]
            for _ in range(self.copies):
                yield doc_id, len(found), found


ENCODED = "doc_id long, n_tokens long, ids array<int>"


def encode(docs: DataFrame, path: str, pattern: str, buckets: int | None = None, stored: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): each document's tokens by the ranks in ``path``, as without special tokens.

    ``docs`` has doc_id and text; other columns are ignored. Each match of ``pattern`` is encoded separately. Null and empty texts have no
    ids; a document without doc_id keeps its null; repeated rows are repeated. Texts are whole, however long.
    An empty table gives no rows. ``docs`` is read twice: unless it is ``stored``, read from files as it is, it is written out first,
    since rows that come in another order the second time raise.

    A task cuts its documents into blocks of BLOCK_BYTES and numbers their distinct pre-tokens. These go by hash
    to ``buckets`` (the session's shuffle partitions), a row per block and bucket, so a common word
    weighs as much as a rare one: once per block. A bucket holds its distinct words in memory, encodes each once, and answers in the
    order asked. A block's layout, word numbers by position, meets its answers by the block's name. Texts are
    never shuffled.
    """
    return _gathered(docs, path, pattern, buckets, stored).mapInArrow(_assembled, ENCODED)


def _gathered(docs: DataFrame, path: str, pattern: str, buckets: int | None, stored: bool) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    docs = docs if stored else kept(docs, "byte-pair-documents")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    answers = _answers(_blocks(docs, pattern, buckets, False), path, pattern, buckets)
    both = answers.unionByName(_blocks(docs, pattern, buckets, True))
    return both.repartition("block").sortWithinPartitions("block", "bucket")


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Layouts and answers, block by block, to documents."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def packed(held: list[tuple]) -> pa.RecordBatch:
        doc_ids, sizes, ids = zip(*held)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i4")
        flat = np.concatenate(ids).astype("<i4")
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), type=arrow.field("ids").type)
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), lists], names=arrow.names)

    def documents() -> Iterator[tuple]:
        name, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                found, bucket, kind, payload = (batch.column(c)[i].as_py() for c in range(4))
                if found != name:
                    if block:
                        yield from block.documents()
                    name, block = found, None
                if kind == LAYOUT and block:
                    block.copies += 1
                elif kind == LAYOUT:
                    block = Answered(payload)
                elif block:
                    block.add(bucket, payload)
                else:
                    raise ValueError("ids without a block: the documents changed while they were read, write them to a table first")
        if block:
            yield from block.documents()

    held, size = [], 0
    for document in documents():
        held.append(document)
        size += document[1]
        if len(held) >= 2048 or size >= 1 << 20:
            yield packed(held)
            held, size = [], 0
    if held:
        yield packed(held)


@cache
def token_table(path: str) -> pa.Array:
    """Token bytes by id, null where no token has the id; one table per Python worker, of the vocabulary's size."""
    ranks = {i: token for token, i in read_ranks(path).items()}
    return pa.array([ranks.get(i) for i in range(max(ranks) + 1)], pa.large_binary())


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """The rows of ``tokens`` with ``decoded``, the joined bytes of their ``ids`` (array<int>), in place of ``ids``.

    Ids are exploded in a task's Arrow batches, joined with the table of token bytes, which is as large as the vocabulary and held
    by every worker, and gathered again by position, at most DECODE_TOKENS or one row's ids at a time. Null or
    empty ids give no bytes; a null or unknown id raises.
    """
    schema = _decoded_schema(tokens.schema)
    return tokens.mapInArrow(lambda batches: _decoded(batches, path, schema), schema)


def _decoded_schema(tokens: StructType) -> StructType:
    return StructType([f for f in tokens.fields if f.name != "ids"]).add("decoded", "binary")


def _decoded(batches: Iterator[pa.RecordBatch], path: str, schema: StructType) -> Iterator[pa.RecordBatch]:
    arrow, table = to_arrow_schema(schema), token_table(path)
    for batch in batches:
        lists = batch.column("ids")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        begin = 0
        while begin < batch.num_rows:
            done = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + DECODE_TOKENS, "right")))
            ids = lists.slice(begin, end - begin).flatten()
            if len(ids) and (ids.null_count or pc.min(ids).as_py() < 0 or pc.max(ids).as_py() >= len(table)):
                raise ValueError("an id stands for no token")
            found = table.take(ids)
            if found.null_count:
                raise ValueError("an id stands for no token")
            offsets = np.concatenate([[0], ends[begin:end] - done]).astype("<i8")
            texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), found), pa.scalar(b"", pa.large_binary()))
            rest = [batch.column(f.name).slice(begin, end - begin) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*rest, texts.cast(pa.binary())], schema=arrow)
            begin = end


DIGEST = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string"


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the SHA-256 of the ids as little-endian unsigned 32-bit numbers."""
    for batch in batches:
        lists = batch.column("ids")
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
        hashes = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(offsets, offsets[1:])]
        yield batch.append_column("ids_sha256", pa.array(hashes, pa.string()))


def round_trip(docs: DataFrame, path: str, pattern: str, stored: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: ``encode`` and ``decode``, in one Python worker a task."""
    schema = _decoded_schema(StructType.fromDDL(DIGEST))
    found = _gathered(docs, path, pattern, None, stored).mapInArrow(
        lambda batches: _decoded(_with_digest(_assembled(batches)), path, schema), schema)
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
