"""Follow log files that grow and are rotated: a streaming source whose offset is (file identity, byte).

A file is known by its base name and a hash of its first line, on a local disk also by its inode, so it keeps its identity when
it grows and when rotation renames it. Each trigger reads the whole lines that came after the bytes read before, wherever
the file is by then. Files are read through ``pyarrow.fs``, so a path may name any store that has one there; the
executors must reach it too.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_log"
SCHEMA = "file string, file_id string, at long, value string"
CHUNK_BYTES = 64 << 20
BATCH_LINES = 4096
HEAD_BYTES = 4096
BACK_BYTES = 1 << 16
BUFFER_BYTES = 1 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _first_line(files: fs.FileSystem, path: str) -> bytes | None:
    """The first line, or as much of it as identifies the file; None while it is not complete."""
    with files.open_input_file(path) as source:
        head = source.read_at(HEAD_BYTES, 0)
    end = head.find(b"\n")
    return head[:end] if end >= 0 else head if len(head) == HEAD_BYTES else None


def file_identity(files: fs.FileSystem, path: str, base: str) -> str | None:
    line = _first_line(files, path)
    if line is None:
        return None
    inode = os.stat(path).st_ino if isinstance(files, fs.LocalFileSystem) else ""
    return f"{base}:{inode}:{hashlib.blake2b(line, digest_size=16).hexdigest()}"


def last_line_end(files: fs.FileSystem, path: str, size: int) -> int:
    """The byte after the last complete line."""
    with files.open_input_file(path) as source:
        end = size
        while end > 0:
            begin = max(0, end - BACK_BYTES)
            found = source.read_at(end - begin, begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return 0


def lines_between(files: fs.FileSystem, path: str, begin: int, end: int, first: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that start in [begin, end); ``first`` is where a line is known to start."""
    with files.open_input_file(path) as raw:
        source = io.BufferedReader(raw, BUFFER_BYTES)
        source.seek(begin - 1 if begin > first else begin)
        if begin > first:  # the line that holds the byte before belongs to the chunk before
            begin += len(source.readline()) - 1
        while begin < end and (line := source.readline()):
            yield begin, line.removesuffix(b"\n")
            begin += len(line)


@dataclass
class Chunk(InputPartition):
    path: str
    file_id: str
    begin: int
    end: int
    first: int

    def __post_init__(self) -> None:
        super().__init__(f"{self.file_id}:{self.begin}")


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.directory, self.name = options["path"], options.get("name", "agent.log")
        self.chunk_bytes = int(options.get("chunkbytes", CHUNK_BYTES))
        self.paths: dict[str, str] = {}

    def _present(self) -> dict[str, tuple[str, int]]:
        """Identity to path and the end of what can be read now."""
        files, root = _open(self.directory)
        found: dict[str, tuple[str, int]] = {}
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            # Rotation appends .1, .2 and so on; other names that start alike are logs of their own.
            if info.type != fs.FileType.File or not info.base_name.startswith(self.name) or not info.size:
                continue
            base = re.sub(r"(\.\d+)+$", "", info.base_name)
            try:
                identity = file_identity(files, info.path, base)
                if identity is None:
                    continue
                # A file that was rotated away is complete, its last line also without a line end.
                end = info.size if info.base_name != base else last_line_end(files, info.path, info.size)
            except FileNotFoundError:  # rotated since it was listed: seen under its new name, or next time
                continue
            if identity in found and found[identity][0] != info.path:
                raise ValueError(f"two log files start with the same line: {found[identity][0]} and {info.path}")
            found[identity] = (info.path, end)
        return found

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        present = self._present()
        self.paths = {identity: path for identity, (path, _) in present.items()}
        return {identity: end for identity, (_, end) in present.items()}

    def partitions(self, start: dict, end: dict) -> list[Chunk]:
        grown = {i: (start.get(i, 0), to) for i, to in end.items() if to > start.get(i, 0)}
        if any(i not in self.paths for i in grown):
            self.latestOffset()
        return [
            Chunk(self.paths.get(i, ""), i, begin, min(begin + self.chunk_bytes, to), first)
            for i, (first, to) in sorted(grown.items()) for begin in range(first, to, self.chunk_bytes)]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.directory)
        path = self._found_again(files, partition)
        held: list[tuple[int, bytes]] = []
        for place in lines_between(files, path, partition.begin, partition.end, partition.first):
            held.append(place)
            if len(held) >= BATCH_LINES:
                yield self._batch(path, partition.file_id, held)
                held = []
        if held:
            yield self._batch(path, partition.file_id, held)

    def _found_again(self, files: fs.FileSystem, chunk: Chunk) -> str:
        """Where the file is now: rotation may have renamed it since the trigger was planned."""
        base = chunk.file_id.split(":", 1)[0]
        try:
            if chunk.path and file_identity(files, chunk.path, base) == chunk.file_id:
                return chunk.path
        except FileNotFoundError:
            pass
        path = self._present().get(chunk.file_id, (None, 0))[0]
        if path is None:
            raise FileNotFoundError(f"bytes {chunk.begin} to {chunk.end} of {chunk.file_id} are gone: keep more backups or trigger more often")
        return path

    @staticmethod
    def _batch(path: str, file_id: str, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        at, lines = zip(*held)
        return pa.RecordBatch.from_arrays(
            [pa.array([path.rsplit("/", 1)[-1]] * len(at)), pa.array([file_id] * len(at)), pa.array(at, pa.int64()),
             pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())],
            names=["file", "file_id", "at", "value"])


class GrowingLog(DataSource):
    """Options: path, name (of the active file; backups add .1 and so on), chunkBytes (most bytes a task reads)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLogReader:
        return GrowingLogReader(dict(self.options))


def read_growing_logs(spark: SparkSession, directory: str, name: str = "agent.log", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Lines of every log whose name starts with ``name``, as they are written; ``file_id`` and ``at`` give their order.

    A line counts once its line end is there, or once its file was rotated away. A backup that is deleted before its bytes
    were read fails the trigger that needs them.
    """
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format(FORMAT).option("name", name).option("chunkBytes", chunk_bytes).load(directory)
