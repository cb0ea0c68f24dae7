"""What several operators share: words, Arrow batches, tables kept in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from runhealth.streaming.scratch import shared_folder

# A word is a run of characters other than these six.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def words(text: str | None) -> list[bytes]:
    """Words as UTF-8; ``bytes.split`` cuts at exactly the six characters of SPACES."""
    return encoded(text).split()


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table below the shared folder and read it back: lineage ends there, and it survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_keys(*columns: str) -> list[Column]:
    """``key`` and ``key2``, 128 bits that stand for a row with these columns; equal rows have equal keys."""
    return [F.xxhash64(*columns).alias("key"), F.xxhash64(F.lit("key2"), *columns).alias("key2")]


def map_rows(df: DataFrame, schema: StructType | str, rows: Callable[[Iterator[dict]], Iterator[tuple]],
             flush: int = 2048, flush_bytes: int = 8 << 20) -> DataFrame:
    """Arrow map in which ``rows`` sees one partition's rows as a stream and yields tuples.

    Output goes back in batches of at most ``flush`` rows or about ``flush_bytes``, whichever is
    first, so memory does not follow the partition.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        names = arrow.names

        def incoming() -> Iterator[dict]:
            for batch in batches:
                columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                for at in range(0, batch.num_rows, 256):
                    part = {name: column.slice(at, 256).to_pylist() for name, column in columns.items()}
                    yield from (dict(zip(part, values)) for values in zip(*part.values()))

        def packed(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(column, type=arrow.field(i).type) for i, column in enumerate(zip(*held))], names=names)

        held, size = [], 0
        for row in rows(incoming()):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if len(held) >= flush or size >= flush_bytes:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return df.mapInArrow(mapped, schema)
