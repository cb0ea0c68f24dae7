"""Write a stream's batches exactly once: each replaces a partition of its own, and a ledger says which are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StringType, StructType

_LEDGER = StructType().add("stream_id", StringType()).add("batch_id", LongType())


def _in_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_LEDGER).parquet(f"{path}/ledger")


def write_batch(batch: DataFrame, stream_id: str, batch_id: int, path: str) -> None:
    """Rows first, then the ledger entry. A batch that is in the ledger is not written again; one that broke off
    before its entry is replaced as a whole."""
    spark = batch.sparkSession
    spark.createDataFrame([], _LEDGER).write.mode("ignore").parquet(f"{path}/ledger")
    if _in_ledger(spark, path).where(f"stream_id = '{stream_id}' AND batch_id = {int(batch_id)}").isEmpty():
        batch.write.mode("overwrite").parquet(f"{path}/rows/stream_id={stream_id}/batch_id={int(batch_id)}")
        spark.createDataFrame([(stream_id, int(batch_id))], _LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")


def batches_once(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer, not yet started, whose batches land below ``path`` once each, also when a stop makes Spark replay one.

    Batches are known by the stream's id, which its checkpoint keeps, so a new checkpoint never takes its numbers for
    those of an older one.
    """
    def landed(batch: DataFrame, batch_id: int) -> None:
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write_batch(batch, stream_id, batch_id, path)

    return stream.writeStream.foreachBatch(landed).option("checkpointLocation", checkpoint)


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of whole batches; a batch being written or broken off does not show."""
    whole = StructType([*schema.fields, *_LEDGER.fields])
    rows = spark.read.schema(whole).parquet(f"{path}/rows")
    return rows.join(_in_ledger(spark, path).distinct(), ["stream_id", "batch_id"], "left_semi").drop("stream_id", "batch_id")
