"""Where streams keep their checkpoints and a query its intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

CHECKPOINT_CONF = "spark.checkpoint.dir"
RUN_SECONDS = 3600
STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local session gets a folder of its own below its warehouse;
    any other master raises, since its executors would not see each other's files.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written out once and read back, for a plan that would make them several times."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def keyed_state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, as custom state needs."""
    before = spark.conf.get(STATE_STORE_CONF, None)
    spark.conf.set(STATE_STORE_CONF, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE_CONF)
        else:
            spark.conf.set(STATE_STORE_CONF, before)


def finished(query: StreamingQuery, seconds: int = RUN_SECONDS, keep_all: bool = False) -> None:
    """Wait for a stream over what is there; ``keep_all`` raises if the watermark dropped rows."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream did not finish in {seconds} s")
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    if keep_all and dropped:
        raise ValueError(f"the watermark dropped {dropped} rows")


def run_available(stream: DataFrame, spark: SparkSession, purpose: str, seconds: int = RUN_SECONDS, keep_all: bool = False) -> DataFrame:
    """Run a stream over what is there now into a parquet table and read that back."""
    home = shared_folder(spark, purpose)
    with keyed_state_store(spark):
        finished(stream.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out")
                 .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(), seconds, keep_all)
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def landed(df: DataFrame, place: Column, n: int, purpose: str) -> str:
    """Write the rows with ``place`` 0, 1, ... n - 1 as files one after the other, for a stream that takes one a trigger."""
    path = shared_folder(df.sparkSession, purpose)
    for i in range(n):
        df.where(place == i).repartition(1).write.mode("append").parquet(path)
    return path


def one_a_trigger(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(path)
