"""The fix store as a stream's state: the last version of each fix, without its earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

def store_fixes(fixes: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer, not yet started, that keeps the version of each ``fix_id`` with the largest ``stored_ts``; of equal times
    the one whose other fields as JSON are larger. Versions may come in any order; a null ``stored_ts`` is before all others."""
    rest = [c for c in fixes.columns if c not in ("fix_id", "stored_ts")]
    at = F.coalesce(F.unix_micros(F.col("stored_ts").cast("timestamp")), F.lit(-(1 << 62)))
    rows = fixes.select("fix_id", at.cast("bigint").alias("stored_at"), F.to_json(F.struct(*rest)).alias("body"))
    # One value per fix in the aggregation's state: the largest (stored_at, body); a version that comes late loses to it.
    kept = rows.groupBy("fix_id").agg(F.max(F.struct("stored_at", "body")).alias("fix"))
    return kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)


def stored_fixes(spark: SparkSession, checkpoint: str, schema: StructType) -> DataFrame:
    """The fixes in the state after the last batch, with the columns of ``schema``; a row per fix, whatever was written before."""
    state = spark.read.format("statestore").option("path", checkpoint).load()
    state = state.select("key", F.col("value").getField(state.schema["value"].dataType.fields[0].name).alias("value"))
    rest = StructType([f for f in schema.fields if f.name not in ("fix_id", "stored_ts")])
    stored = F.when(F.col("value.stored_at") > -(1 << 62), F.timestamp_micros("value.stored_at")).cast(schema["stored_ts"].dataType)
    rows = state.select(F.col("key.fix_id").alias("fix_id"), stored.alias("stored_ts"), F.from_json("value.body", rest).alias("_rest"))
    return rows.select(*[F.col(f.name) if f.name in ("fix_id", "stored_ts") else F.col(f"_rest.{f.name}") for f in schema.fields])
