"""Typed readers for exported JSON and for log files.

Bad JSON rows are kept: their text is in ``_corrupt_record``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runhealth.sources import schemas


def _json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def flatten_runs(raw: DataFrame) -> DataFrame:
    """Run exports with their nested logs as flat columns and real timestamps."""
    return raw.select(
        "run_id", "job_id", "run_name", "cluster_id", schemas.known_status(F.col("status")).alias("status"),
        F.timestamp_millis("start_time").alias("start_ts"), F.timestamp_millis("end_time").alias("end_ts"),
        F.coalesce("duration_seconds", F.expr("(end_time - start_time) div 1000")).alias("duration_seconds"),
        F.col("logs.stdout").alias("stdout"), F.col("logs.stderr").alias("stderr"),
        F.col("timestamp").cast("timestamp").alias("exported_ts"), "_corrupt_record")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return flatten_runs(_json(spark, path, schemas.RUN_EXPORT))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.JOB_EXPORT).select(
        "job_id", F.col("creator_user_name").alias("creator"),
        F.timestamp_millis("created_time").alias("created_time"), "settings", "_corrupt_record")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.CLUSTER_EXPORT).select(
        "cluster_id", F.col("cluster_name").alias("name"), "state", F.col("creator_user_name").alias("creator"),
        F.col("node_type_id").alias("node_type"), F.col("spark_version").alias("runtime"), "num_workers",
        "spark_conf", "_corrupt_record")


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.ACTIVITY_EXPORT).select(
        F.try_to_timestamp("timestamp").alias("ts"), "action_type", "user_name", "_corrupt_record")


def read_cluster_events(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.CLUSTER_EVENT_EXPORT).select(
        "cluster_id", F.timestamp_millis("timestamp").alias("ts"), "type", "details", "_corrupt_record")


def read_api_calls(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.API_CALL_EXPORT).select(
        F.col("timestamp").cast("timestamp").alias("ts"), "operation", "success", "parameters", "result_size",
        "duration_seconds", "error", "_corrupt_record")


def read_log_entries(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.LOG_ENTRY_EXPORT).select(
        F.try_to_timestamp("timestamp").alias("ts"), "log_type", "cluster_id", "user", "level", "source",
        "message", "_corrupt_record")
