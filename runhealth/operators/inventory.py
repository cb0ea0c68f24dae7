"""Listings and filters over clusters, jobs, runs, logs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runhealth.functions.guards import level_at_least as level_at_least_col
from runhealth.functions.text import or_default

# Kinds of log.
LOG_TYPES = ["audit", "cluster", "driver", "executor", "stderr", "stdout"]


def list_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.select(
        "cluster_id", "name", "state", "creator", "node_type", "runtime",
        F.coalesce("num_workers", F.lit(0)).alias("num_workers"))


def cluster_details(ids: DataFrame, clusters: DataFrame) -> DataFrame:
    """A row per requested ``cluster_id``; a miss is a row that says so."""
    found = clusters.withColumn("_hit", F.lit(True))
    miss = F.col("_hit").isNull()
    return (
        ids.join(found, "cluster_id", "left")
        .withColumn("status", F.when(miss, F.lit("error")).otherwise(F.lit("ok")))
        .withColumn("message", F.when(miss, F.concat(
            F.lit("Cluster "), or_default(F.col("cluster_id").cast("string"), "?"), F.lit(" not found"))))
        .drop("_hit")
    )


def list_jobs(jobs: DataFrame, name: str | None = None, limit: int | None = None) -> DataFrame:
    listed = jobs.select(
        "job_id", F.col("settings.name").alias("name"), "creator", "created_time",
        F.col("settings.schedule").alias("schedule"))
    if name is not None:
        listed = listed.where(F.col("name") == name)
    return listed if limit is None else listed.orderBy("job_id").limit(limit)


def list_runs(runs: DataFrame, job_id=None, active_only: bool = False, completed_only: bool = False,
              limit: int | None = None, offset: int = 0) -> DataFrame:
    """Runs with their states, newest first when a page is asked for."""
    if active_only and completed_only:
        raise ValueError("active_only and completed_only exclude each other")
    listed = runs.select(
        "run_id", "job_id", "run_name", F.col("life_cycle_state").alias("state"), "result_state",
        F.col("start_ts").alias("start_time"), F.col("end_ts").alias("end_time"))
    if job_id is not None:
        listed = listed.where(F.col("job_id") == job_id)
    if active_only:
        listed = listed.where(F.col("result_state").isNull())
    if completed_only:
        listed = listed.where(F.col("result_state").isNotNull())
    if limit is None and not offset:
        return listed
    paged = listed.orderBy(F.col("start_time").desc(), F.col("run_id").desc())
    if offset:
        paged = paged.offset(offset)
    return paged if limit is None else paged.limit(limit)


def lookback(df: DataFrame, ts: str, days: int, as_of=None) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``, by default the newest time in ``df``."""
    end = df.agg(F.max(ts)).scalar() if as_of is None else F.lit(as_of)
    return df.where(F.col(ts) >= end - F.expr(f"INTERVAL {int(days)} DAYS"))


def filter_logs(logs: DataFrame, cluster_id=None, run_id=None, log_type: str | None = "audit",
                days: int | None = 7, as_of=None, limit: int | None = None) -> DataFrame:
    """Logs that meet every filter given; oldest first when a limit is set.

    The look-back counts from the newest line of the whole table, not of the
    filtered part.
    """
    if log_type is not None and log_type not in LOG_TYPES:
        raise ValueError(f"log_type must be one of {LOG_TYPES}")
    kept = logs if days is None else lookback(logs, "ts", days, as_of)
    for column, value in (("cluster_id", cluster_id), ("run_id", run_id), ("log_type", log_type)):
        if value is not None:
            kept = kept.where(F.col(column) == value)
    return kept if limit is None else kept.orderBy("ts", "event_id").limit(limit)


def cluster_events(events: DataFrame, cluster_id=None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Events with inclusive time bounds."""
    kept = events if cluster_id is None else events.where(F.col("cluster_id") == cluster_id)
    if start is not None:
        kept = kept.where(F.col("ts") >= F.lit(start))
    if end is not None:
        kept = kept.where(F.col("ts") <= F.lit(end))
    return kept if limit is None else kept.orderBy("ts", "cluster_id", "type", "details").limit(limit)


def level_at_least(logs: DataFrame, threshold: str = "info") -> DataFrame:
    return logs.where(level_at_least_col(F.col("level"), threshold))


def running_only(df: DataFrame) -> DataFrame:
    """Mark rows of clusters that are not running; their numbers mean nothing."""
    running = F.coalesce(F.col("state") == "RUNNING", F.lit(False))
    return df.withColumn("status", F.when(running, F.lit("success")).otherwise(F.lit("error"))).withColumn(
        "message", F.when(~running, F.concat(
            F.lit("Cluster "), F.col("cluster_id").cast("string"), F.lit(" is not running: "),
            or_default(F.col("state"), "missing"))))
