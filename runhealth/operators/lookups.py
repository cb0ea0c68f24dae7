"""Joins between runs, logs, requests, clusters, remedies and approvals.

No side is broadcast by hint unless its row count is fixed by the code (the
catalogues). Elsewhere Spark broadcasts a side only below its size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runhealth.functions.diagnosis import ISSUE_TYPES, UNKNOWN, signature_tags
from runhealth.functions.remedy import (
    DEFAULT_INCREMENT, DEFAULT_WORKERS, FIX_TYPES, fix_catalogue, install_payload, target_workers)
from runhealth.functions.reporting import guidance_catalogue
from runhealth.functions.text import or_default


def latest_run(runs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each job's newest run, larger run_id on ties; partial aggregation, no window."""
    rest = [c for c in (columns or runs.columns) if c != "job_id"]
    newest = F.max_by(F.struct(*rest), F.struct("start_ts", "run_id"))
    return runs.groupBy("job_id").agg(newest.alias("_run")).select("job_id", "_run.*")


def runs_with_logs(runs: DataFrame, logs: DataFrame) -> DataFrame:
    return runs.join(logs, "run_id", "left")


def resolve_request(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """The run each request is about: the one it names, else its job's newest."""
    newest = latest_run(runs, ["run_id", "start_ts"]).select("job_id", F.col("run_id").alias("_latest"))
    return (
        requests.join(newest, "job_id", "left")
        .withColumn("resolved_run_id", F.coalesce("run_id", "_latest"))
        .withColumn("resolved_by", F.when(F.col("run_id").isNotNull(), F.lit("request"))
                    .when(F.col("_latest").isNotNull(), F.lit("latest")).otherwise(F.lit("none")))
        .drop("_latest")
    )


def fetch_status(requests: DataFrame, runs: DataFrame, logs: DataFrame) -> DataFrame:
    """A row per request with ``run_id``: the run's status and logs; a run that cannot be read has status ERROR."""
    known = runs.select("run_id", F.col("status").alias("_status"), "duration_seconds") \
        .join(logs.select("run_id", "stdout", "stderr"), "run_id", "left")
    miss = F.col("_status").isNull()
    return requests.join(known, "run_id", "left").select(
        *requests.columns,
        F.coalesce("_status", F.lit("ERROR")).alias("status"),
        F.coalesce("duration_seconds", F.lit(0)).alias("duration_seconds"),
        F.when(miss, F.lit("")).otherwise(F.col("stdout")).alias("stdout"),
        F.when(miss, F.concat(F.lit("run "), or_default(F.col("run_id").cast("string"), "?"), F.lit(" not found")))
        .otherwise(F.col("stderr")).alias("stderr"),
    )


def run_cluster(suggestions: DataFrame, runs: DataFrame, clusters: DataFrame) -> DataFrame:
    """The cluster each suggestion would change, or the reason there is none."""
    of_run = runs.select("run_id", "cluster_id", F.lit(True).alias("_run"))
    placed = suggestions.join(of_run, "run_id", "left")
    return with_cluster(placed, clusters, F.when(F.col("_run").isNull(), F.lit("Run not found"))).drop("_run")


def with_cluster(placed: DataFrame, clusters: DataFrame, earlier_problem: Column | None = None) -> DataFrame:
    """Join clusters by ``cluster_id`` and add ``problem``, the reason when that fails."""
    of_cluster = clusters.select("cluster_id", "num_workers", F.col("state").alias("cluster_state"),
                                 F.lit(True).alias("_cluster"))
    problem = (
        F.when(F.col("cluster_id").isNull(), F.lit("Run names no cluster"))
        .when(F.col("_cluster").isNull(), F.lit("Cluster not found"))
    )
    if earlier_problem is not None:
        problem = F.coalesce(earlier_problem, problem)
    return placed.join(of_cluster, "cluster_id", "left").withColumn("problem", problem).drop("_cluster")


def plan_columns(placed: DataFrame) -> DataFrame:
    """Size the change for rows that know their cluster (see ``run_cluster``)."""
    grows = F.col("fix_type") == "increase_memory"
    installs = F.col("fix_type") == "install_dependencies"
    increment = F.try_element_at("parameters", F.lit("memory_increment"))
    where = F.col("cluster_id").cast("string")
    unsupported = ~F.coalesce(F.col("fix_type").isin(list(FIX_TYPES.values())), F.lit(False))
    problem = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(installs & (F.size("packages") <= 0), F.lit("No packages to install"))
        .when(unsupported, F.concat(F.lit("Unsupported fix type: "), or_default(F.col("fix_type"), "none")))
    )
    done = (
        F.when(grows, F.concat(F.lit("Resize cluster "), where, F.lit(" by "), F.coalesce(increment, F.lit(DEFAULT_INCREMENT))))
        .when(F.col("fix_type") == "increase_disk_space", F.concat(F.lit("More disk for cluster "), where))
        .when(installs, F.concat(F.lit("Install on cluster "), where, F.lit(": "), F.array_join("packages", ", ")))
        .otherwise(F.concat(F.lit("Restart cluster "), where))
    )
    ok = F.col("problem").isNull()
    return (
        placed.withColumn("problem", problem)
        .withColumns({
            "plan_status": F.when(ok, F.lit("success")).otherwise(F.lit("error")),
            "message": F.when(ok, done).otherwise(F.col("problem")),
            "target_workers": F.when(ok & grows, target_workers(F.col("num_workers"), increment)),
            "payload": F.when(ok & installs, install_payload(F.col("packages"))),
        })
        .withColumn("is_noop", F.coalesce(
            F.col("target_workers") == F.coalesce("num_workers", F.lit(DEFAULT_WORKERS)), F.lit(False)))
        .drop("problem")
    )


def plan_fix(suggestions: DataFrame, runs: DataFrame, clusters: DataFrame) -> DataFrame:
    """What applying each suggestion would ask of its run's cluster.

    ``is_noop`` marks a resize that leaves the worker count as it is: one worker
    plus half is still one after the fraction is cut.
    """
    return plan_columns(run_cluster(suggestions, runs, clusters))


def attach_fix(diagnosed: DataFrame) -> DataFrame:
    """Catalogue entry per issue type; an issue without one gets the restart entry."""
    catalogue = fix_catalogue(diagnosed.sparkSession)
    return _with_default(diagnosed, catalogue)


def attach_guidance(diagnosed: DataFrame) -> DataFrame:
    return _with_default(diagnosed, guidance_catalogue(diagnosed.sparkSession))


def _with_default(diagnosed: DataFrame, catalogue: DataFrame) -> DataFrame:
    entry = F.when(F.col("issue_type").isin(ISSUE_TYPES), F.col("issue_type")).otherwise(F.lit(UNKNOWN))
    return (
        diagnosed.withColumn("_entry", entry)
        .join(F.broadcast(catalogue.withColumnRenamed("issue_type", "_entry")), "_entry", "left")
        .drop("_entry")
    )


def tag_signatures(logs: DataFrame, text: str = "message", patterns: dict[str, str] | None = None) -> DataFrame:
    """All matching pattern names per line. Own patterns come as a dict and become
    one expression, so there is no line-by-pattern join."""
    return logs.withColumn("tags", signature_tags(F.col(text), patterns))


def approved_fixes(suggestions: DataFrame, approvals: DataFrame) -> DataFrame:
    approved = approvals.where(F.col("decision") == "approve").select("fix_id")
    return suggestions.join(approved, "fix_id", "left_semi")


def orphan_approvals(approvals: DataFrame, suggestions: DataFrame) -> DataFrame:
    return approvals.join(suggestions.select("fix_id"), "fix_id", "left_anti")
