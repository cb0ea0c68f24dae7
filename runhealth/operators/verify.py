"""Did a fix work? As-of checks of fixes against later runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runhealth.functions.text import time_bucket
from runhealth.operators.ordered import nearest, running_number

# Default wait for the next run, most attempts at one issue.
TIMEOUT_SECONDS = 600
MAX_ATTEMPTS = 5
DAY = 86_400
FINISHED = ["SUCCESS", "FAILED"]


def outcome(next_status: Column, same_issue: Column) -> Column:
    """success, failed (the same issue again) or needs_retry (another issue, or no run in time)."""
    return (
        F.when(next_status == "SUCCESS", F.lit("success"))
        .when((next_status == "FAILED") & same_issue, F.lit("failed"))
        .otherwise(F.lit("needs_retry"))
    )


def verify_next_run(fixes: DataFrame, runs: DataFrame, timeout_seconds: int = TIMEOUT_SECONDS,
                    bucket_seconds: int = DAY) -> DataFrame:
    """Check each fix against the first finished run of its job in (fix, fix + timeout].

    ``fixes`` has ``fix_id job_id fix_ts fix_type issue_type``; ``runs`` has
    ``job_id run_id start_ts status duration_seconds issue_type``. Runs at the
    very time of the fix do not count; among equal times the lower run_id is first.

    Both sides go into one ordered stream, so there is no range join and no
    fix-by-run product.
    """
    run_rows = runs.where(F.col("status").isin(FINISHED)).select(
        "job_id", F.col("start_ts").alias("_ts"), F.lit(0).alias("_kind"), F.col("run_id").alias("_id"),
        F.struct("run_id", "status", F.col("start_ts").alias("ts"), "duration_seconds", "issue_type").alias("_run"),
        F.lit(None).cast(_fix_type(fixes)).alias("_fix"))
    fix_rows = fixes.select(
        "job_id", F.col("fix_ts").alias("_ts"), F.lit(1).alias("_kind"),
        F.lit(None).cast(runs.schema["run_id"].dataType).alias("_id"),
        F.lit(None).cast(run_rows.schema["_run"].dataType).alias("_run"),
        F.struct(*[c for c in fixes.columns if c != "job_id"]).alias("_fix"))
    # Kind orders runs before fixes at one time, so "after the fix" is strictly later.
    both = run_rows.unionByName(fix_rows)
    seen = nearest(both, ["job_id"], ["_ts", "_kind", "_id"], time_bucket(F.col("_ts"), bucket_seconds),
                   F.col("_run"), "_next", backward=False)
    fixed = seen.where(F.col("_kind") == 1).select("job_id", "_fix.*", "_next")
    deadline = F.col("fix_ts") + F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")
    in_time = F.col("_next.ts") <= deadline
    same = F.col("next_issue_type") == F.col("issue_type")
    return (
        fixed.withColumns({
            "next_run_id": F.when(in_time, F.col("_next.run_id")),
            "next_status": F.when(in_time, F.col("_next.status")),
            "execution_time_seconds": F.when(in_time, F.col("_next.duration_seconds")),
            "next_issue_type": F.when(in_time & (F.col("_next.status") == "FAILED"), F.col("_next.issue_type")),
        })
        .withColumn("outcome", outcome(F.col("next_status"), F.coalesce(same, F.lit(False))))
        .withColumn("issue_resolved", F.col("outcome") == "success")
        .withColumn("previous_issue_detected", F.coalesce(same, F.lit(False)))
        .withColumn("failure_reason", F.when(F.col("outcome") == "failed", F.lit("The same issue came back"))
                    .when(F.col("next_status") == "FAILED", F.lit("The next run failed for another reason"))
                    .when(F.col("outcome") == "needs_retry", F.lit("No run finished in time")))
        .drop("_next")
    )


def _fix_type(fixes: DataFrame):
    return fixes.select(F.struct(*[c for c in fixes.columns if c != "job_id"]).alias("f")).schema["f"].dataType


def previous_issue(runs: DataFrame, bucket_seconds: int = DAY) -> DataFrame:
    """Per failed run, the issue of the job's failed run before it."""
    failed = runs.where(F.col("status") == "FAILED").select("job_id", "run_id", "start_ts", "issue_type")
    seen = nearest(failed, ["job_id"], ["start_ts", "run_id"], time_bucket(F.col("start_ts"), bucket_seconds),
                   F.col("issue_type"), "previous_issue_type")
    return seen.withColumn("same_issue", F.coalesce(
        F.col("issue_type") == F.col("previous_issue_type"), F.lit(False)))


def attempt_number(fixes: DataFrame, max_attempts: int = MAX_ATTEMPTS, bucket_seconds: int = DAY) -> DataFrame:
    """Number the fixes tried on one job and issue."""
    numbered = running_number(fixes, ["job_id", "issue_type"], ["fix_ts", "fix_id"],
                              time_bucket(F.col("fix_ts"), bucket_seconds), "attempt")
    return numbered.withColumn("within_limit", F.col("attempt") <= max_attempts)


def fix_effectiveness(verified: DataFrame) -> DataFrame:
    """Success per fix type and attempt, over rows with ``fix_type attempt outcome``."""
    won = F.count_if(F.col("outcome") == "success")
    return verified.groupBy("fix_type", "attempt").agg(
        F.count(F.lit(1)).alias("verified"), won.alias("successful"),
        F.round(F.try_divide(won * 100.0, F.count(F.lit(1))), 4).alias("success_rate"))
