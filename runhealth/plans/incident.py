"""From runs to answers: what happened, why, what to change, and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runhealth.functions.diagnosis import diagnose_run, reasoning_steps, with_fix_step
from runhealth.functions.remedy import with_suggestion
from runhealth.functions.reporting import render_report
from runhealth.operators.lookups import latest_run, plan_columns, resolve_request, with_cluster

RUN_COLUMNS = ["job_id", "run_id", "cluster_id", "status", "start_ts"]


def failed_diagnoses(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Every failed run with its diagnosis and remedy."""
    failed = runs.where(F.col("status") == "FAILED").select(*RUN_COLUMNS)
    return with_suggestion(diagnose_run(failed.join(logs, "run_id", "left")))


def fixes_of(suggestions: DataFrame) -> DataFrame:
    """Suggestions as fixes applied at the time of their run."""
    return suggestions.select("fix_id", "job_id", F.col("start_ts").alias("fix_ts"), "fix_type", "issue_type",
                              "confidence")


def runs_with_issues(runs: DataFrame, diagnosed: DataFrame) -> DataFrame:
    return runs.join(diagnosed.select("run_id", "issue_type"), "run_id", "left")


def incident_response(runs: DataFrame, logs: DataFrame, clusters: DataFrame,
                      requests: DataFrame | None = None) -> DataFrame:
    """One row per job (or request, found or not): its run, the diagnosis, a sized remedy and a report.

    Runs are narrowed to one per job before any log text is read in. Runs that
    did not fail have no remedy, and a request whose run is unknown has status ERROR. Nothing is
    applied, so a remedy that can be applied and changes something waits for approval.
    """
    if requests is None:
        newest = latest_run(runs, RUN_COLUMNS)
    else:
        asked = resolve_request(requests, runs).select("job_id", F.col("resolved_run_id").alias("run_id"))
        newest = asked.join(runs.select(*[c for c in RUN_COLUMNS if c != "job_id"]), "run_id", "left") \
            .withColumn("status", F.coalesce("status", F.lit("ERROR")))
    failed = F.col("status") == "FAILED"
    suggested = with_suggestion(diagnose_run(newest.join(logs, "run_id", "left")))
    planned = plan_columns(with_cluster(suggested, clusters))
    reported = render_report(planned.withColumn("fix_successful", F.lit(False)))
    steps = with_fix_step(reasoning_steps(F.col("issue_type"), F.col("confidence"), F.col("evidence")),
                          F.col("fix_type"), F.col("description"))
    out = reported.withColumn("reasoning", steps)
    fix_only = ["issue_type", "confidence", "fix_id", "fix_type", "packages", "fix_confidence", "plan_status",
                "message", "target_workers", "payload", "is_noop", "reasoning", "report"]
    return out.select(
        "job_id", "run_id", "status", (failed & F.col("issue_detected")).alias("issue_detected"),
        *[F.when(failed, F.col(c)).alias(c) for c in fix_only], (failed & (F.col("plan_status") == "success") & ~F.col("is_noop")).alias("pending_approval"))
