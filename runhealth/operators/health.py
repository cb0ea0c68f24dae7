"""Counts and rates: workspace, jobs, clusters, issues, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runhealth.functions.reporting import confidence_band
from runhealth.functions.text import in_order, or_default
from runhealth.operators.inventory import lookback
from runhealth.operators.ordered import first_n

# Activity classes, tried in this order, case-sensitive.
ACTIVITY_CLASSES = [(["CLUSTER"], "clusters"), (["JOB"], "jobs"), (["NOTEBOOK"], "notebooks"),
                    (["WAREHOUSE"], "warehouses")]
UNCLASSIFIED = "unclassified"


def workspace_status(clusters: DataFrame, objects: DataFrame) -> DataFrame:
    n_objects = objects.agg(F.count(F.lit(1))).scalar()
    return clusters.agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.count_if(F.col("state") == "RUNNING").alias("active_clusters"),
    ).withColumn("workspace_objects", n_objects)


def success_rate(total: Column, failed: Column) -> Column:
    """Per cent; null over no runs."""
    return F.round(F.try_divide((total - failed) * 100.0, total), 1)


def _job_counts() -> list[Column]:
    total, failed = F.count(F.lit(1)), F.count_if(F.col("status") == "FAILED")
    return [total.alias("total"), failed.alias("failed"), success_rate(total, failed).alias("success_rate")]


def job_health(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return runs.groupBy(*(by or [])).agg(*_job_counts())


def cluster_health(clusters: DataFrame, by: list[str] | None = None) -> DataFrame:
    return clusters.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("state") == s).alias(n)
          for s, n in (("RUNNING", "running"), ("TERMINATED", "terminated"), ("ERROR", "failed"))])


def health_rollup(runs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Run health by cluster state, cluster and job, and overall, in one aggregation.

    ``level`` is 0 for a job's row, 1 for a cluster's, 3 for a cluster state's and 7 overall.
    """
    placed = runs.select("cluster_id", "job_id", "status").join(
        clusters.select("cluster_id", F.col("state").alias("cluster_state")), "cluster_id", "left")
    return placed.rollup("cluster_state", "cluster_id", "job_id").agg(
        F.grouping_id().cast("int").alias("level"), *_job_counts())


def severity(confidence: Column) -> Column:
    return confidence_band(confidence)


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issues by type, severity and fix status over ``issue_type confidence outcome job_id``."""
    return (
        issues.withColumn("severity", severity(F.col("confidence")))
        .withColumn("fix_status", or_default(F.col("outcome"), "open"))
        .groupBy("issue_type", "severity", "fix_status")
        .agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("job_id").alias("jobs"))
    )


def confidence_histogram(diagnosed: DataFrame, confidence: str = "confidence") -> DataFrame:
    return diagnosed.groupBy(confidence_band(F.col(confidence)).alias("band")).agg(F.count(F.lit(1)).alias("reports"))


def entry_counts(logs: DataFrame, by: str = "run_id") -> DataFrame:
    return logs.groupBy(by).agg(F.count(F.lit(1)).alias("entries"))


def run_funnel(history: DataFrame) -> DataFrame:
    """Per job, how many steps of each kind its history holds."""
    steps = ["logs", "diagnosis", "fix", "verification"]
    return history.groupBy("job_id").agg(
        *[F.count_if(F.col("type") == s).alias(s) for s in steps])


# -- workspace activity ---------------------------------------------------------

def activity_class(action_type: Column) -> Column:
    return in_order(action_type, ACTIVITY_CLASSES, UNCLASSIFIED)


def activity_summary(activity: DataFrame, days: int = 7, as_of=None) -> DataFrame:
    """Counts per class; what fits no class is in the total only."""
    recent = lookback(activity, "ts", days, as_of).withColumn("_class", activity_class(F.col("action_type")))
    counts = [F.count_if(F.col("_class") == c).alias(f"{c[:-1]}_count") for _, c in ACTIVITY_CLASSES]
    return recent.agg(F.count(F.lit(1)).alias("count"), *counts).withColumn("days", F.lit(days))


def activity_examples(activity: DataFrame, k: int = 3, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The first ``k`` actions per class as bullet lines."""
    classed = activity.withColumn("class", activity_class(F.col("action_type"))).where(F.col("class") != UNCLASSIFIED)
    line = F.concat(F.lit("- "), or_default(F.col("action_type"), "Unknown"), F.lit(" by "),
                    or_default(F.col("user_name"), "Unknown"))
    top = first_n(classed, ["class"], [F.col(c).asc() for c in order], k).withColumn("_line", line)
    # At most k rows per class reach this collection.
    ordered = F.array_sort(F.collect_list(F.struct("position", "_line")))
    return top.groupBy("class").agg(ordered.alias("_rows")).select(
        "class", F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n").alias("examples"),
        F.size("_rows").alias("shown"))


def activity_digest(activity: DataFrame, days: int = 7, k: int = 3) -> DataFrame:
    """One text with the counts and the examples of each class."""
    counts = activity_summary(activity, days)
    head = F.concat(
        F.lit("Total activities: "), F.col("count").cast("string"), F.lit(f"\nTime period: last {days} days"),
        *[F.concat(F.lit(f"\n{c[:-1].capitalize()} activities: "), F.col(f"{c[:-1]}_count").cast("string"))
          for _, c in ACTIVITY_CLASSES])
    examples = activity_examples(lookback(activity, "ts", days), k)
    blocks = examples.agg(F.array_sort(F.collect_list(
        F.concat(F.lit("\n\nExample "), F.col("class"), F.lit(":\n"), F.col("examples")))).alias("b"))
    return counts.select(F.concat(head, F.array_join(blocks.scalar(), "")).alias("digest"))
