"""Confidence bands, guidance per issue type, and the report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runhealth.functions.diagnosis import DEPENDENCY, DISK, MEMORY, UNKNOWN, by_issue
from runhealth.functions.text import lit_array, percent_text, plain_words, rendered_map

# Band limits in per cent.
HIGH, MODERATE = 80, 50

# Which resource an issue type is about, and which of the library's tables to read on.
ROOT_CAUSE = {MEMORY: "memory", DISK: "local disk", DEPENDENCY: "installed packages", UNKNOWN: "not classified"}
OUTCOME = {MEMORY: "memory raised", DISK: "disk raised", DEPENDENCY: "packages installed", UNKNOWN: "cluster restarted"}
NOT_RESOLVED = "No later run of this job has succeeded."
RECOMMENDATIONS = {
    MEMORY: ["See data_skew for the job's keys", "See fix_effectiveness for increase_memory"],
    DISK: ["See resource_utilisation for the disk"],
    DEPENDENCY: ["See missing_packages for the names"],
    UNKNOWN: ["See state_transitions for the last step", "See previous_issue for a pattern"],
}
HEADLINE_OK = "Resolved"
HEADLINE_FAILED = "Open"


def confidence_band(confidence: Column) -> Column:
    pct = confidence * 100
    return (
        F.when(pct >= HIGH, F.lit("high")).when(pct >= MODERATE, F.lit("moderate"))
        .when(pct > 0, F.lit("low")).otherwise(F.lit("unavailable"))
    )


def confidence_text(confidence: Column) -> Column:
    band = confidence_band(confidence)
    return F.when(band == "unavailable", F.lit("Confidence level unavailable")).otherwise(
        F.concat(F.initcap(band), F.lit(" confidence ("), percent_text(confidence), F.lit(")")))


def fix_note(fix_type: Column, parameters: Column, packages: Column) -> Column:
    """What was changed: the fix type with its parameters, and packages if there are any."""
    named = F.when(F.size(packages) > 0, F.concat(F.lit("packages="), F.array_join(packages, "+")))
    given = F.concat_ws(",", rendered_map(parameters), named)
    return F.concat(fix_type, F.lit("("), given, F.lit(")"))


def guidance(issue_type: Column) -> tuple[Column, Column, Column]:
    """Resource, outcome and further reading for an issue type."""
    return (
        by_issue(issue_type, {k: F.lit(v) for k, v in ROOT_CAUSE.items()}),
        by_issue(issue_type, {k: F.lit(v) for k, v in OUTCOME.items()}),
        by_issue(issue_type, {k: lit_array(v) for k, v in RECOMMENDATIONS.items()}),
    )


def guidance_catalogue(spark: SparkSession) -> DataFrame:
    """One row per issue type: four rows, whatever the size of the data."""
    rows = [
        F.struct(F.lit(i).alias("issue_type"), F.lit(ROOT_CAUSE[i]).alias("root_cause"),
                 F.lit(OUTCOME[i]).alias("outcome"), lit_array(RECOMMENDATIONS[i]).alias("recommendations"))
        for i in ROOT_CAUSE
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def render_report(df: DataFrame, at: str = "start_ts") -> DataFrame:
    """Report columns and one markdown text per row.

    Reads ``job_id issue_type fix_type parameters packages confidence
    fix_successful`` and the time column ``at``.
    """
    cause, outcome, recommendations = guidance(F.col("issue_type"))
    note = fix_note(F.col("fix_type"), F.col("parameters"), F.col("packages"))
    fixed = F.coalesce(F.col("fix_successful"), F.lit(False))
    numbered = F.transform(F.col("recommendations"), lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r))
    sections = [
        ("# Run health report", None),
        ("## ", "headline"),
        ("Diagnosis confidence: ", "confidence_note"),
        ("## Situation\n\n", "situation"),
        ("## Root cause\n\n", "root_cause"),
        ("## Resolution\n\n", "resolution"),
    ]
    parts = [F.lit(h) if c is None else F.concat(F.lit(h), F.col(c)) for h, c in sections]
    return (
        df.withColumns({
            "headline": F.when(fixed, F.lit(HEADLINE_OK)).otherwise(F.lit(HEADLINE_FAILED)),
            "confidence_band": confidence_band(F.col("confidence")),
            "confidence_note": confidence_text(F.col("confidence")),
            "situation": F.concat(
                F.lit("job "), F.col("job_id").cast("string"), F.lit(", "), plain_words(F.col("issue_type")), F.lit(", "),
                F.date_format(F.col(at), "yyyy-MM-dd HH:mm:ss")),
            "root_cause": cause,
            "resolution": F.when(fixed, F.concat_ws(": ", outcome, note)).otherwise(F.lit(NOT_RESOLVED)),
            "recommendations": recommendations,
        })
        .withColumn("report", F.concat(
            F.concat_ws("\n\n", *parts), F.lit("\n\n## Recommendations\n\n"), F.array_join(numbered, "\n")))
        .drop("confidence_note")
    )
