"""Choose a remedy for a diagnosis and size it for a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runhealth.functions.diagnosis import DEPENDENCY, DISK, MEMORY, UNKNOWN, by_issue, missing_packages
from runhealth.functions.text import lit_array, percent_factor

# Fix types, confidences, parameters, permissions and minutes.
GC_PRESSURE = "GC overhead limit exceeded"
FIX_TYPES = {
    MEMORY: "increase_memory",
    DISK: "increase_disk_space",
    DEPENDENCY: "install_dependencies",
    UNKNOWN: "restart_cluster",
}
BASE_CONFIDENCE = {MEMORY: 0.8, DISK: 0.85, DEPENDENCY: 0.6, UNKNOWN: 0.5}
GC_CONFIDENCE = 0.9
NAMED_PACKAGES_CONFIDENCE = 0.9
PERMISSIONS = {
    MEMORY: ["cluster_edit", "pool_edit"],
    DISK: ["cluster_edit"],
    DEPENDENCY: ["cluster_edit", "libraries_install"],
    UNKNOWN: ["cluster_restart"],
}
MINUTES = {MEMORY: "5-10 minutes", DISK: "5-10 minutes", DEPENDENCY: "10-15 minutes", UNKNOWN: "5-7 minutes"}
DEFAULT_WORKERS = 1
DEFAULT_INCREMENT = "50%"
DISK_INCREMENT = "100%"

# What a remedy changes and touches, in the library's own short form: target / side effect.
IMPACT = {
    MEMORY: "workers + / cost +",
    DISK: "disk + / cost +",
    DEPENDENCY: "libraries + / start-up time +",
    UNKNOWN: "all jobs on the cluster - / start-up once",
}


def suggest_fix(issue_type: Column, stderr: Column) -> Column:
    """The remedy for an issue as one struct; unplaced issues get a restart."""
    gc = F.coalesce(stderr.contains(GC_PRESSURE), F.lit(False))
    packages = missing_packages(stderr)
    named = F.size(packages) > 0
    increment = F.when(gc, F.lit("100%")).otherwise(F.lit(DEFAULT_INCREMENT))
    parameters = by_issue(issue_type, {
        MEMORY: F.create_map(F.lit("memory_increment"), increment, F.lit("driver_memory"), F.lit("True"),
                             F.lit("executor_memory"), F.lit("True")),
        DISK: F.create_map(F.lit("disk_increment"), F.lit(DISK_INCREMENT), F.lit("local_disk"), F.lit("True")),
        DEPENDENCY: F.create_map(
            F.lit("install_method"), F.when(named, F.lit("cluster_libs")).otherwise(F.lit("init_script"))),
        UNKNOWN: F.create_map(F.lit("terminate_running_jobs"), F.lit("False")),
    })
    return F.struct(
        by_issue(issue_type, {k: F.lit(v) for k, v in FIX_TYPES.items()}).alias("fix_type"),
        parameters.alias("parameters"),
        F.when(issue_type == DEPENDENCY, packages).otherwise(lit_array([])).alias("packages"),
        by_issue(issue_type, {
            MEMORY: F.when(gc, F.lit(GC_CONFIDENCE)).otherwise(F.lit(BASE_CONFIDENCE[MEMORY])),
            DISK: F.lit(BASE_CONFIDENCE[DISK]),
            DEPENDENCY: F.when(named, F.lit(NAMED_PACKAGES_CONFIDENCE)).otherwise(F.lit(BASE_CONFIDENCE[DEPENDENCY])),
            UNKNOWN: F.lit(BASE_CONFIDENCE[UNKNOWN]),
        }).alias("fix_confidence"),
        by_issue(issue_type, {
            MEMORY: F.concat(F.lit("memory x "), percent_factor(increment).cast("string")),
            DISK: F.concat(F.lit("disk x "), percent_factor(F.lit(DISK_INCREMENT)).cast("string")),
            DEPENDENCY: F.when(named, F.concat(F.lit("packages: "), F.array_join(packages, ", ")))
            .otherwise(F.lit("packages: not named in the log")),
            UNKNOWN: F.lit("restart"),
        }).alias("description"),
        by_issue(issue_type, {k: lit_array(v) for k, v in PERMISSIONS.items()}).alias("required_permissions"),
        by_issue(issue_type, {k: F.lit(v) for k, v in IMPACT.items()}).alias("expected_impact"),
        by_issue(issue_type, {k: F.lit(v) for k, v in MINUTES.items()}).alias("estimated_time"),
    )


def fix_id(run_id: Column, fix_type: Column) -> Column:
    """Same run and fix type, same id: safe under task retries."""
    return F.sha2(F.concat_ws("|", run_id.cast("string"), fix_type), 256)


def with_suggestion(diagnosed: DataFrame) -> DataFrame:
    """Add the remedy columns to diagnosed runs (``run_id issue_type stderr confidence``)."""
    return (
        diagnosed.withColumn("_fix", suggest_fix(F.col("issue_type"), F.col("stderr")))
        .select("*", "_fix.*", F.col("confidence").alias("original_confidence"))
        .withColumn("fix_id", fix_id(F.col("run_id"), F.col("fix_type")))
        .drop("_fix")
    )


def infer_fix_type(fix_type: Column, parameters: Column, packages: Column) -> Column:
    """The fix type, or the one its parameters and packages imply."""
    return F.coalesce(
        fix_type,
        F.when(F.map_contains_key(parameters, "memory_increment"), F.lit("increase_memory"))
        .when(F.map_contains_key(parameters, "disk_increment"), F.lit("increase_disk_space"))
        .when(F.map_contains_key(parameters, "install_method") | (F.size(packages) > 0), F.lit("install_dependencies")),
    )


def target_workers(workers: Column, increment: Column) -> Column:
    """Workers after the increment, fractions cut off."""
    grown = F.coalesce(workers, F.lit(DEFAULT_WORKERS)) * F.coalesce(
        percent_factor(increment), percent_factor(F.lit(DEFAULT_INCREMENT)))
    return grown.cast("int")


def install_payload(packages: Column) -> Column:
    return F.to_json(F.transform(packages, lambda p: F.struct(F.struct(p.alias("package")).alias("pypi"))))


def merge_conf(current: Column, new: Column) -> Column:
    """Both maps in one; the new value wins where a key is in both."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(current, empty), F.coalesce(new, empty), lambda _, a, b: F.coalesce(b, a))


def fix_catalogue(spark: SparkSession) -> DataFrame:
    """One row per issue type: four rows, whatever the size of the data."""
    rows = [
        F.struct(F.lit(i).alias("issue_type"), F.lit(FIX_TYPES[i]).alias("fix_type"),
                 F.lit(BASE_CONFIDENCE[i]).alias("base_confidence"),
                 lit_array(PERMISSIONS[i]).alias("required_permissions"),
                 F.lit(MINUTES[i]).alias("estimated_time"))
        for i in FIX_TYPES
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
