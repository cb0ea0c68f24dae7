"""Skew, resource use and call statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runhealth.functions.guards import redact
from runhealth.functions.text import mb_to_gb
from runhealth.operators.inventory import running_only

# Fixed value: a key with more than this many times the average is skew.
SKEW_THRESHOLD = 2.0
RESOURCES = ["cpu", "memory", "disk"]


def exact_sum(column: str) -> Column:
    """A sum that does not depend on the order the rows arrive in."""
    return F.sum(F.col(column).cast("decimal(18,6)")).cast("double")


def key_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("rows"))


def data_skew(df: DataFrame, column: str, threshold: float = SKEW_THRESHOLD) -> DataFrame:
    """Largest key against the average key; null counts as a key.

    Counting is partial before the shuffle, so the skew being measured does not
    skew the measurement. ``recommendation`` is the number of salts that brings the
    largest key down to the average.
    """
    ratio = F.max("rows") / F.avg("rows")
    return (
        key_counts(df, column)
        .agg(F.count(F.lit(1)).alias("keys"), F.sum("rows").alias("rows"), F.max("rows").alias("max_rows"),
             F.round(ratio, 6).alias("skew_ratio"))
        .withColumn("skew_detected", F.col("skew_ratio") > threshold)
        .withColumn("recommendation", F.when(
            F.col("skew_detected"), F.concat(F.lit("salt: "), F.ceil("skew_ratio").cast("string"))).otherwise(F.lit("salt: 1")))
    )


def top_keys(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` largest keys of a column."""
    return key_counts(df, column).orderBy(F.col("rows").desc(), F.col("key").asc_nulls_last()).limit(k)


def resource_utilisation(metrics: DataFrame, clusters: DataFrame) -> DataFrame:
    """Driver and worker use per running cluster, one column set per resource.

    ``metrics`` is long form: ``cluster_id node_role node_id resource sampled_ts used total``,
    memory and disk in MB. The newest sample of each node and resource counts, of equal times the
    larger. A resource whose total is zero has no percentage. Clusters that do not run keep a
    row that says so.
    """
    sample = F.struct("used", "total")
    metrics = metrics.groupBy("cluster_id", "node_role", "node_id", "resource").agg(
        F.max_by(sample, F.struct("sampled_ts", "used", "total")).alias("_newest")
    ).select("cluster_id", "node_role", "resource", "_newest.*")
    pct = F.try_divide(F.col("used") * 100.0, F.col("total"))
    aggs = []
    for r in RESOURCES:
        here = F.col("resource") == r
        driver, worker = here & (F.col("node_role") == "driver"), here & (F.col("node_role") == "worker")
        aggs += [
            F.round(F.avg(F.when(driver, pct)), 4).alias(f"{r}_driver_avg_pct"),
            F.round(F.avg(F.when(worker, pct)), 4).alias(f"{r}_worker_avg_pct"),
            F.round(F.max(F.when(worker, pct)), 4).alias(f"{r}_worker_max_pct"),
        ]
        if r != "cpu":
            aggs += [F.round(mb_to_gb(F.sum(F.when(here, F.col(c)))), 4).alias(f"{r}_{c}_gb") for c in ("used", "total")]
    used = metrics.groupBy("cluster_id").agg(*aggs)
    names = [c for c in used.columns if c != "cluster_id"]
    checked = running_only(clusters.select("cluster_id", "state").join(used, "cluster_id", "left"))
    return checked.withColumns({n: F.when(F.col("status") == "success", F.col(n)) for n in names})


def api_call_stats(calls: DataFrame) -> DataFrame:
    error = F.col("error.type")
    return calls.groupBy("operation").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("success")).alias("failures"),
        exact_sum("duration_seconds").alias("total_seconds"),
        (exact_sum("duration_seconds") / F.count("duration_seconds")).alias("avg_seconds"),
        F.sum("result_size").alias("result_size"),
        F.count_distinct(error).alias("error_types"),
    )


def api_errors(calls: DataFrame) -> DataFrame:
    return calls.where(~F.col("success")).groupBy("operation", F.col("error.type").alias("error_type")).agg(
        F.count(F.lit(1)).alias("failures"))


def redact_parameters(calls: DataFrame) -> DataFrame:
    return calls.withColumn("parameters", redact(F.col("parameters")))


def route_by_success(calls: DataFrame) -> DataFrame:
    """Which log stream a call belongs to."""
    return calls.withColumn("stream", F.when(F.col("success"), F.lit("debug")).otherwise(F.lit("error")))


def response_latency(calls: DataFrame, percentiles: tuple[float, ...] = ()) -> DataFrame:
    """Time per operation, failures apart; percentiles are approximate and optional."""
    return calls.groupBy("operation", "success").agg(
        F.count(F.lit(1)).alias("calls"),
        (exact_sum("duration_seconds") / F.count("duration_seconds")).alias("avg_seconds"),
        F.max("duration_seconds").alias("max_seconds"),
        *[F.percentile_approx("duration_seconds", p).alias(f"p{int(p * 100)}_seconds") for p in percentiles])

