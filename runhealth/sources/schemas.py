"""Schemas of the tables, declared so that no reader infers types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RUN_STATUSES = ["PENDING", "RUNNING", "SUCCESS", "FAILED", "CANCELED", "UNKNOWN"]


RUN_EXPORT = (
    "job_id string, run_id string, run_name string, cluster_id string, status string, duration_seconds bigint, "
    "start_time bigint, end_time bigint, logs struct<stdout:string,stderr:string>, timestamp double, "
    "_corrupt_record string")
JOB_EXPORT = (
    "job_id string, creator_user_name string, created_time bigint, "
    "settings struct<name:string,schedule:string>, _corrupt_record string")
CLUSTER_EXPORT = (
    "cluster_id string, cluster_name string, state string, creator_user_name string, node_type_id string, "
    "spark_version string, num_workers int, spark_conf map<string,string>, _corrupt_record string")
ACTIVITY_EXPORT = "timestamp string, action_type string, user_name string, _corrupt_record string"
CLUSTER_EVENT_EXPORT = (
    "cluster_id string, timestamp bigint, type string, details string, _corrupt_record string")
API_CALL_EXPORT = (
    "timestamp double, operation string, success boolean, parameters map<string,string>, result_size bigint, "
    "duration_seconds double, error struct<type:string,message:string>, _corrupt_record string")
LOG_ENTRY_EXPORT = (
    "timestamp string, log_type string, cluster_id string, user string, message string, level string, "
    "source string, _corrupt_record string")


def known_status(status: Column) -> Column:
    """The status if it is one of the known ones, else UNKNOWN."""
    return F.when(status.isin(RUN_STATUSES), status).otherwise(F.lit("UNKNOWN"))
