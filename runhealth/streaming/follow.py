"""Follow log files and run exports as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runhealth.functions.diagnosis import diagnose_run
from runhealth.functions.intent import state_kind
from runhealth.functions.remedy import with_suggestion
from runhealth.sources import schemas
from runhealth.sources.logtext import STATE_LOGGER, state_lines
from runhealth.sources.readers import flatten_runs


def follow_states(lines: DataFrame, logger: str = STATE_LOGGER) -> DataFrame:
    """The agent states in a stream (or table) of log lines; stateless."""
    return state_lines(lines, logger).withColumn("kind", state_kind(F.col("state")))


def read_run_stream(spark: SparkSession, directory: str, files_per_trigger: int = 1000) -> DataFrame:
    raw = (spark.readStream.schema(schemas.RUN_EXPORT).option("mode", "PERMISSIVE")
           .option("maxFilesPerTrigger", files_per_trigger).json(directory))
    return flatten_runs(raw)


def diagnose_stream(runs: DataFrame, ts: str = "start_ts", lateness: str = "1 hour") -> DataFrame:
    """Diagnose and suggest for failed runs as they arrive; a run exported twice counts once."""
    failed = runs.where(F.col("status") == "FAILED")
    once = failed.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["run_id"])
    return with_suggestion(diagnose_run(once))
