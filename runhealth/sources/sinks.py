"""Write fixes, history and reports; read back the newest fix per id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_fix_store(fixes: DataFrame, path: str) -> None:
    """Append fixes with ``stored_ts``; earlier versions of a fix stay in the store."""
    fixes.write.mode("append").parquet(path)


def latest_fix(store: DataFrame) -> DataFrame:
    """The last version stored of each fix; of equal times the one with the larger fields."""
    rest = [c for c in store.columns if c != "fix_id"]
    return store.groupBy("fix_id").agg(F.max_by(F.struct(*rest), F.struct("stored_ts", *rest)).alias("_fix")).select(
        "fix_id", "_fix.*")


def get_fixes(ids: DataFrame, store: DataFrame) -> DataFrame:
    """Look fixes up by id; an id that was never stored gives nulls."""
    return ids.join(latest_fix(store.join(ids, "fix_id", "left_semi")), "fix_id", "left")


def _by_period(df: DataFrame, ts: str, period: str) -> DataFrame:
    """Add the partition date ``dt`` and gather its rows: Spark joins small periods
    and splits a busy one over several tasks."""
    return df.withColumn("dt", F.to_date(F.date_trunc(period, F.col(ts)))).hint("rebalance", "dt")


def write_history(history: DataFrame, path: str, ts: str = "ts", period: str = "day") -> None:
    """Append analyses, one per run and time, partitioned by ``period``."""
    once = history.dropDuplicates(["run_id", ts])
    _by_period(once, ts, period).write.mode("append").partitionBy("dt").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Analyses without the repeats that separate appends can leave."""
    return spark.read.parquet(path).dropDuplicates(["run_id", "ts"])


def write_reports(reports: DataFrame, path: str, ts: str = "start_ts", period: str = "day") -> None:
    """One report per run, partitioned by ``period``."""
    _by_period(reports, ts, period).write.mode("append").partitionBy("dt").parquet(path)
