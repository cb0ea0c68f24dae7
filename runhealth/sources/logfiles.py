"""Records of log files of any size, read by byte range.

Spark cuts a file at line ends into blocks of ``spark.sql.files.maxPartitionBytes``. Records are put together inside each
block; a record that goes on in later blocks is put together from the blocks' ends only. Nothing but those ends
meets outside a block, so a file of any size is read by as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from runhealth.sources.logtext import RECORD_START, parse_log_lines

_PLACE = ["_path", "_block"]


def log_lines(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Every line of the files: where its block starts in the file, and its order in the block."""
    lines = spark.read.option("pathGlobFilter", f"{name}*").option("lineSep", "\n").text(directory)
    return lines.select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), "value")


def _starts() -> Column:
    return F.col("value").rlike(RECORD_START).cast("long")


def block_starts(lines: DataFrame) -> DataFrame:
    """Per block the records that begin in it and, as ``_before``, in the file's blocks before it.

    A line above a file's first record is a record of its own kind and takes number 0.
    """
    first = F.min_by(_starts(), "_line")
    counts = lines.groupBy(*_PLACE).agg(F.sum(_starts()).alias("_n"), first.alias("_first"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = 1 - F.first("_first").over(whole)
    return counts.select(*_PLACE, "_n", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + above).alias("_before"))


def _text(pieces: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["value"]), "\n")


def log_file_records(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """(file, record_no, value): whole records, continuation lines attached, numbered from 0 in each file.

    Lines above a file's first record are one record, its first. Records of one block never leave it; the first and the
    last piece of a block are joined with those of its neighbours by record number. An empty file has no records.
    """
    lines = log_lines(spark, directory, name)
    so_far = Window.partitionBy(*_PLACE).orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The blocks' own partitioning serves the numbering, the gathering and the join.
    pieces = lines.withColumn("_local", F.sum(_starts()).over(so_far)).groupBy(*_PLACE, "_local").agg(
        F.any_value("file").alias("file"), _text(F.collect_list(F.struct("_line", "value"))).alias("value"))
    placed = pieces.join(block_starts(lines), _PLACE).withColumn("record_no", F.col("_before") + F.col("_local") - 1)
    at_end = (F.col("_local") == 0) | (F.col("_local") == F.col("_n"))
    inner = placed.where(~at_end).select("file", "record_no", "value")
    ends = placed.where(at_end).groupBy("_path", "record_no").agg(
        F.any_value("file").alias("file"), _text(F.collect_list(F.struct("_block", "_local", "value"))).alias("value"))
    return inner.unionByName(ends.select("file", "record_no", "value"))


def read_log_files(spark: SparkSession, directory: str, name: str = "agent.log") -> DataFrame:
    """Records of a log file and its rotated backups (``.1``, ``.2``, ...), files of any size.

    ``file`` and ``record_no`` give the order.
    """
    return parse_log_lines(log_file_records(spark, directory, name)).select("file", "record_no", "ts", "level", "logger", "message")
