"""Turn log text into records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runhealth.functions.text import log_time
from runhealth.operators.ordered import nearest

# The shape of a record's first line, and of agent state messages.
TIME = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
RECORD = rf"^({TIME}) \| ([^|]*?) \| (.*?) \| ([\s\S]*)$"
RECORD_START = rf"^{TIME} \| "
STATE = r"^AGENT STATE: ([^\n]+)"
LEGACY_FIX = r"^Suggested fix: ([^\n]+) \(confidence: ([\d.]+)\) - awaiting user approval"
STATE_LOGGER = "runhealth.agent"
LINES_PER_BUCKET = 100_000


def log_fields(value: Column) -> dict[str, Column]:
    """The four fields of a record; a line that is no record is all message."""
    is_record = value.rlike(RECORD)

    def group(i: int) -> Column:
        return F.when(is_record, F.regexp_extract(value, RECORD, i))
    return {
        "ts": log_time(group(1)),
        "level": group(2),
        "logger": group(3),
        "message": F.coalesce(group(4), value),
    }


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add ``ts level logger message``; only the first three separators split."""
    return lines.withColumns(log_fields(F.col(column)))


def assemble_records(lines: DataFrame, lines_per_bucket: int = LINES_PER_BUCKET) -> DataFrame:
    """Attach continuation lines to the record above, over ``file line_no value``.

    For lines that come as rows, of files of any length. A line above a file's
    first record belongs to none and stays a record of its own.
    """
    starts = F.col("value").rlike(RECORD_START)
    seen = nearest(lines, ["file"], ["line_no"], F.floor(F.col("line_no") / lines_per_bucket).cast("bigint"),
                   F.when(starts, F.col("line_no")), "_above")
    first = F.when(starts, F.col("line_no")).otherwise(F.coalesce("_above", "line_no"))
    text = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    whole = (
        seen.withColumn("first_line", first).groupBy("file", "first_line").agg(text.alias("_lines"))
        .select("file", "first_line", F.size("_lines").alias("n_lines"),
                F.array_join(F.transform("_lines", lambda r: r["value"]), "\n").alias("value"))
    )
    return parse_log_lines(whole).drop("value")


def state_of(message: Column) -> Column:
    """The agent state in a message, or in the older fix line; null if neither."""
    state = F.nullif(F.regexp_extract(message, STATE, 1), F.lit(""))
    fix = F.nullif(F.regexp_extract(message, LEGACY_FIX, 1), F.lit(""))
    legacy = F.concat(F.lit("Suggested fix: "), fix, F.lit(" with confidence "),
                      F.regexp_extract(message, LEGACY_FIX, 2))
    return F.coalesce(state, legacy)


def state_lines(lines: DataFrame, logger: str = STATE_LOGGER) -> DataFrame:
    """Agent states in a log, both spellings in one pass."""
    parsed = parse_log_lines(lines).where((F.col("level") == "INFO") & (F.col("logger") == logger))
    return parsed.withColumn("state", state_of(F.col("message"))).where(F.col("state").isNotNull())
