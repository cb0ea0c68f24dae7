"""Newest, first, last and previous: ordered views of runs, logs and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runhealth.functions.intent import state_kind
from runhealth.functions.text import or_default, time_bucket
from runhealth.operators.ordered import first_n, nearest, running_number

LINES_PER_BUCKET = 100_000
DAY = 86_400


def recent_runs(runs: DataFrame, limit: int = 25, per_job: bool = False) -> DataFrame:
    """The newest runs, overall or of each job."""
    newest = [F.col("start_ts").desc(), F.col("run_id").desc()]
    if per_job:
        return first_n(runs, ["job_id"], newest, limit)
    return runs.orderBy(*newest).limit(limit)


def tail_lines(lines: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` lines of each file, over ``file line_no value``."""
    return first_n(lines, ["file"], [F.col("line_no").desc()], n, "from_end")


def head_logs(logs: DataFrame, max_logs: int = 10) -> DataFrame:
    """The first ``max_logs`` entries of each run; ``truncated`` is true iff some were cut.

    One entry more than needed is kept per run to see whether there is one, so
    no run is counted in full.
    """
    kept = first_n(logs, ["run_id"], [F.col("ts").asc(), F.col("event_id").asc()], max_logs + 1)
    cut = kept.groupBy("run_id").agg((F.max("position") > max_logs).alias("truncated"))
    return kept.where(F.col("position") <= max_logs).join(cut, "run_id")


def _entry_line() -> Column:
    time = or_default(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "Unknown")
    return F.concat(F.lit("["), time, F.lit("] "), or_default(F.col("message"), "No message"))


def _joined_lines(rows: str) -> Column:
    return F.array_join(F.transform(rows, lambda r: r["_line"]), "\n").alias("digest")


def digest_text(logs: DataFrame, max_logs: int = 10) -> DataFrame:
    """Per run, its first entries as ``[time] message`` lines. At most ``max_logs``
    entries per run are collected; ``digest_chunks`` has them all."""
    entries = F.array_sort(F.collect_list(F.struct("position", "_line")))
    kept = first_n(logs, ["run_id"], [F.col("ts").asc(), F.col("event_id").asc()], max_logs + 1)
    return (
        kept.withColumn("_line", _entry_line()).groupBy("run_id").agg(entries.alias("_rows"))
        .select("run_id", F.size("_rows").alias("_n"), F.slice("_rows", 1, max_logs).alias("_rows"))
        .select("run_id", F.size("_rows").alias("log_count"), (F.col("_n") > max_logs).alias("truncated"), _joined_lines("_rows"))
    )


def digest_chunks(logs: DataFrame, per_chunk: int = 10, bucket_seconds: int = DAY) -> DataFrame:
    """Per run and chunk, ``per_chunk`` entries each in order of time, all its entries as ``[time] message`` lines.

    Entries are numbered within days and days are added up, so a run with much of the table is spread over its days;
    a chunk is all that is held together.
    """
    numbered = running_number(logs, ["run_id"], ["ts", "event_id"], time_bucket(F.col("ts"), bucket_seconds), "position")
    chunk = F.floor((F.col("position") - 1) / per_chunk).cast("bigint")
    rows = F.array_sort(F.collect_list(F.struct("position", "_line")))
    return numbered.select("run_id", chunk.alias("chunk"), "position", _entry_line().alias("_line")).groupBy("run_id", "chunk").agg(
        rows.alias("_rows")).select("run_id", "chunk", F.size("_rows").alias("log_count"), _joined_lines("_rows"))


def last_user_message(chat: DataFrame) -> DataFrame:
    """Per conversation, the text of its last user turn; nothing there reads ``Hello``."""
    last = F.max_by(F.when(F.col("role") == "user", F.struct("text")), F.when(F.col("role") == "user", F.col("turn")))
    return chat.groupBy("conv_id").agg(last.alias("_last")).select(
        "conv_id", F.coalesce(F.nullif(F.col("_last.text"), F.lit("")), F.lit("Hello")).alias("query"))


def chat_context(requests: DataFrame, system: str) -> DataFrame:
    """Messages to send per request: system, context if there is any, user."""
    def message(role: str, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))
    context = F.when(F.coalesce(F.col("context"), F.lit("")) != "",
                     message("system", F.concat(F.lit("Context: "), F.col("context"))))
    return requests.withColumn("messages", F.array_compact(F.array(
        message("system", F.lit(system)), context, message("user", F.col("query")))))


def history_newest_first(history: DataFrame) -> DataFrame:
    label = F.concat_ws("", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" - Job: "),
                        F.col("job_id").cast("string"), F.lit(" - Issue: "), F.col("issue_type"))
    return history.withColumn("label", label).orderBy(F.col("ts").desc(), F.col("run_id").desc())


def state_transitions(states: DataFrame, lines_per_bucket: int = LINES_PER_BUCKET) -> DataFrame:
    """Each state of a log file with the state before it and the time between.

    Reads ``file line_no ts state``; order is by line, as the file was written.
    """
    seen = nearest(states, ["file"], ["line_no"], F.floor(F.col("line_no") / lines_per_bucket).cast("bigint"),
                   F.struct("state", "ts"), "_before")
    return (
        seen.withColumn("kind", state_kind(F.col("state")))
        .withColumn("previous_state", F.col("_before.state"))
        .withColumn("seconds_in_previous", F.timestamp_diff("SECOND", F.col("_before.ts"), F.col("ts")))
        .drop("_before")
    )
