"""Check fixes against later runs as both arrive.

Time is cut into buckets, by default one timeout long, so the runs that can answer a fix lie
in its own bucket or the next ones, and jobs are dealt into shards by hash. Work is keyed by
(shard, bucket), never by job alone: a job with a third of all runs is spread over as many keys
as buckets. Jobs share a key because each call into Python costs milliseconds, whatever its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runhealth.functions.text import epoch_seconds
from runhealth.operators.verify import DAY, FINISHED, TIMEOUT_SECONDS, outcome

ANSWER = ("fix_id string, job_id string, fix_issue string, buckets int, next_run_id string, "
          "next_at bigint, next_status string, next_issue string")
RUN, FIX = 0, 1
# Shards of jobs. A checkpoint holds for the number it was made with; a key's rows of one bucket are in one task's memory.
SHARDS = 16


def arrivals(fixes: DataFrame, runs: DataFrame, timeout_seconds: int = TIMEOUT_SECONDS,
             bucket_seconds: int | None = None) -> DataFrame:
    """Fixes and finished runs as one stream; a fix is put in each bucket its wait touches."""
    width = bucket_seconds or timeout_seconds
    at = epoch_seconds(F.col("ts"))
    run_rows = runs.where(F.col("status").isin(FINISHED)).select(
        F.col("job_id").cast("string").alias("job_id"), F.col("start_ts").cast("timestamp").alias("ts"),
        F.lit(RUN).alias("kind"), F.col("run_id").cast("string").alias("id"),
        F.lit(None).cast("bigint").alias("deadline"), "issue_type", "status")
    fix_rows = fixes.select(
        F.col("job_id").cast("string").alias("job_id"), F.col("fix_ts").cast("timestamp").alias("ts"),
        F.lit(FIX).alias("kind"), F.col("fix_id").cast("string").alias("id"),
        (epoch_seconds(F.col("fix_ts")) + timeout_seconds).alias("deadline"), "issue_type",
        F.lit(None).cast("string").alias("status"))
    both = run_rows.unionByName(fix_rows).withColumn("at", at)
    first = F.floor(F.col("at") / width).cast("bigint")
    last = F.floor(F.coalesce("deadline", "at") / width).cast("bigint")
    return (
        both.withColumn("buckets", (last - first + 1).cast("int"))
        .withColumn("bucket", F.explode(F.sequence(first, last)))
    )


BLOCK = "block binary"
RUNS = pa.schema([("job_id", pa.string()), ("at", pa.int64()), ("id", pa.string()), ("status", pa.string()), ("issue_type", pa.string())])
OPEN = pa.schema([("job_id", pa.string()), ("at", pa.int64()), ("id", pa.string()), ("deadline", pa.int64()),
                  ("issue_type", pa.string()), ("buckets", pa.int32())])


def packed(rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    """Rows as one Arrow stream, so that state takes and gives them whole, not value by value."""
    batch = pa.record_batch([pa.array(rows[f.name], f.type, from_pandas=True) for f in schema], schema=schema)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as stream:
        stream.write_batch(batch)
    return (out.getvalue().to_pybytes(),)


def unpacked(blocks: Iterator[tuple], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(bytes(block)).read_all() for (block,) in blocks]
    return pa.concat_tables([schema.empty_table(), *tables]).to_pandas()


def _firsts(runs: pd.DataFrame) -> pd.DataFrame:
    """The first run of each job and time: smaller number, then id."""
    tied = runs.duplicated(["job_id", "at"], keep=False).to_numpy()
    if not tied.any():
        return runs
    some = runs[tied]
    number = pd.to_numeric(some["id"], errors="coerce")
    some = some.assign(_number=number).sort_values(["at", "_number", "id"]).drop_duplicates(["job_id", "at"])
    return pd.concat([runs[~tied], some.drop(columns="_number")], ignore_index=True)


def _numbered(*jobs: pd.Series) -> np.ndarray:
    """A number for each job, one after the other; no job is a job of its own."""
    return pd.factorize(np.concatenate([x.to_numpy(dtype=object) for x in jobs]), use_na_sentinel=False)[0]


class FixTimers(StatefulProcessor):
    """The open fixes of a shard's jobs in one bucket and their runs, as blocks of rows, and a timer for the earliest due fix.

    A fix is due when the watermark passes its deadline, or the end of the bucket where that comes first; the timer then answers
    all that are due and moves to the next. A batch only appends its rows. Runs go with the day that no open fix of their job and
    no row that may still come can need, at the latest with the bucket.
    """

    def __init__(self, bucket_seconds: int):
        self.bucket_seconds = bucket_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", BLOCK)
        self.fixes = handle.getListState("fixes", BLOCK)

    def _bucket_end(self, key) -> int:
        return (int(key[1]) + 1) * self.bucket_seconds

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        is_fix = frame["kind"].to_numpy() == FIX
        runs, fixes = frame[~is_fix], frame[is_fix]
        if len(runs):
            self.runs.appendValue(packed(_firsts(runs), RUNS))
        if len(fixes):
            self.fixes.appendValue(packed(fixes, OPEN))
        due = int(min([self._bucket_end(key), *fixes["deadline"]])) * 1000
        known = list(self.handle.listTimers())
        if not known or due < min(known):
            for timer in known:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bucket_end = self._bucket_end(key)
        watermark = timerValues.getCurrentWatermarkInMs() // 1000
        fixes = unpacked(self.fixes.get(), OPEN).drop_duplicates(["job_id", "id"], keep="last")
        is_due = np.minimum(fixes["deadline"].to_numpy(), bucket_end) <= watermark
        due, still = fixes[is_due], fixes[~is_due]
        if len(due) or watermark < bucket_end:
            runs = unpacked(self.runs.get(), RUNS)
        if len(due):
            yield self._answers(due, _firsts(runs))
        if watermark >= bucket_end:
            self.fixes.clear()
            self.runs.clear()
            return
        if len(due):
            self.fixes.put([packed(still, OPEN)])
        # Rows at or before the watermark are dropped, so a fix still to come is later than that.
        jobs = _numbered(still["job_id"], runs["job_id"])
        oldest = np.full(len(still) + len(runs), watermark)
        np.minimum.at(oldest, jobs[:len(still)], still["at"].to_numpy())
        kept = runs[runs["at"].to_numpy() // DAY >= oldest[jobs[len(still):]] // DAY]
        if len(kept) < len(runs):
            self.runs.put([packed(kept, RUNS)])
        self.handle.registerTimer(int(min([bucket_end, *still["deadline"]])) * 1000)

    @staticmethod
    def _answers(due: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        """Each fix with the first run of its job after it, if that is in time."""
        jobs = _numbered(due["job_id"], runs["job_id"])
        at = np.concatenate([due["at"], runs["at"]]).astype("int64")
        # Job and time in one number: runs in its order, and each fix's place among them.
        place = jobs * (at.max() - at.min() + 1) + at - at.min()
        order = np.argsort(place[len(due):])
        after = np.searchsorted(place[len(due):][order], place[:len(due)], side="right")
        first = np.append(order, -1)[after]
        found = (first >= 0) & (np.append(jobs, -1)[len(due):][first] == jobs[:len(due)])
        found &= np.append(at, 0)[len(due):][first] <= due["deadline"].to_numpy()
        run = runs.iloc[first[found]].set_axis(np.flatnonzero(found)).reindex(range(len(due)))
        return pd.DataFrame({
            "fix_id": due["id"].to_numpy(), "job_id": due["job_id"].map(str).to_numpy(), "fix_issue": due["issue_type"].to_numpy(),
            "buckets": due["buckets"].to_numpy(), "next_run_id": run["id"], "next_at": run["at"].astype("Int64"),
            "next_status": run["status"], "next_issue": run["issue_type"]})


def verify_stream(fixes: DataFrame, runs: DataFrame, timeout_seconds: int = TIMEOUT_SECONDS,
                  lateness: str | None = None, bucket_seconds: int | None = None, shards: int = SHARDS) -> DataFrame:
    """One row per fix and bucket: the first run that answers it there, or none.

    Fixes and runs may arrive in any order and over any number of triggers; rows later than ``lateness`` (by default the
    timeout) are dropped by the watermark, and a fix is answered once that passes its deadline. Buckets are one timeout long, or
    ``bucket_seconds`` where one timeout of a job's runs is too much for one task; ``shards`` keys share a bucket's jobs. Read the
    result with ``settled``.
    """
    width = bucket_seconds or timeout_seconds
    both = arrivals(fixes, runs, timeout_seconds, width).withWatermark("ts", lateness or f"{timeout_seconds} seconds")
    shard = F.pmod(F.xxhash64("job_id"), F.lit(shards)).cast("int")
    return both.withColumn("shard", shard).groupBy("shard", "bucket").transformWithStateInPandas(
        statefulProcessor=FixTimers(width), outputStructType=ANSWER, outputMode="append", timeMode="EventTime")


def with_open(fixes: DataFrame, settled_fixes: DataFrame) -> DataFrame:
    """Every fix: those not settled yet have outcome ``open``."""
    done = settled_fixes.drop("job_id", "issue_type").withColumnRenamed("outcome", "_outcome")
    return fixes.select("fix_id", F.col("job_id").cast("string").alias("job_id"), "issue_type").join(done, "fix_id", "left") \
        .withColumn("outcome", F.coalesce("_outcome", F.lit("open"))).drop("_outcome")


def settled(answers: DataFrame) -> DataFrame:
    """Fixes whose every bucket is closed, with their outcome."""
    nearest_run = F.min_by(F.struct("next_run_id", "next_status", "next_issue"), F.col("next_at"))
    whole = answers.groupBy("fix_id", "job_id", "fix_issue").agg(
        F.count(F.lit(1)).alias("_closed"), F.max("buckets").alias("_buckets"), nearest_run.alias("_next"))
    same = F.coalesce(F.col("_next.next_issue") == F.col("fix_issue"), F.lit(False))
    return whole.where(F.col("_closed") == F.col("_buckets")).select(
        "fix_id", "job_id", F.col("fix_issue").alias("issue_type"), "_next.next_run_id", "_next.next_status",
        outcome(F.col("_next.next_status"), same).alias("outcome"))
