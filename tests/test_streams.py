"""Streams over several triggers, in scrambled order and across stops."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from runhealth.operators.verify import verify_next_run
from runhealth.sources import readers
from runhealth.streaming import approvals, follow, ledger, verify
from runhealth.streaming.scratch import finished, landed, one_a_trigger, run_available

HOUR = 3600


def replay(turns, waiting):
    out = []
    for turn, names_job, offered, approves, rejects in turns:
        if waiting is not None and (approves or rejects):
            out.append((turn, waiting, "approve" if approves else "reject"))
            waiting = None
        elif names_job:
            waiting = offered
    return out, waiting


FACTS = st.lists(st.tuples(st.booleans(), st.sampled_from([None, "f1", "f2"]), st.booleans(), st.booleans()), max_size=12)


@settings(max_examples=200, deadline=None)
@given(FACTS, st.sampled_from([None, "before"]))
def test_decisions_equal_a_replay(facts, waiting):
    turns = [(i, names, offered if names else None, a, r) for i, (names, offered, a, r) in enumerate(facts)]
    frame = pd.DataFrame([(i, 0, n, o, a, r) for i, n, o, a, r in turns], columns=approvals.HELD).astype(
        {"offered": object, "names_job": bool, "approves": bool, "rejects": bool})
    got, left = approvals.decisions(frame, waiting)
    want, after = replay(turns, waiting)
    assert list(got.itertuples(index=False, name=None)) == want and left == after


def chat_rows(seed, n):
    rng = random.Random(seed)
    say = ["monitor job_1", "monitor job_2", "monitor job_9", "yes", "reject it", "approve job_2", "hello", "how is it going"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 14)):
            rows.append((conv, turn, rng.choice(["user", "user", "assistant"]), rng.choice(say)))
    return rows


def chat_answers(rows, fixes):
    out = []
    for conv in {r[0] for r in rows}:
        waiting = None
        for _, turn, role, text in sorted(r for r in rows if r[0] == conv):
            if role != "user":
                continue
            job = next((w for w in ("job_1", "job_2", "job_9") if w in text), None)
            approves, rejects = "yes" in text or "approve" in text, "reject" in text
            if waiting is not None and (approves or rejects):
                out.append((conv, turn, waiting, "approve" if approves else "reject"))
                waiting = None
            elif job:
                waiting = fixes.get(job)
    return sorted(out)


def test_turns_of_shuffled_triggers_give_the_batch_answer(spark):
    fixes = {"job_1": "f1", "job_2": "f2"}
    rows = chat_rows(4, 40)
    frame = spark.createDataFrame(rows + rows[:5], "conv_id long, turn long, role string, text string")  # some come twice
    job_fixes = spark.createDataFrame(list(fixes.items()), "job_ref string, fix_id string")
    path = landed(frame, F.pmod(F.hash("conv_id", "turn", "text"), F.lit(3)), 3, "test-chat")
    live = approvals.approvals_stream(one_a_trigger(spark, path, frame), job_fixes)
    got = sorted(map(tuple, run_available(live, spark, "test-approvals").collect()))
    assert got == chat_answers(rows, fixes) and got


def test_a_missing_turn_holds_the_others_back_for_a_while(spark):
    start = "2024-01-01 00:00:00"
    rows = [(1, 0, "monitor job_1", 0, 0), (1, 2, "yes", 2, 0), (1, 3, "monitor job_2", 3, 0), (1, 4, "yes", 4, 1),  # turn 1 never comes
            (2, 0, "monitor job_1", 5, 0), (2, 2, "yes", 6, 0), (2, 1, "reject it", 7, 1),  # turn 1 comes in time
            (3, 0, "hello", 500, 2), (1, 5, "hello", 501, 2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, text string, minute int, place int").select(
        "conv_id", "turn", F.lit("user").alias("role"), "text", F.expr(f"timestamp'{start}' + make_interval(0,0,0,0,0,minute,0)").alias("ts"), "place")
    job_fixes = spark.createDataFrame([("job_1", "f1"), ("job_2", "f2")], "job_ref string, fix_id string")
    path = landed(frame, F.col("place"), 3, "test-gap")
    live = approvals.approvals_stream(one_a_trigger(spark, path, frame), job_fixes, ts="ts", patience="1 hour")
    got = sorted(map(tuple, run_available(live, spark, "test-gaps", keep_all=True).collect()))
    assert got == [(1, 2, "f1", "approve"), (1, 4, "f2", "approve"), (2, 1, "f1", "reject")]


@pytest.mark.parametrize("bucket_hours", [None, 3])
def test_fixes_and_runs_in_scrambled_order_equal_the_batch(spark, bucket_hours):
    rng = random.Random(bucket_hours or 1)
    rows = []
    for i in range(600):
        status = rng.choice(["FAILED", "SUCCESS", "FAILED", "RUNNING"])
        rows.append((i, rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 200), status, rng.choice(["memory", "disk"]) if status == "FAILED" else None))
    frame = spark.createDataFrame(rows, "run_id long, job_id long, hour int, status string, issue_type string").withColumn(
        "start_ts", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,hour)")).withColumn("duration_seconds", F.lit(1).cast("bigint"))
    fixes_of = lambda runs: runs.where("status = 'FAILED'").select(
        F.col("run_id").cast("string").alias("fix_id"), "job_id", F.col("start_ts").alias("fix_ts"), "issue_type")
    place = F.floor((F.col("hour") + F.pmod(F.hash("run_id"), F.lit(10))) / 36).cast("int")
    path = landed(frame, place, 6, "test-verify")
    live = one_a_trigger(spark, path, frame)
    answers = verify.verify_stream(fixes_of(live), live, 10 * HOUR, "11 hours", bucket_hours and bucket_hours * HOUR)
    got = {r["fix_id"]: (r["next_run_id"], r["next_status"], r["outcome"]) for r in verify.settled(
        run_available(answers, spark, "test-verify", keep_all=True)).collect()}
    want = {r["fix_id"]: (None if r["next_run_id"] is None else str(r["next_run_id"]), r["next_status"], r["outcome"])
            for r in verify_next_run(fixes_of(frame).withColumn("fix_type", F.lit("x")), frame, 10 * HOUR).collect()}
    newest = max(r[2] for r in rows if r[3] != "RUNNING")
    hours = {str(r[0]): r[2] for r in rows}
    settled = {f for f in want if hours[f] + 10 <= newest - 11}
    assert set(got) == settled and len(settled) > len(want) / 2
    assert {f: got[f] for f in got if got[f] != want[f]} == {}


def test_run_exports_are_read_alike_by_batch_and_stream(spark, tmp_path):
    exports = ['{"job_id": "j1", "run_id": "r1", "status": "FAILED", "start_time": 1000, "end_time": 5500, "logs": {"stderr": "Java heap space"}}',
               '{"job_id": "j1", "run_id": "r2", "status": "odd", "duration_seconds": 7}', "{broken"]
    for i, text in enumerate(exports):
        (tmp_path / f"{i}.json").write_text(text)
    live = follow.read_run_stream(spark, str(tmp_path), 1)
    got = run_available(live, spark, "test-exports")
    want = readers.read_runs(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {(r["run_id"], r["status"], r["duration_seconds"]) for r in got.collect()} == {("r1", "FAILED", 4), ("r2", "UNKNOWN", 7), (None, "UNKNOWN", None)}


def test_a_replayed_batch_leaves_no_repeat(spark, tmp_path, monkeypatch):
    frame = spark.range(30).withColumn("place", (F.col("id") % 3).cast("int"))
    path = landed(frame, F.col("place"), 3, "test-ledger")
    live = one_a_trigger(spark, path, frame).select("id")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def trigger():
        finished(ledger.batches_once(live, out, checkpoint).trigger(availableNow=True).start())

    real, calls = ledger.write_batch, []

    def stops_before_the_ledger(batch, stream_id, batch_id, where):
        calls.append(batch_id)
        if len(calls) == 2:  # rows written, then the driver is lost
            batch.write.mode("overwrite").parquet(f"{where}/rows/stream_id={stream_id}/batch_id={batch_id}")
            raise RuntimeError("stopped")
        real(batch, stream_id, batch_id, where)
        if len(calls) == 4:  # whole, but Spark never hears of it
            raise RuntimeError("stopped")

    monkeypatch.setattr(ledger, "write_batch", stops_before_the_ledger)
    with pytest.raises(Exception, match="stopped"):
        trigger()
    assert sorted(r["id"] for r in ledger.read_batches(spark, out, live.schema).collect()) == [i for i in range(30) if i % 3 == 0]
    with pytest.raises(Exception, match="stopped"):
        trigger()
    trigger()
    assert calls == [0, 1, 1, 2, 2]
    assert sorted(r["id"] for r in ledger.read_batches(spark, out, live.schema).collect()) == list(range(30))


def test_landing_keeps_the_upstream_parallel(spark):
    """Each landing is one file, but the rows before it are made in all their partitions, not folded into one task."""
    from pyspark import TaskContext

    task = F.udf(lambda _: TaskContext.get().partitionId(), "int")
    frame = spark.range(0, 4000, numPartitions=8).withColumn("made_in", task("id"))
    path = landed(frame, F.pmod(F.col("id"), F.lit(3)), 3, "test-parallel")
    back = spark.read.parquet(path)
    assert back.count() == 4000
    assert back.select("made_in").distinct().count() == 8
    assert len(back.inputFiles()) == 3
