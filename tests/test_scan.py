"""Routing as a scan of composed functions, against a replay."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from runhealth.operators import chat
from runhealth.operators.scan import states_before


@pytest.mark.parametrize("fan,levels,width", [(2, 3, 3), (512, 3, 256), (3, 0, 5), (2, 1, 1)])
def test_running_maximum_with_resets(spark, fan, levels, width):
    """A row raises the state to its value, or sets it back; keys of any size, null included."""
    rng = random.Random(width)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.randint(0, 50), rng.random() < 0.1, "extra") for i in range(300)]
    frame = spark.createDataFrame(rows, "k long, i long, v long, reset boolean, function string").repartition(5)
    does = F.struct(F.when(F.col("reset"), F.lit(0)).otherwise(F.col("v")).cast("bigint").alias("least"), F.col("reset").alias("forget"))
    apply = lambda s, f: F.when(f["forget"], f["least"]).otherwise(F.greatest(s, f["least"]))
    compose = lambda f, g: F.struct(
        F.when(g["forget"], g["least"]).otherwise(F.greatest(f["least"], g["least"])).alias("least"), (f["forget"] | g["forget"]).alias("forget"))
    got = states_before(frame, ["k"], ["i"], F.floor(F.col("i") / width).cast("bigint"), does, compose, apply,
                        F.lit(-1).cast("bigint"), "before", fan, levels)
    want = []
    for key in {r[0] for r in rows}:
        state = -1
        for row in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            want.append((*row, state))
            state = 0 if row[3] else max(state, row[2])
    assert sorted(map(str, (tuple(r[c] for c in ("k", "i", "v", "reset", "function", "before")) for r in got.collect()))) == sorted(map(str, want))


def test_routing_reads_chat_once(spark, small):
    from runhealth.plans import catalog

    plan = catalog.queries()["route_messages"](spark, small)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    reads = [line for line in final.splitlines() if "FileScan parquet" in line and "conv_id" in line]
    assert len(reads) == 1, final


def replay(rows, fixes):
    out = {}
    for conv in {r[0] for r in rows}:
        waiting, found = None, False
        for _, turn, text in sorted(r for r in rows if r[0] == conv):
            job = next((w for w in ("job_1", "job_2", "job_9") if w in text), None)
            approves, rejects = "yes" in text or "approve" in text, "reject" in text
            if waiting and approves:
                kind = "approve"
            elif waiting and rejects:
                kind = "reject"
            else:
                kind = "monitor" if job else "in_progress" if found else "help" if "help" in text else "generic"
            out[conv, turn] = kind, waiting
            waiting = None if waiting and (approves or rejects) else fixes.get(job) if job else waiting
            found = job in fixes if job else found
    return out


@pytest.mark.parametrize("width", [2, 256])
def test_routing_equals_a_replay(spark, width):
    rng = random.Random(width)
    say = ["monitor job_1", "monitor job_9", "yes", "reject it", "approve job_2", "hello", "help me", "reject job_9"]
    rows = [(conv, turn, rng.choice(say)) for conv in range(30) for turn in range(rng.randint(1, 40))]
    fixes = {"job_1": "f1", "job_2": "f2"}
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("user"))
    got = chat.route_messages(turns, spark.createDataFrame(list(fixes.items()), "job_ref string, fix_id string"), turns_per_bucket=width)
    assert {(r["conv_id"], r["turn"]): (r["message_class"], r["waiting_fix"]) for r in got.collect()} == replay(rows, fixes)
