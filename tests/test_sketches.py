"""Kept summaries, largest keys, pattern tables and the fix store, against exact answers."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runhealth.operators import metrics, sketches
from runhealth.operators.patterns import literal_of, tag_patterns
from runhealth.sources.sinks import latest_fix
from runhealth.streaming import fix_store
from runhealth.streaming.scratch import finished, keyed_state_store, landed, one_a_trigger


def test_days_merge_to_any_span_without_the_others(spark, tmp_path):
    frame = spark.range(20_000).select(
        (F.col("id") % 3).alias("kind"), (F.col("id") % 4001).alias("job"), (F.col("id") % 1000 / 10).alias("seconds"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,CAST(id % 8 AS INT))").alias("ts"))
    path = str(tmp_path / "days")
    sketches.store_days(sketches.daily_distinct(frame, "ts", ["kind"], "job"), path)
    sketches.store_days(sketches.daily_distinct(frame.where("to_date(ts) = '2024-01-03'"), "ts", ["kind"], "job"), path)  # written again
    span = sketches.read_days(spark, path, "2024-01-02", "2024-01-04")
    got = {r["kind"]: r for r in sketches.distinct_over(span, ["kind"]).collect()}
    exact = frame.where("to_date(ts) BETWEEN '2024-01-02' AND '2024-01-04'").groupBy("kind").agg(
        F.count("*").alias("rows"), F.count_distinct("job").alias("jobs")).collect()
    for r in exact:
        assert got[r["kind"]]["rows"] == r["rows"] and abs(got[r["kind"]]["distinct_values"] - r["jobs"]) <= 4 * sketches.DISTINCT_ERROR * r["jobs"]
    plan = span._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    ranks = (0.1, 0.5, 0.99)
    quantiles = sketches.quantiles_over(sketches.daily_quantiles(frame, "ts", ["kind"], "seconds"), ["kind"], ranks)
    for r in quantiles.collect():
        values = [x["seconds"] for x in frame.where(F.col("kind") == r["kind"]).collect()]
        for rank in ranks:
            value = r[f"p{round(rank * 100)}"]
            assert sum(v < value for v in values) / len(values) <= rank + sketches.RANK_ERROR
            assert sum(v <= value for v in values) / len(values) >= rank - sketches.RANK_ERROR


def test_quantiles_of_nothing_are_null(spark):
    frame = spark.createDataFrame([("a", None)], "kind string, seconds double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert sketches.quantiles_over(sketches.daily_quantiles(frame, "ts", ["kind"], "seconds"), ["kind"], (0.5,)).first()["p50"] is None


@pytest.mark.parametrize("buckets", [8, 1 << 16])
@pytest.mark.parametrize("shape", ["skewed", "flat", "few", "none"])
def test_largest_keys_are_exact(spark, buckets, shape):
    rng = random.Random(1)
    keys = {"skewed": [int(rng.paretovariate(0.7)) for _ in range(5000)] + [None] * 300, "flat": list(range(400)) * 2, "few": [1, 1, 2], "none": []}[shape]
    frame = spark.createDataFrame([(k,) for k in keys], "k long").repartition(4)
    want = [tuple(r) for r in metrics.top_keys(frame, "k", 10).collect()]
    assert [tuple(r) for r in sketches.heaviest_keys(frame, "k", 10, buckets).collect()] == want


def test_only_full_buckets_are_counted_key_by_key(spark):
    frame = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 20).otherwise(F.col("id")).alias("k"))
    best = sketches.heaviest_keys(frame, "k", 5)
    assert "LeftSemi" in best._jdf.queryExecution().executedPlan().toString()
    assert [r["rows"] for r in best.collect()] == [5000] * 5


PATTERNS = ["No module named '([^']+)'", r"Class(?i)X", "(?i)OUT of memory", r"exit\.code \d+", "abc*", "ab", "heap|disk", r"a\.b\.c", "colou?r red",
            "ends here$", r"\bword\b", "x{3}y", "plain text", "(group) text", "quot'ed", r"100\%"]
LINES = ["No module named 'x'", "ran Out Of Memory now", "exit.code 17", "exitXcode 17", "ab", "abcc", "a.b.c", "aXbXc", "color red", "colour red", "it ends here",
         "it ends here no", "a word here", "xxxy", "some plain text", "group text", "Class X", "ClassX", "quot'ed", "100%", "heap", "", None]


def test_literals_are_in_every_match(spark):
    found = {r["pattern"]: r["literal"] for r in spark.createDataFrame([(p,) for p in PATTERNS], "pattern string").withColumn(
        "literal", literal_of(F.col("pattern"))).collect()}
    assert found["No module named '([^']+)'"] == "no module named '" and found["(?i)OUT of memory"] == "out of memory"
    assert found[r"exit\.code \d+"] == "exit.code " and found["abc*"] is None and found["ab"] is None and found["heap|disk"] is None
    assert found["colou?r red"] == "colo" and found[r"100\%"] == "100%" and found[r"\bword\b"] is None


@pytest.mark.parametrize("index_rows", [0, 1 << 20])
def test_tags_equal_every_pattern_on_every_line(spark, index_rows):
    rng = random.Random(2)
    lines = [(i, rng.choice(LINES), "x") for i in range(200)] + [(None, "abc", "x")]
    table = spark.createDataFrame([(f"p{i}", p, None) for i, p in enumerate(PATTERNS)] + [("given", "(one|two) heaps", "heaps")],
                                  "name string, pattern string, literal string")
    got = tag_patterns(spark.createDataFrame(lines + [(500, "two heaps", "x")], "n long, message string, gram string"), table, ["n"], index_rows=index_rows)
    want = {i: sorted(f"p{k}" for k, p in enumerate(PATTERNS) if text is not None and re.search(p.replace("Class(?i)X", "Class[xX]"), text)) for i, text, _ in lines}
    want[500] = sorted(["given", "p6"])
    assert {r["n"]: r["tags"] for r in got.collect()} == want


def test_versions_in_any_order_leave_the_last(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"f{rng.randint(0, 30)}", rng.choice(["a", "b", None]), rng.random(), rng.choice([None, *range(50)]), rng.randint(0, 2)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "fix_id string, fix_type string, confidence double, minute int, place int").withColumn(
        "stored_ts", F.when(F.col("minute").isNotNull(), F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,minute)"))).drop("minute")
    path = landed(frame, F.col("place"), 3, "test-versions")
    versions = frame.drop("place")
    checkpoint = str(tmp_path / "store")
    with keyed_state_store(spark):
        finished(fix_store.store_fixes(one_a_trigger(spark, path, frame).drop("place"), checkpoint).trigger(availableNow=True).start())
        got = {r["fix_id"]: r for r in fix_store.stored_fixes(spark, checkpoint, versions.schema).collect()}
    newest = {}
    for r in versions.collect():
        newest.setdefault(r["fix_id"], []).append(r)
    assert set(got) == set(newest)
    for fix, held in newest.items():
        last = max((r["stored_ts"] for r in held if r["stored_ts"]), default=None)
        assert got[fix]["stored_ts"] == last and got[fix] in held
    once = versions.where("stored_ts IS NOT NULL").dropDuplicates(["fix_id", "stored_ts"])
    assert latest_fix(once).count() == sum(any(r["stored_ts"] for r in held) for held in newest.values())
    assert Counter(r["fix_id"] for r in versions.collect()).total() == 400
