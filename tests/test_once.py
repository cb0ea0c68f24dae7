"""What the JSON and SQL actions name many times is computed once a row, and lookups meet no product of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from runhealth.functions import actions, diagnosis as dx, sqlfuncs
from runhealth.functions.text import once

LOGS = [(1, '{"stdout": "a", "stderr": "No module named \'x.y\'\\nmemory"}'), (2, '{"stderr": "GC overhead limit exceeded"}'),
        (3, "{not json"), (4, None), (5, '{"stdout": "", "stderr": ""}'), (6, " {\"stderr\": \"disk space low\"}"), (7, "[1]")]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def answers(spark):
    logs = spark.createDataFrame(LOGS, "id int, logs string").repartition(1)
    stderr = F.get_json_object("logs", "$.stderr")
    fixed = logs.select("id", sqlfuncs.suggest_fix_json(once(stderr, dx.issue_type_of), F.col("logs")).alias("answer"))
    return fixed, logs.select("id", sqlfuncs.diagnose_json(F.col("logs")).alias("answer"))


def test_json_actions_read_their_logs_once(spark):
    fixed, diagnosed = answers(spark)
    assert plan_of(fixed).count("get_json_object(") == 1
    assert plan_of(fixed).count("from_json(") == 1 and plan_of(diagnosed).count("from_json(") == 1


def test_json_actions_answer_as_before(spark):
    fixed, diagnosed = ({r["id"]: r["answer"] for r in df.collect()} for df in answers(spark))
    bad = '{"error":"logs are not a JSON object"}'
    assert [fixed[i] for i in (3, 4, 7)] == [bad] * 3 == [diagnosed[i] for i in (3, 4, 7)]
    issues = {i: next((k for k in dx.ISSUE_TYPES if f'"issue_type":"{k}"' in diagnosed[i]), None) for i in diagnosed}
    assert issues == {1: dx.DEPENDENCY, 2: dx.MEMORY, 3: None, 4: None, 5: dx.UNKNOWN, 6: dx.DISK, 7: None}
    assert '"packages":["x.y"]' in fixed[1] and '"fix_confidence":0.9' in fixed[2] and "increase_disk_space" in fixed[6]
    assert '"confidence":0.1' in diagnosed[5] and '"evidence":["disk space low"]' in diagnosed[6]


def acted(spark):
    runs = spark.createDataFrame([(1, 10), (2, 20), (3, None), (4, 99), (5, 10), (5, 10)], "run_id bigint, cluster_id bigint")
    clusters = spark.createDataFrame([(10, 3), (20, None)], "cluster_id bigint, num_workers int")
    verified = spark.createDataFrame([(1, "success", 7, "SUCCESS"), (2, "failed", 8, "FAILED")],
                                     "run_id bigint, outcome string, next_run_id bigint, next_status string")
    actions.register_actions(spark, runs, clusters, verified)
    more, packages = '{"memory_increment": "100%"}', '{"packages": ["x.y", "z"]}'
    asked = spark.createDataFrame(
        [(1, "increase_memory", more), (1, "increase_memory", more), (2, "increase_memory", "{}"), (3, "increase_memory", "{}"),
         (4, "increase_memory", "{}"), (5, "install_dependencies", packages), (5, "install_dependencies", "{}"), (9, "increase_memory", "{}"),
         (None, "increase_memory", "{}"), (1, None, "{}"), (2, "dance", "{}"), (1, "increase_memory", None), (2, "restart_cluster", "{broken")],
        "run_id bigint, fix_type string, parameters string")
    return spark.sql("SELECT q.*, a.* FROM {asked} q, LATERAL apply_fix(q.run_id, q.fix_type, q.parameters) a", asked=asked)


def test_apply_fix_answers_every_request(spark):
    got = sorted((tuple(r) for r in acted(spark).collect()), key=str)
    payload, bad = '[{"pypi":{"package":"x.y"}},{"pypi":{"package":"z"}}]', "parameters are not a JSON object"
    assert got == sorted([
        (1, "increase_memory", '{"memory_increment": "100%"}', 10, 6, None, None), (1, "increase_memory", '{"memory_increment": "100%"}', 10, 6, None, None),
        (2, "increase_memory", "{}", 20, 1, None, None), (3, "increase_memory", "{}", None, None, None, "Run names no cluster"),
        (4, "increase_memory", "{}", 99, None, None, "Cluster not found"), (5, "install_dependencies", '{"packages": ["x.y", "z"]}', 10, None, payload, None),
        (5, "install_dependencies", "{}", 10, None, None, "No packages to install"), (9, "increase_memory", "{}", None, None, None, "Run not found"),
        (None, "increase_memory", "{}", None, None, None, "Run not found"), (1, None, "{}", 10, None, None, "Unsupported fix type: none"),
        (2, "dance", "{}", 20, None, None, "Unsupported fix type: dance"), (1, "increase_memory", None, 10, None, None, bad),
        (2, "restart_cluster", "{broken", 20, None, None, bad)], key=str)


def test_apply_fix_makes_no_product_of_runs_and_parameters(spark):
    plan = acted(spark)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_sql_actions_read_their_logs_once_a_column(spark):
    acted(spark)
    logs = spark.createDataFrame(LOGS, "id int, logs string").repartition(1)
    found = spark.sql("SELECT q.id, d.issue_type, d.error, s.fix_type, s.parameters, s.fix_confidence FROM {logs} q, "
                      "LATERAL diagnose_logs(q.logs) d, LATERAL suggest_fix_for(d.issue_type, q.logs) s", logs=logs)
    # One for each of the five columns; Spark may or may not copy the issue into the three that read it.
    assert plan_of(found).count("from_json(") <= 5 + 3
    got = {r["id"]: r for r in found.collect()}
    assert {i: r["issue_type"] for i, r in got.items()} == {1: dx.DEPENDENCY, 2: dx.MEMORY, 3: None, 4: None, 5: dx.UNKNOWN, 6: dx.DISK, 7: None}
    assert [i for i, r in sorted(got.items()) if r["error"] == "logs are not a JSON object"] == [3, 4, 7]
    assert got[1]["parameters"] == '{"packages":["x.y"]}' and got[2]["fix_confidence"] == 0.9
    sure = spark.sql("SELECT q.id, d.confidence, d.issue_detected FROM {logs} q, LATERAL diagnose_logs(q.logs) d", logs=logs)
    assert {r["id"]: (r[1], r[2]) for r in sure.collect() if r["id"] in (3, 5, 6)} == {3: (None, None), 5: (0.1, False), 6: (0.6, True)}
