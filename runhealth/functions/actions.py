"""The five actions as SQL functions that return a table: JSON in, one row out, bad input in its ``error``.

Spark inlines them into the plan, so a lateral call over a table of requests is one query: lookups become
joins, the rest is projections. What a body names many times is bound by ``_once``, as inlining copies the
expression to each place. A function that looks up joins its requests with themselves, so a chain of
them should read stored requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runhealth.functions import diagnosis as dx, remedy, reporting
from runhealth.functions.sqlfuncs import _quoted, classified, register_functions

BAD_LOGS, BAD_PARAMETERS, BAD_REASONING = (f"{what} are not a JSON {kind}" for what, kind in (
    ("logs", "object"), ("parameters", "object"), ("reasoning steps", "array")))
RUNS, CLUSTERS, VERIFIED = "runhealth_runs", "runhealth_clusters", "runhealth_verified"


def _once(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _parsed(json: str, schema: str) -> str:
    return f"from_json({json}, {_quoted(schema + ', _corrupt_record STRING')})"


def _opens(json: str, opens: str = "{") -> str:
    return f"({json} IS NOT NULL AND startswith(trim(LEADING ' \\t\\n\\r' FROM {json}), {_quoted(opens)}))"


def _parsed_array(json: str, schema: str) -> str:
    return f"from_json({json}, {_quoted(f'ARRAY<STRUCT<{schema}>>')})"


def _by_issue(issue: str, values: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {_quoted(k)} THEN {v}" for k, v in values.items() if k != dx.UNKNOWN)
    return f"CASE {issue} {cases} ELSE {values[dx.UNKNOWN]} END"


_LOGS = "stdout STRING, stderr STRING"
_PARAMETERS = "memory_increment STRING, packages ARRAY<STRING>"
_STEPS = "step STRING, details STRING, result STRING"
_BLANK = "(coalesce(trim(logs.stdout), '') = '' AND coalesce(trim(logs.stderr), '') = '')"


def _packages(stderr: str) -> str:
    return (f"concat(regexp_extract_all({stderr}, {_quoted(dx.PYTHON_PACKAGE)}, 1), transform(regexp_extract_all({stderr}, "
            f"{_quoted(dx.JVM_PACKAGE)}, 1), x -> trim(BOTH ' \\t\\n\\r' FROM element_at(split(x, '[.]'), -1))))")


def _named(stderr: str) -> str:
    return f"size({_packages(stderr)}) > 0"


def _gc(stderr: str) -> str:
    return f"coalesce(contains({stderr}, {_quoted(remedy.GC_PRESSURE)}), false)"


def _issue(stderr: str) -> str:
    return _once(classified(stderr), "keyword", (
        f"CASE WHEN {stderr} IS NULL THEN {_quoted(dx.UNKNOWN)} WHEN keyword <> {_quoted(dx.UNKNOWN)} THEN keyword "
        f"WHEN {stderr} RLIKE {_quoted(dx.SIGNATURES['oom'])} THEN {_quoted(dx.MEMORY)} "
        f"WHEN {stderr} RLIKE {_quoted(dx.SIGNATURES['library'])} OR {_named(stderr)} THEN {_quoted(dx.DEPENDENCY)} ELSE {_quoted(dx.UNKNOWN)} END"))


def _fix_confidence(issue: str, stderr: str) -> str:
    return _by_issue(issue, {
        dx.MEMORY: f"CASE WHEN {_gc(stderr)} THEN {remedy.GC_CONFIDENCE}D ELSE {remedy.BASE_CONFIDENCE[dx.MEMORY]}D END",
        dx.DISK: f"{remedy.BASE_CONFIDENCE[dx.DISK]}D",
        dx.DEPENDENCY: f"CASE WHEN {_named(stderr)} THEN {remedy.NAMED_PACKAGES_CONFIDENCE}D ELSE {remedy.BASE_CONFIDENCE[dx.DEPENDENCY]}D END",
        dx.UNKNOWN: f"{remedy.BASE_CONFIDENCE[dx.UNKNOWN]}D"})


def _fix_parameters(issue: str, stderr: str) -> str:
    increment = f"CASE WHEN {_gc(stderr)} THEN '100%' ELSE {_quoted(remedy.DEFAULT_INCREMENT)} END"
    return _by_issue(issue, {
        dx.MEMORY: f"to_json(named_struct('memory_increment', {increment}))",
        dx.DISK: f"to_json(named_struct('disk_increment', {_quoted(remedy.DISK_INCREMENT)}))",
        dx.DEPENDENCY: f"to_json(named_struct('packages', coalesce({_packages(stderr)}, array())))",
        dx.UNKNOWN: "'{}'"})


def _scalars() -> dict[str, str]:
    return {
        "runhealth_packages(stderr STRING) RETURNS ARRAY<STRING>": f"coalesce({_packages('stderr')}, array())",
        "runhealth_issue(stderr STRING) RETURNS STRING": _issue("stderr"),
        "runhealth_fix_confidence(issue_type STRING, stderr STRING) RETURNS DOUBLE": _fix_confidence("issue_type", "stderr"),
        "runhealth_fix_parameters(issue_type STRING, stderr STRING) RETURNS STRING": _fix_parameters("issue_type", "stderr"),
        "runhealth_run_facts(for_run BIGINT) RETURNS STRUCT<cluster_id BIGINT, workers INT, n_runs BIGINT, n_clusters BIGINT>":
            f"(SELECT named_struct('cluster_id', max(r.cluster_id), 'workers', max(c.num_workers), 'n_runs', count(r.run_id), "
            f"'n_clusters', count(c.cluster_id)) FROM {RUNS} r LEFT JOIN {CLUSTERS} c ON r.cluster_id = c.cluster_id WHERE r.run_id = for_run)",
    }


def _tables() -> dict[str, str]:
    def of_logs(good: str, bad: str = "NULL") -> str:
        """A value of the parsed ``logs``, and another where the text is no JSON object."""
        return _once(_parsed("logs_json", _LOGS), "logs", f"IF({_opens('logs_json')} AND logs._corrupt_record IS NULL, {good}, {bad})")

    def of_issue(good: str) -> str:
        return of_logs(_once("issue_type", "issue", good))

    issue = f"CASE WHEN {_BLANK} THEN {_quoted(dx.UNKNOWN)} ELSE {_issue('logs.stderr')} END"
    grows, installs = "fix_type = 'increase_memory'", "fix_type = 'install_dependencies'"
    known = f"fix_type IN ({', '.join(map(_quoted, dict.fromkeys(remedy.FIX_TYPES.values())))})"
    problem = (
        f"CASE WHEN NOT ({_opens('parameters_json')} AND p._corrupt_record IS NULL) THEN {_quoted(BAD_PARAMETERS)} WHEN run.n_runs = 0 THEN 'Run not found' "
        f"WHEN run.cluster_id IS NULL THEN 'Run names no cluster' "
        f"WHEN run.n_clusters = 0 THEN 'Cluster not found' WHEN {installs} AND coalesce(size(p.packages), 0) <= 0 THEN 'No packages to install' "
        f"WHEN NOT coalesce({known}, false) THEN concat('Unsupported fix type: ', coalesce(fix_type, 'none')) END")
    percent = f"coalesce(try_cast(replace(coalesce(p.memory_increment, {_quoted(remedy.DEFAULT_INCREMENT)}), '%', '') AS DOUBLE), 50D)"
    guidance = {name: _by_issue("issue_type", {k: _quoted(v) for k, v in values.items()})
                for name, values in (("root_cause", reporting.ROOT_CAUSE), ("outcome", reporting.OUTCOME))}
    steps = "array_join(transform(steps, s -> concat('- ', s.step, ': ', coalesce(s.result, '-'))), '\\n')"

    def of_steps(good: str, bad: str = "NULL") -> str:
        return _once(_parsed_array("reasoning_json", _STEPS), "steps", f"IF({_opens('reasoning_json', '[')} AND steps IS NOT NULL, {good}, {bad})")

    return {
        "diagnose_logs(logs_json STRING) RETURNS TABLE(issue_type STRING, confidence DOUBLE, issue_detected BOOLEAN, error STRING)":
            f"SELECT {of_logs(issue)}, {of_logs(f'IF({_BLANK}, {dx.EMPTY_CONFIDENCE}D, {dx.TEXT_CONFIDENCE}D)')}, "
            f"{of_logs(f'({issue}) <> {_quoted(dx.UNKNOWN)}')}, {of_logs('NULL', _quoted(BAD_LOGS))}",
        "suggest_fix_for(issue_type STRING, logs_json STRING) RETURNS TABLE(fix_type STRING, parameters STRING, fix_confidence DOUBLE, error STRING)":
            f"SELECT {of_issue(_by_issue('issue', {k: _quoted(v) for k, v in remedy.FIX_TYPES.items()}))}, "
            f"{of_issue(_fix_parameters('issue', 'logs.stderr'))}, "
            f"{of_issue(_fix_confidence('issue', 'logs.stderr'))}, {of_logs('NULL', _quoted(BAD_LOGS))}",
        # The lookup is a scalar subquery on the run alone: as part of this body it would meet every distinct fix type and parameters.
        "apply_fix(for_run BIGINT, fix_type STRING, parameters_json STRING) RETURNS TABLE(cluster_id BIGINT, target_workers INT, payload STRING, error STRING)":
            f"SELECT run.cluster_id, IF(problem IS NULL AND {grows}, CAST(coalesce(run.workers, {remedy.DEFAULT_WORKERS}) * (1D + {percent} / 100D) AS INT), NULL), "
            f"IF(problem IS NULL AND {installs}, to_json(transform(p.packages, x -> named_struct('pypi', named_struct('package', x)))), NULL), problem "
            f"FROM (SELECT *, {problem} AS problem FROM (SELECT runhealth_run_facts(for_run) AS run, {_parsed('parameters_json', _PARAMETERS)} AS p))",
        "verify_fix(for_run BIGINT) RETURNS TABLE(outcome STRING, next_run_id BIGINT, next_status STRING, error STRING)":
            f"SELECT max(v.outcome), max(v.next_run_id), max(v.next_status), IF(count(v.run_id) = 0, 'No fix to verify', NULL) "
            f"FROM {VERIFIED} v WHERE v.run_id = for_run",
        "report_for(issue_type STRING, reasoning_json STRING, fix_successful BOOLEAN) RETURNS TABLE(report STRING, error STRING)":
            "SELECT " + of_steps(
                f"concat('# ', IF(coalesce(fix_successful, false), {_quoted(reporting.HEADLINE_OK)}, {_quoted(reporting.HEADLINE_FAILED)}), "
                f"'\\n\\n', {guidance['root_cause']}, '\\n\\n', {steps}, '\\n\\n', IF(coalesce(fix_successful, false), {guidance['outcome']}, "
                f"{_quoted(reporting.NOT_RESOLVED)}))") + ", " + of_steps("NULL", _quoted(BAD_REASONING)),
    }


def register_actions(spark: SparkSession, runs: DataFrame, clusters: DataFrame, verified: DataFrame) -> None:
    """Define the actions for this session over ``runs`` (run_id cluster_id), ``clusters`` (cluster_id num_workers) and
    ``verified`` (run_id outcome next_run_id next_status), a row per fixed run."""
    register_functions(spark)
    for name, df in ((RUNS, runs.select("run_id", "cluster_id")), (CLUSTERS, clusters.select("cluster_id", "num_workers")),
                     (VERIFIED, verified.select("run_id", "outcome", "next_run_id", "next_status"))):
        df.createOrReplaceTempView(name)
    for head, body in [*_scalars().items(), *_tables().items()]:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
