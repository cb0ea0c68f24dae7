"""The scalar rules as SQL functions, and the JSON-in, JSON-out actions.

SQL functions are inlined into the plan, so filters on them still push down and
stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from runhealth.functions import diagnosis as dx, intent, remedy, reporting
from runhealth.functions.text import once, strip


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _has_any(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_quoted(t)})" for t in terms) + ")"


def classified(text: str) -> str:
    """The keyword rule over a SQL expression."""
    low = f"lower({text})"
    return (f"CASE WHEN contains({low}, 'memory') AND {_has_any(low, dx.MEMORY_TERMS)} THEN {_quoted(dx.MEMORY)} "
            f"WHEN contains({low}, 'disk') AND {_has_any(low, dx.DISK_TERMS)} THEN {_quoted(dx.DISK)} "
            f"WHEN {_has_any(low, dx.DEPENDENCY_TERMS)} THEN {_quoted(dx.DEPENDENCY)} ELSE {_quoted(dx.UNKNOWN)} END")


def _definitions() -> dict[str, str]:
    aliases = " ".join(
        f"WHEN name IN ({', '.join(map(_quoted, names))}) THEN {_quoted(issue)}" for issue, names in dx.ALIASES.items())

    def group(pattern: str) -> str:
        return f"nullif(regexp_extract(body, {_quoted(pattern)}, 1), '')"
    return {
        "classify_issue(body STRING) RETURNS STRING":
            classified("body"),
        "confidence_band(confidence DOUBLE) RETURNS STRING":
            f"CASE WHEN confidence * 100 >= {reporting.HIGH} THEN 'high' "
            f"WHEN confidence * 100 >= {reporting.MODERATE} THEN 'moderate' "
            "WHEN confidence * 100 > 0 THEN 'low' ELSE 'unavailable' END",
        "alias_failure_type(name STRING) RETURNS STRING": f"CASE {aliases} ELSE name END",
        "parse_job_id(body STRING) RETURNS STRING":
            f"coalesce({group(intent.MONITOR)}, "
            f"concat('job_', coalesce({group(intent.CHECK)}, {group(intent.JOB)})))",
    }


def register_functions(spark: SparkSession) -> None:
    """Define the SQL functions for this session."""
    for head, body in _definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def _logs_struct(logs_json: Column) -> Column:
    return F.from_json(logs_json, "stdout string, stderr string, _corrupt_record string", {"mode": "PERMISSIVE"})


def _is_bad(logs_json: Column, parsed: Column) -> Column:
    bad = logs_json.isNull() | ~strip(logs_json).startswith("{") | parsed["_corrupt_record"].isNotNull()
    return F.coalesce(bad, F.lit(True))


def _error(text: str) -> Column:
    return F.to_json(F.struct(F.lit(text).alias("error")))


def diagnose_json(logs_json: Column) -> Column:
    """Diagnose logs given as ``{"stdout": .., "stderr": ..}``; bad input gives ``{"error": ..}``."""
    def answer(logs: Column) -> Column:
        stderr = logs["stderr"]
        blank = dx.is_blank(logs["stdout"]) & dx.is_blank(stderr)
        issue = F.when(blank, F.lit(dx.UNKNOWN)).otherwise(dx.issue_type_of(stderr))
        found = once(issue, lambda issue: F.struct(
            issue.alias("issue_type"),
            F.when(blank, F.lit(dx.EMPTY_CONFIDENCE)).otherwise(F.lit(dx.TEXT_CONFIDENCE)).alias("confidence"),
            dx.issue_detected(issue).alias("issue_detected"),
            dx.evidence_lines(stderr).alias("evidence"),
        ))
        return F.when(_is_bad(logs_json, logs), _error("logs are not a JSON object")).otherwise(F.to_json(found))
    return once(_logs_struct(logs_json), answer)


def suggest_fix_json(issue_type: Column, logs_json: Column) -> Column:
    """The remedy for an issue and its logs, as JSON; bad input gives ``{"error": ..}``."""
    def answer(logs: Column) -> Column:
        found = once(issue_type, lambda issue: F.to_json(remedy.suggest_fix(issue, logs["stderr"])))
        return F.when(_is_bad(logs_json, logs), _error("logs are not a JSON object")).otherwise(found)
    return once(_logs_struct(logs_json), answer)
