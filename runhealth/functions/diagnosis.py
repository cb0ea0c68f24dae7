"""Classify why a run failed, from the text it left behind.

``classify_issue`` is the plain keyword rule. ``issue_type_of`` adds the error
signatures for text the keyword rule cannot place. They are kept apart so that
either can be used, and tested, alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from runhealth.functions.text import contains_any, last_segment, lit_array, strip, tail

# Issue types.
MEMORY = "memory_exceeded"
DISK = "disk_space_exceeded"
DEPENDENCY = "dependency_error"
UNKNOWN = "unknown"
ISSUE_TYPES = [MEMORY, DISK, DEPENDENCY, UNKNOWN]

# Keyword terms of the classifier, matched in lower case.
MEMORY_TERMS = ["oom", "out of memory", "heap space"]
DISK_TERMS = ["space", "quota"]
DEPENDENCY_TERMS = ["dependency", "module", "package", "import", "library"]

# Error signatures, matched case-sensitively.
SIGNATURES = {
    "oom": "OutOfMemoryError|GC overhead limit exceeded",
    "quota": "AZURE_QUOTA_EXCEEDED_EXCEPTION|QuotaExceeded",
    "timeout": "Connection refused|RPC timed out|unreachable during run",
    "library": "Library resolution failed",
}

# Patterns naming a package that could not be loaded.
PYTHON_PACKAGE = r"No module named '([^']+)'"
JVM_PACKAGE = r"ClassNotFoundException: ([^\n]+)"

# Aliases people use for an issue type.
ALIASES = {
    MEMORY: ["memory", "memory_error", "out_of_memory", "oom"],
    DISK: ["disk", "disk_error", "space", "storage"],
    DEPENDENCY: ["depend", "dependency", "package", "import", "library"],
}

# Confidences of the text rule, of empty logs, and of verdicts without one.
TEXT_CONFIDENCE = 0.6
EMPTY_CONFIDENCE = 0.1
VERDICT_CONFIDENCE = 0.5
MIN_USABLE_CONFIDENCE = 0.3
# Characters of log text handed on for review.
STDOUT_TAIL = 5000
STDERR_TAIL = 10000

EVIDENCE_PATTERN = "|".join(
    [f"(?:{p})" for p in SIGNATURES.values()]
    + ["No module named '", "ClassNotFoundException: "]
    + [f"(?i:{t})" for t in ["memory", *MEMORY_TERMS, "disk", "quota", *DEPENDENCY_TERMS]]
)

DETAILS = {
    MEMORY: "The logs show the run asking for more memory than it was given.",
    DISK: "The logs show the run filling the disk of its nodes.",
    DEPENDENCY: "The logs show the run missing a package it needs.",
    UNKNOWN: "The logs hold no known error signature.",
}
EMPTY_DETAILS = "The run left no log text to read."
# The library's own query to look at next, by issue type.
ADVICE = {
    MEMORY: ["data_skew on the join and grouping keys"],
    DISK: ["resource_utilisation of the run's cluster"],
    DEPENDENCY: ["missing_packages of the run's log"],
    UNKNOWN: ["tag_signatures with patterns of your own"],
}


def classify_issue(text: Column) -> Column:
    """Keyword rule, first match wins; substrings count, so ``room`` holds ``oom``."""
    low = F.lower(text)
    return (
        F.when(low.contains("memory") & contains_any(low, MEMORY_TERMS), F.lit(MEMORY))
        .when(low.contains("disk") & contains_any(low, DISK_TERMS), F.lit(DISK))
        .when(contains_any(low, DEPENDENCY_TERMS), F.lit(DEPENDENCY))
        .otherwise(F.lit(UNKNOWN))
    )


def signature_tags(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """Every pattern name found in ``text``, in pattern order."""
    named = SIGNATURES if patterns is None else patterns
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in named.items()]))


def missing_packages(stderr: Column) -> Column:
    """Python names first, then JVM class names; order and duplicates are kept."""
    python = F.regexp_extract_all(stderr, F.lit(PYTHON_PACKAGE), F.lit(1))
    jvm = F.regexp_extract_all(stderr, F.lit(JVM_PACKAGE), F.lit(1))
    return F.coalesce(F.concat(python, F.transform(jvm, last_segment)), lit_array([]))


def names_missing_package(stderr: Column) -> Column:
    return stderr.rlike(PYTHON_PACKAGE) | stderr.rlike(JVM_PACKAGE)


def issue_type_of(stderr: Column) -> Column:
    """Keyword rule on stderr, upgraded by signatures when it finds nothing."""
    keyword = classify_issue(stderr)
    return (
        F.when(keyword != UNKNOWN, keyword)
        .when(stderr.rlike(SIGNATURES["oom"]), F.lit(MEMORY))
        .when(stderr.rlike(SIGNATURES["library"]) | names_missing_package(stderr), F.lit(DEPENDENCY))
        .otherwise(F.lit(UNKNOWN))
    )


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def evidence_lines(stderr: Column) -> Column:
    """Lines that carry a signature or a classifier term."""
    lines = F.split(F.coalesce(stderr, F.lit("")), "\n")
    return F.filter(lines, lambda line: line.rlike(EVIDENCE_PATTERN))


def usable_confidence(confidence: Column, minimum: float = MIN_USABLE_CONFIDENCE) -> Column:
    return F.coalesce(confidence >= minimum, F.lit(False))


def issue_detected(issue_type: Column) -> Column:
    return F.coalesce(issue_type != UNKNOWN, F.lit(False))


def trim_logs(stdout: Column, stderr: Column) -> tuple[Column, Column]:
    """Text handed on for review: the end of a log is where a failure shows."""
    return tail(stdout, STDOUT_TAIL), tail(stderr, STDERR_TAIL)


def normalise_failure_type(name: Column) -> Column:
    """An issue type in any letter case, or null."""
    low = F.lower(name)
    return F.when(low.isin(ISSUE_TYPES), low)


def alias_failure_type(name: Column) -> Column:
    """Map a known alias to its issue type; anything else is unchanged."""
    chain = None
    for issue, aliases in ALIASES.items():
        hit = name.isin(aliases)
        chain = F.when(hit, F.lit(issue)) if chain is None else chain.when(hit, F.lit(issue))
    return chain.otherwise(name)


def message_text(entries: Column) -> Column:
    """One text from an array of log entries: each message with a newline after it."""
    kept = F.filter(entries, lambda e: e["message"].isNotNull())
    return F.array_join(F.transform(kept, lambda e: F.concat(e["message"], F.lit("\n"))), "")


# Confidence and evidence are read as text: a wrong type must not look like broken JSON.
VERDICT_SCHEMA = T.StructType([
    T.StructField("issue_type", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("root_cause", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def parse_verdict(content: Column) -> Column:
    """Read a stored analysis: a JSON object, or failing that plain text.

    ``{}`` is a valid object with every default; broken JSON is text and goes
    through the keyword rule. Null content is an analysis that never came: the
    issue is unknown, at the confidence of empty logs.
    """
    parsed = F.from_json(content, VERDICT_SCHEMA, {"mode": "PERMISSIVE"})
    is_object = content.isNotNull() & strip(content).startswith("{") & parsed["_corrupt_record"].isNull()
    return F.struct(
        F.coalesce(is_object, F.lit(False)).alias("is_json"),
        F.when(is_object, F.coalesce(parsed["issue_type"], F.lit(UNKNOWN)))
        .otherwise(classify_issue(content)).alias("issue_type"),
        F.when(is_object, F.coalesce(parsed["confidence"].try_cast("double"), F.lit(VERDICT_CONFIDENCE)))
        .otherwise(F.when(content.isNull(), F.lit(EMPTY_CONFIDENCE)).otherwise(F.lit(TEXT_CONFIDENCE)))
        .alias("confidence"),
        F.when(is_object, F.coalesce(F.from_json(parsed["evidence"], "array<string>"), lit_array([])))
        .otherwise(lit_array([])).alias("evidence"),
        F.when(is_object, F.coalesce(parsed["root_cause"], F.lit("Unknown")))
        .otherwise(F.when(content.isNull(), F.lit(EMPTY_DETAILS)).otherwise(F.lit("Extracted from plain text")))
        .alias("details"),
    )


def by_issue(issue_type: Column, values: dict[str, Column]) -> Column:
    """Pick per issue type; the value for ``unknown`` is the default."""
    chain = None
    for issue in (MEMORY, DISK, DEPENDENCY):
        hit = issue_type == issue
        chain = F.when(hit, values[issue]) if chain is None else chain.when(hit, values[issue])
    return chain.otherwise(values[UNKNOWN])


def diagnose_run(logs: DataFrame) -> DataFrame:
    """Add the diagnosis to rows with ``stdout`` and ``stderr``; one pass, no shuffle."""
    blank = is_blank(F.col("stdout")) & is_blank(F.col("stderr"))
    issue = F.col("issue_type")
    return (
        logs.withColumn("issue_type", F.when(blank, F.lit(UNKNOWN)).otherwise(issue_type_of(F.col("stderr"))))
        .withColumns({
            "confidence": F.when(blank, F.lit(EMPTY_CONFIDENCE)).otherwise(F.lit(TEXT_CONFIDENCE)),
            "issue_detected": issue_detected(issue),
            "evidence": evidence_lines(F.col("stderr")),
            "details": F.when(blank, F.lit(EMPTY_DETAILS))
            .otherwise(by_issue(issue, {k: F.lit(v) for k, v in DETAILS.items()})),
            "recommendations": by_issue(issue, {k: lit_array(v) for k, v in ADVICE.items()}),
        })
    )


def step(name: str, details: Column, result: Column) -> Column:
    return F.struct(F.lit(name).alias("step"), details.alias("details"), result.alias("result"))


def reasoning_steps(issue_type: Column, confidence: Column, evidence: Column) -> Column:
    """What each step of a diagnosis took in and gave out, in counts and values; missing values count as none."""
    lines = F.coalesce(evidence, lit_array([]))
    n = F.size(lines).cast("string")
    return F.array(
        step("log_analysis", F.concat(F.lit("lines with a sign: "), n), F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("-"))),
        step("issue_identification", F.concat(F.lit("issue="), F.coalesce(issue_type, F.lit(UNKNOWN))),
             F.concat(F.lit("confidence="), F.coalesce(confidence, F.lit(0.0)).cast("string"))),
        step("evidence_collection", F.concat(n, F.lit(" lines")), F.array_join(lines, "\n")),
    )


def with_fix_step(reasoning: Column, fix_type: Column, description: Column) -> Column:
    """Append what the remedy step chose; ``fix=-`` if it chose nothing."""
    chosen = F.coalesce(fix_type, F.lit("-"))
    details = F.when(fix_type.isNotNull(), F.coalesce(description, F.lit("-"))).otherwise(F.lit("-"))
    return F.concat(reasoning, F.array(step("fix_suggestion", details, F.concat(F.lit("fix="), chosen))))
