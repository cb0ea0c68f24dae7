"""Every query over the test tables, by name. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runhealth.functions import actions, diagnosis as dx, guards, intent, remedy, reporting, sqlfuncs, text
from runhealth.operators import chat, health, history, inventory, lookups, metrics, patterns, sketches, verify
from runhealth.plans import incident
from runhealth.plans.bindings import FAILURE_NAMES, LOGGER, Tables, pick
from runhealth.sources import logfiles, logtext, readers, sinks
from runhealth.streaming import approvals as approvals_live, fix_store, follow, growing, ledger, verify as verify_live
from runhealth.streaming.scratch import finished, keyed_state_store, landed, one_a_trigger, run_available, shared_folder, stored

Query = Callable[[Tables], DataFrame]
_QUERIES: dict[str, Query] = {}

# Order dates are whole days, so checks on them wait days, not minutes.
DAY_SCALE_TIMEOUT = 200 * verify.DAY
# Streams read the orders in this many landings; within them rows are this many days out of order.
LANDINGS, SCRAMBLED_DAYS = 6, 30
# Runs a task takes where each run's logs are made and read with many patterns.
LOG_ROWS_A_TASK = 20_000


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, path, fn=fn: fn(Tables(spark, path))) for name, fn in _QUERIES.items()}


def joined(column: str, separator: str = "|"):
    return F.array_join(column, separator).alias(column)


# -- sources and sinks ---------------------------------------------------------------

@query
def parse_log_lines(t: Tables) -> DataFrame:
    return logtext.parse_log_lines(t.log_text).drop("value")


@query
def assemble_records(t: Tables) -> DataFrame:
    return logtext.assemble_records(t.log_text)


@query
def read_log_files(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "logs")
    t.log_records.select("record").write.option("maxRecordsPerFile", 20_000).text(path)
    return logfiles.read_log_files(t.spark, path, "part-").select("ts", "level", "logger", "message")


def _export(df: DataFrame, purpose: str) -> str:
    path = shared_folder(df.sparkSession, purpose)
    df.write.json(path)
    return path


@query
def read_runs(t: Tables) -> DataFrame:
    exported = t.runs.join(t.run_logs, "run_id", "left").select(
        F.col("job_id").cast("string"), F.col("run_id").cast("string"), "run_name",
        F.col("cluster_id").cast("string"), "status", text.epoch_millis(F.col("start_ts")).alias("start_time"),
        text.epoch_millis(F.col("end_ts")).alias("end_time"), F.struct("stdout", "stderr").alias("logs"))
    read = readers.read_runs(t.spark, _export(exported, "runs"))
    return read.select("run_id", "job_id", "run_name", "cluster_id", "status", "duration_seconds", "stdout", "stderr")


@query
def read_jobs(t: Tables) -> DataFrame:
    exported = t.jobs.select(F.col("job_id").cast("string"), F.col("creator").alias("creator_user_name"),
                             text.epoch_millis(F.col("created_time")).alias("created_time"), "settings")
    return inventory.list_jobs(readers.read_jobs(t.spark, _export(exported, "jobs"))).select(
        "job_id", "name", "creator", F.unix_millis("created_time").alias("created_millis"), "schedule")


@query
def read_clusters(t: Tables) -> DataFrame:
    exported = t.clusters.select(
        F.col("cluster_id").cast("string"), F.col("name").alias("cluster_name"), "state",
        F.col("creator").alias("creator_user_name"), F.col("node_type").alias("node_type_id"),
        F.col("runtime").alias("spark_version"), "num_workers", "spark_conf")
    read = readers.read_clusters(t.spark, _export(exported, "clusters"))
    return read.select("cluster_id", "name", "state", "creator", "node_type", "runtime", "num_workers",
                       text.rendered_map(F.col("spark_conf")).alias("spark_conf"))


@query
def read_activity(t: Tables) -> DataFrame:
    exported = t.activity.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                                 "action_type", "user_name")
    read = readers.read_activity(t.spark, _export(exported, "activity"))
    return read.select(F.date_format("ts", text.LOG_TIME_FORMAT).alias("ts"), "action_type", "user_name")


@query
def read_log_entries(t: Tables) -> DataFrame:
    exported = t.logs.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "log_type",
                             F.col("cluster_id").cast("string"), "user", "message", "level", "source")
    read = readers.read_log_entries(t.spark, _export(exported, "log-entries"))
    return read.select(F.date_format("ts", text.LOG_TIME_FORMAT).alias("ts"), "log_type", "cluster_id", "user", "level", "source", "message")


@query
def read_cluster_events(t: Tables) -> DataFrame:
    exported = t.cluster_events.select(F.col("cluster_id").cast("string"),
                                       text.epoch_millis(F.col("ts")).alias("timestamp"), "type", "details")
    read = readers.read_cluster_events(t.spark, _export(exported, "cluster-events"))
    return read.select("cluster_id", F.unix_millis("ts").alias("ts_millis"), "type", "details")


@query
def read_api_calls(t: Tables) -> DataFrame:
    exported = t.api_calls.select((text.epoch_millis(F.col("ts")) / 1000).alias("timestamp"), "operation", "success",
                                  "parameters", "result_size", "duration_seconds", "error")
    read = readers.read_api_calls(t.spark, _export(exported, "api-calls"))
    return read.select("operation", "success", text.rendered_map(F.col("parameters")).alias("parameters"),
                       "result_size", "duration_seconds", F.col("error.type").alias("error_type"))


@query
def fetch_status(t: Tables) -> DataFrame:
    asked = lookups.resolve_request(t.requests, t.runs).select("job_id", F.col("resolved_run_id").alias("run_id"))
    return lookups.fetch_status(asked, t.runs, t.run_logs)


@query
def latest_fix(t: Tables) -> DataFrame:
    """Two versions of every fix are stored; ids that were never stored read as null."""
    path = shared_folder(t.spark, "fixes")
    versions = t.suggestions.select("fix_id", "job_id", "fix_type", F.col("fix_confidence").alias("confidence"),
                                    F.col("start_ts").alias("stored_ts"))
    sinks.write_fix_store(versions, path)
    sinks.write_fix_store(versions.withColumn("stored_ts", F.col("stored_ts") + F.expr("INTERVAL 1 HOUR"))
                          .withColumn("confidence", F.col("confidence") / 2), path)
    return sinks.get_fixes(t.approvals.select("fix_id"), t.spark.read.parquet(path))


@query
def latest_fix_stream(t: Tables) -> DataFrame:
    """The same two versions, stored by a stream over three triggers in no order, read back from its state."""
    versions = t.suggestions.select("fix_id", "job_id", "fix_type", F.col("fix_confidence").alias("confidence"),
                                    F.col("start_ts").alias("stored_ts"))
    later = versions.withColumn("stored_ts", F.col("stored_ts") + F.expr("INTERVAL 1 HOUR")).withColumn("confidence", F.col("confidence") / 2)
    both = versions.unionByName(later)
    path = landed(both, F.pmod(F.xxhash64("fix_id", "stored_ts"), F.lit(3)), 3, "versions")
    checkpoint = shared_folder(t.spark, "fix-store")
    with keyed_state_store(t.spark):
        finished(fix_store.store_fixes(one_a_trigger(t.spark, path, both), checkpoint).trigger(availableNow=True).start())
        return fix_store.stored_fixes(t.spark, checkpoint, both.schema)


@query
def write_history(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "history")
    analyses = t.suggestions.select("run_id", "job_id", F.col("start_ts").alias("ts"), "issue_type", "confidence")
    sinks.write_history(analyses, path, period="year")
    sinks.write_history(analyses, path, period="year")
    return sinks.read_history(t.spark, path).drop("dt")


@query
def write_reports(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "reports")
    reports = render_report(t).select("run_id", "start_ts", "report")
    sinks.write_reports(reports, path, period="year")
    return t.spark.read.parquet(path).drop("dt")


# -- listings and filters ---------------------------------------------------------------

@query
def list_clusters(t: Tables) -> DataFrame:
    return inventory.list_clusters(t.clusters)


@query
def cluster_details(t: Tables) -> DataFrame:
    ids = t.table("part").select(F.col("p_partkey").alias("cluster_id"))
    return inventory.cluster_details(ids, t.clusters).drop("spark_conf")


@query
def list_jobs(t: Tables) -> DataFrame:
    return inventory.list_jobs(t.jobs).drop("created_time")


@query
def list_jobs_by_name(t: Tables) -> DataFrame:
    return inventory.list_jobs(t.jobs, name="Customer#000000042", limit=50).drop("created_time")


@query
def list_runs(t: Tables) -> DataFrame:
    return inventory.list_runs(t.runs)


@query
def list_runs_active(t: Tables) -> DataFrame:
    return inventory.list_runs(t.runs, active_only=True)


@query
def list_runs_page(t: Tables) -> DataFrame:
    return inventory.list_runs(t.runs, completed_only=True, limit=25, offset=25)


@query
def filter_logs(t: Tables) -> DataFrame:
    return inventory.filter_logs(t.logs, log_type="stderr", days=7)


@query
def filter_logs_oldest(t: Tables) -> DataFrame:
    return inventory.filter_logs(t.logs, cluster_id=7, log_type=None, days=None, limit=100)


@query
def cluster_events(t: Tables) -> DataFrame:
    return inventory.cluster_events(
        t.cluster_events, cluster_id=5, start="2024-01-05 00:00:00", end="2024-01-20 00:00:00")


@query
def lookback(t: Tables) -> DataFrame:
    return inventory.lookback(t.activity, "ts", 7)


@query
def level_at_least(t: Tables) -> DataFrame:
    return inventory.level_at_least(t.logs, "warning").select("event_id", "level", "log_type")


@query
def issue_detected(t: Tables) -> DataFrame:
    return t.suggestions.select("run_id", "issue_type", "issue_detected")


@query
def state_lines(t: Tables) -> DataFrame:
    return logtext.state_lines(t.state_log).select("file", "line_no", "ts", "state")


@query
def running_only(t: Tables) -> DataFrame:
    return inventory.running_only(t.clusters.select("cluster_id", "state"))


@query
def redact(t: Tables) -> DataFrame:
    kept = metrics.redact_parameters(t.api_calls)
    return kept.select("call_id", text.rendered_map(F.col("parameters")).alias("parameters"))


@query
def route_by_success(t: Tables) -> DataFrame:
    return metrics.route_by_success(t.api_calls).select("call_id", "operation", "stream")


@query
def input_guard(t: Tables) -> DataFrame:
    return t.chat.withColumn("g", guards.input_guard(F.col("text"))).select("conv_id", "turn", "g.*")


@query
def output_guard(t: Tables) -> DataFrame:
    return t.verdicts.withColumn("g", guards.output_guard(F.col("content"))).select("doc_id", "g.*")


@query
def confidence_in_range(t: Tables) -> DataFrame:
    scaled = t.table("labels").select("doc_id", (F.col("quality") + F.col("toxic") * 0.5 - 0.25).alias("confidence"))
    return scaled.withColumn("accepted", guards.confidence_in_range(F.col("confidence")))


@query
def usable_confidence(t: Tables) -> DataFrame:
    return t.suggestions.select("run_id", "confidence", dx.usable_confidence(F.col("confidence")).alias("usable"))


# -- joins -------------------------------------------------------------------------------

@query
def runs_with_logs(t: Tables) -> DataFrame:
    return lookups.runs_with_logs(t.runs, t.run_logs).select("run_id", "job_id", "status", "stdout", "stderr")


@query
def resolve_request(t: Tables) -> DataFrame:
    return lookups.resolve_request(t.requests, t.runs)


@query
def run_cluster(t: Tables) -> DataFrame:
    placed = lookups.run_cluster(t.suggestions.drop("cluster_id"), t.runs, t.clusters)
    return placed.select("run_id", "cluster_id", "num_workers", "cluster_state", "problem")


@query
def attach_fix(t: Tables) -> DataFrame:
    out = lookups.attach_fix(t.suggestions.select("run_id", "issue_type"))
    return out.select("run_id", "issue_type", "fix_type", "base_confidence", joined("required_permissions"), "estimated_time")


@query
def attach_guidance(t: Tables) -> DataFrame:
    out = lookups.attach_guidance(t.suggestions.select("run_id", "issue_type"))
    return out.select("run_id", "issue_type", "root_cause", "outcome", joined("recommendations"))


@query
def tag_signatures(t: Tables) -> DataFrame:
    return lookups.tag_signatures(t.logs).select("event_id", joined("tags"))


@query
def tag_pattern_table(t: Tables) -> DataFrame:
    """Two patterns a customer and one for all, over the user turns."""
    job = F.col("c_custkey").cast("string")
    customers = t.table("customer")
    table = customers.select(F.concat(F.lit("job-"), job).alias("name"), F.concat(F.lit("job_"), job, F.lit(r"\b")).alias("pattern")) \
        .unionByName(customers.select(F.concat(F.lit("check-"), job).alias("name"), F.concat(F.lit("(?i)CHECK JOB "), job, F.lit("$")).alias("pattern"))) \
        .unionByName(t.spark.createDataFrame([("answer", "(?i)yes|approve")], "name string, pattern string"))
    turns = t.chat.where(F.col("role") == "user")
    return patterns.tag_patterns(turns, table, ["conv_id", "turn"], "text").select("conv_id", "turn", joined("tags"))


@query
def tag_own_signatures(t: Tables) -> DataFrame:
    own = {"heap": "heap|Memory", "disk": "[Dd]isk", "missing": "No module|ClassNotFound"}
    return lookups.tag_signatures(t.run_logs, "stderr", own).select("run_id", joined("tags"))


@query
def approved_fixes(t: Tables) -> DataFrame:
    return lookups.approved_fixes(t.suggestions.select("fix_id", "job_id", "run_id", "fix_type"), t.approvals)


@query
def orphan_approvals(t: Tables) -> DataFrame:
    return lookups.orphan_approvals(t.approvals, t.suggestions).select("fix_id", "job_id", "decision")


@query
def verify_next_run(t: Tables) -> DataFrame:
    return verify.verify_next_run(t.fixes, t.issue_runs, DAY_SCALE_TIMEOUT).select(
        "fix_id", "job_id", "fix_ts", "issue_type", "next_run_id", "next_status", "execution_time_seconds", "outcome",
        "issue_resolved", "previous_issue_detected", "failure_reason")


@query
def previous_issue(t: Tables) -> DataFrame:
    return verify.previous_issue(t.issue_runs)


# -- aggregations ----------------------------------------------------------------------------

@query
def workspace_status(t: Tables) -> DataFrame:
    return health.workspace_status(t.clusters, t.objects)


@query
def activity_summary(t: Tables) -> DataFrame:
    return health.activity_summary(t.activity)


@query
def activity_digest(t: Tables) -> DataFrame:
    return health.activity_digest(t.activity)


@query
def job_health(t: Tables) -> DataFrame:
    return health.job_health(t.runs)


@query
def job_health_by_job(t: Tables) -> DataFrame:
    return health.job_health(t.runs, ["job_id"])


@query
def cluster_health(t: Tables) -> DataFrame:
    return health.cluster_health(t.clusters)


@query
def health_rollup(t: Tables) -> DataFrame:
    return health.health_rollup(t.runs, t.clusters)


@query
def issue_summary(t: Tables) -> DataFrame:
    checked = verify.verify_next_run(t.fixes, t.issue_runs, DAY_SCALE_TIMEOUT)
    return health.issue_summary(checked.select("issue_type", "confidence", "outcome", "job_id"))


@query
def issue_jobs_by_day(t: Tables) -> DataFrame:
    """Issues and distinct jobs from stored days of sketches, and whether the estimate is within four standard errors."""
    path = shared_folder(t.spark, "issue-days")
    sketches.store_days(sketches.daily_distinct(t.fixes, "fix_ts", ["issue_type"], "job_id"), path)
    found = sketches.distinct_over(sketches.read_days(t.spark, path), ["issue_type"])
    exact = t.fixes.groupBy("issue_type").agg(F.count_distinct("job_id").alias("jobs"))
    off = F.abs(F.col("distinct_values") - F.col("jobs")) <= F.greatest(F.lit(1.0), 4 * sketches.DISTINCT_ERROR * F.col("jobs"))
    return found.join(exact, "issue_type").select("issue_type", F.col("rows").alias("issues"), off.alias("within_bound"))


@query
def confidence_histogram(t: Tables) -> DataFrame:
    return health.confidence_histogram(t.suggestions, "fix_confidence")


SKEW_COLUMNS = [("lineitem", "l_suppkey"), ("orders", "o_custkey"), ("events", "user_id"), ("documents", "source"),
                ("documents", "lang"), ("pages", "url")]


@query
def data_skew(t: Tables) -> DataFrame:
    parts = [metrics.data_skew(t.table(name), column).withColumn("checked", F.lit(f"{name}.{column}"))
             for name, column in SKEW_COLUMNS]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query
def top_keys(t: Tables) -> DataFrame:
    return metrics.top_keys(t.table("orders"), "o_custkey", 10)


@query
def heaviest_keys(t: Tables) -> DataFrame:
    """The ten largest keys of each skew column, through counts of hash buckets."""
    parts = [sketches.heaviest_keys(t.table(name), column).select(
        F.lit(f"{name}.{column}").alias("checked"), F.col("key").cast("string").alias("key"), "rows") for name, column in SKEW_COLUMNS]
    return reduce(DataFrame.unionByName, parts)


@query
def resource_utilisation(t: Tables) -> DataFrame:
    return metrics.resource_utilisation(t.metrics, t.clusters)


@query
def api_call_stats(t: Tables) -> DataFrame:
    return metrics.api_call_stats(t.api_calls)


@query
def api_errors(t: Tables) -> DataFrame:
    return metrics.api_errors(t.api_calls)


@query
def response_latency(t: Tables) -> DataFrame:
    return metrics.response_latency(t.api_calls)


LATENCY_RANKS = (0.5, 0.9, 0.99)


@query
def latency_percentiles(t: Tables) -> DataFrame:
    """Latency per operation from stored days of sketches: calls, and whether each percentile's true rank is near enough."""
    path = shared_folder(t.spark, "latency-days")
    calls = t.api_calls
    sketches.store_days(sketches.daily_quantiles(calls, "ts", ["operation"], "duration_seconds"), path)
    found = sketches.quantiles_over(sketches.read_days(t.spark, path), ["operation"], LATENCY_RANKS)
    value, n = F.col("duration_seconds"), F.count("duration_seconds")
    near = [((F.count_if(value < F.col(name)) / n <= r + sketches.RANK_ERROR) & (F.count_if(value <= F.col(name)) / n >= r - sketches.RANK_ERROR)
             ).alias(f"{name}_near") for r in LATENCY_RANKS for name in [f"p{round(r * 100)}"]]
    return calls.join(F.broadcast(found), "operation").groupBy("operation").agg(F.first("rows").alias("calls"), *near)


@query
def entry_counts(t: Tables) -> DataFrame:
    return health.entry_counts(t.logs)


@query
def fix_effectiveness(t: Tables) -> DataFrame:
    numbered = verify.attempt_number(t.fixes)
    return verify.fix_effectiveness(verify.verify_next_run(numbered, t.issue_runs, DAY_SCALE_TIMEOUT))


@query
def run_funnel(t: Tables) -> DataFrame:
    def steps(df: DataFrame, kind: str) -> DataFrame:
        return df.select("job_id", F.lit(kind).alias("type"))
    checked = verify.verify_next_run(t.fixes, t.issue_runs, DAY_SCALE_TIMEOUT)
    history_rows = (
        steps(t.suggestions, "logs")
        .unionByName(steps(t.suggestions.where("issue_detected"), "diagnosis"))
        .unionByName(steps(lookups.approved_fixes(t.suggestions, t.approvals), "fix"))
        .unionByName(steps(checked.where(F.col("next_run_id").isNotNull()), "verification"))
    )
    return health.run_funnel(history_rows)


# -- ordered views -----------------------------------------------------------------------------

@query
def latest_run(t: Tables) -> DataFrame:
    return lookups.latest_run(t.runs, ["job_id", "run_id", "status", "start_ts", "duration_seconds"])


@query
def recent_runs(t: Tables) -> DataFrame:
    return history.recent_runs(t.runs, 25).select("run_id", "job_id", "status", "start_ts")


@query
def recent_runs_per_job(t: Tables) -> DataFrame:
    return history.recent_runs(t.runs, 5, per_job=True).select("run_id", "job_id", "status", "start_ts", "position")


@query
def activity_examples(t: Tables) -> DataFrame:
    return health.activity_examples(t.activity)


@query
def last_user_message(t: Tables) -> DataFrame:
    return history.last_user_message(t.chat)


@query
def state_transitions(t: Tables) -> DataFrame:
    return history.state_transitions(logtext.state_lines(t.state_log).select("file", "line_no", "ts", "state"))


@query
def tail_lines(t: Tables) -> DataFrame:
    return history.tail_lines(t.log_text)


@query
def head_logs(t: Tables) -> DataFrame:
    return history.head_logs(t.logs).select("run_id", "event_id", "position", "truncated")


@query
def digest_text(t: Tables) -> DataFrame:
    return history.digest_text(t.logs)


@query
def digest_text_all(t: Tables) -> DataFrame:
    """Every entry of every run, ten to a chunk."""
    return history.digest_chunks(t.logs)


@query
def history_newest_first(t: Tables) -> DataFrame:
    done = t.suggestions.select("run_id", "job_id", F.col("start_ts").alias("ts"), "issue_type")
    return history.history_newest_first(done)


@query
def attempt_number(t: Tables) -> DataFrame:
    return verify.attempt_number(t.fixes).select("fix_id", "job_id", "issue_type", "attempt", "within_limit")


@query
def chat_context(t: Tables) -> DataFrame:
    asked = history.last_user_message(t.chat).withColumn("context", F.when(F.col("conv_id") % 2 == 0, F.lit("region 1")))
    sent = history.chat_context(asked, "You watch job runs.")
    return sent.select("conv_id", F.size("messages").alias("n_messages"), F.array_join(
        F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("messages"))


# -- diagnosis and remedies ------------------------------------------------------------------------

@query
def classify_issue(t: Tables) -> DataFrame:
    return t.run_logs.select("run_id", dx.classify_issue(F.col("stderr")).alias("issue_type"))


@query
def classify_documents(t: Tables) -> DataFrame:
    """The keyword rule over whole documents and whole pages."""
    docs = t.table("documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = t.table("pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return docs.unionByName(pages).select("kind", "id", dx.classify_issue(F.col("text")).alias("issue_type"))


@query
def diagnose_run(t: Tables) -> DataFrame:
    return dx.diagnose_run(t.run_logs).select(
        "run_id", "issue_type", "confidence", "issue_detected", joined("evidence", "\n"), "details",
        joined("recommendations"))


@query
def parse_verdict(t: Tables) -> DataFrame:
    return t.verdicts.select("doc_id", dx.parse_verdict(F.col("content")).alias("v")).select(
        "doc_id", "v.is_json", "v.issue_type", "v.confidence", F.array_join("v.evidence", "|").alias("evidence"), "v.details")


@query
def trim_logs(t: Tables) -> DataFrame:
    stdout, stderr = dx.trim_logs(F.col("text"), F.col("text"))
    return t.table("documents").select("doc_id", F.md5(stdout).alias("stdout_md5"), F.md5(stderr).alias("stderr_md5"),
                                       F.length(stderr).alias("kept"))


@query
def evidence_lines(t: Tables) -> DataFrame:
    found = t.run_logs.withColumn("evidence", dx.evidence_lines(F.col("stderr")))
    return found.select("run_id", F.size("evidence").alias("n_lines"), joined("evidence", "\n"))


@query
def reasoning_steps(t: Tables) -> DataFrame:
    steps = dx.with_fix_step(
        dx.reasoning_steps(F.col("issue_type"), F.col("confidence"), F.col("evidence")),
        F.when(F.col("issue_detected"), F.col("fix_type")), F.col("description"))
    return t.suggestions.select("run_id", F.posexplode(steps).alias("at", "s")).select("run_id", "at", "s.*")


@query
def normalise_failure_type(t: Tables) -> DataFrame:
    named = t.table("events").select("event_id", pick(FAILURE_NAMES, F.col("event_id") % 6).alias("name"))
    return named.withColumn("issue_type", dx.normalise_failure_type(F.col("name")))


@query
def alias_failure_type(t: Tables) -> DataFrame:
    named = t.table("events").select("event_id", pick(FAILURE_NAMES, F.col("event_id") % 6).alias("name"))
    return named.withColumn("issue_type", dx.alias_failure_type(F.col("name")))


@query
def message_text(t: Tables) -> DataFrame:
    """The text of all of each run's entries, in the order of time."""
    entries = t.logs.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "message"))).alias("entries"))
    return entries.select("run_id", dx.message_text(F.col("entries")).alias("text"))


@query
def missing_packages(t: Tables) -> DataFrame:
    found = t.run_logs.withColumn("packages", dx.missing_packages(F.col("stderr")))
    return found.select("run_id", F.size("packages").alias("n_packages"), joined("packages"))


@query
def suggest_fix(t: Tables) -> DataFrame:
    return t.suggestions.select(
        "run_id", "fix_id", "fix_type", text.rendered_map(F.col("parameters")).alias("parameters"), joined("packages"),
        "fix_confidence", "description", joined("required_permissions"), "expected_impact", "estimated_time",
        "original_confidence")


@query
def infer_fix_type(t: Tables) -> DataFrame:
    return t.suggestions.select(
        "run_id", remedy.infer_fix_type(F.lit(None).cast("string"), F.col("parameters"), F.col("packages")).alias("inferred"),
        remedy.infer_fix_type(F.col("fix_type"), F.col("parameters"), F.col("packages")).alias("given"))


@query
def plan_fix(t: Tables) -> DataFrame:
    planned = lookups.plan_fix(t.suggestions.drop("cluster_id"), t.runs, t.clusters)
    return planned.select("run_id", "cluster_id", "fix_type", "plan_status", "message", "target_workers", "payload", "is_noop")


@query
def merge_conf(t: Tables) -> DataFrame:
    new = F.create_map(F.lit("spark.a"), F.lit("2"), F.lit("spark.b"), F.col("state"))
    return t.clusters.select("cluster_id", text.rendered_map(remedy.merge_conf(F.col("spark_conf"), new)).alias("conf"))


@query
def penalise_confidence(t: Tables) -> DataFrame:
    return t.table("labels").select("doc_id", guards.penalise_confidence(
        F.lit(0.8), F.col("quality") == 0, F.col("toxic") == 1).alias("confidence"))


@query
def safety_details(t: Tables) -> DataFrame:
    columns = ["harmful", "harassment", "hate", "sexual", "self_harm"]
    return t.scores.select("doc_id", guards.safety_details([F.col(c) for c in columns]).alias("details"))


@query
def confidence_band(t: Tables) -> DataFrame:
    graded = t.table("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("confidence"))
    return graded.groupBy(reporting.confidence_band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query
def render_report(t: Tables) -> DataFrame:
    checked = verify.verify_next_run(t.fixes, t.issue_runs, DAY_SCALE_TIMEOUT).select(
        "fix_id", F.col("issue_resolved").alias("fix_successful"))
    rendered = reporting.render_report(t.suggestions.drop("recommendations").join(checked, "fix_id"))
    return rendered.select("run_id", "job_id", "start_ts", "headline", "confidence_band", "situation", "root_cause",
                           "resolution", joined("recommendations"), "report")


@query
def incident_response(t: Tables) -> DataFrame:
    return _flat_response(incident.incident_response(t.runs, t.run_logs, t.clusters))


@query
def incident_response_requests(t: Tables) -> DataFrame:
    return _flat_response(incident.incident_response(t.runs, t.run_logs, t.clusters, t.requests))


def _flat_response(response: DataFrame) -> DataFrame:
    return response.select(
        "job_id", "run_id", "status", "issue_detected", "issue_type", "confidence", "fix_id", "fix_type",
        joined("packages"), "fix_confidence", "plan_status", "message", "target_workers", "payload", "is_noop",
        F.size("reasoning").alias("n_steps"), "report", "pending_approval")


# -- scalar functions ---------------------------------------------------------------------------

@query
def text_helpers(t: Tables) -> DataFrame:
    name = F.regexp_replace(F.lower("p_name"), " ", "_")
    return t.table("part").select(
        "p_partkey", text.title_words(name).alias("title"), text.plain_words(name).alias("words"),
        text.last_segment(F.concat_ws(".", "p_brand", "p_type", "p_name")).alias("last_part"),
        text.or_default(F.nullif("p_type", F.lit("ECONOMY")), "N/A").alias("type_or_default"),
        text.strip(F.concat(F.lit(" \n"), F.col("p_name"), F.lit("\t "))).alias("stripped"))


@query
def shorten_text(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", text.shorten(F.col("text")).alias("shown"))


@query
def number_helpers(t: Tables) -> DataFrame:
    pct = F.concat(F.col("p_size").cast("string"), F.lit("%"))
    return t.table("part").select(
        "p_partkey", F.round(text.percent_factor(pct), 6).alias("factor"),
        text.percent_factor(F.col("p_name")).alias("no_factor"),
        remedy.target_workers(F.col("p_size"), pct).alias("workers"),
        text.mb_to_gb(F.col("p_size") * 512).alias("gb"))


@query
def time_helpers(t: Tables) -> DataFrame:
    return t.table("events").select(
        "event_id", text.epoch_millis(F.col("ts")).alias("millis"), text.clock(F.col("ts")).alias("clock"),
        text.duration_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("elapsed"),
        F.date_format(text.log_time(F.date_format("ts", text.LOG_TIME_FORMAT)), text.LOG_TIME_FORMAT).alias("parsed"),
        text.log_time(F.concat(F.lit("x"), F.col("event_type"))).alias("not_a_time"))


@query
def parse_job_id(t: Tables) -> DataFrame:
    return t.chat.select("conv_id", "turn", intent.parse_job_id(F.col("text")).alias("job_ref"))


@query
def approval_intent(t: Tables) -> DataFrame:
    body = F.col("text")
    return t.chat.select(
        "conv_id", "turn", intent.is_approval(body).alias("approves"), intent.is_rejection(body).alias("rejects"),
        intent.is_approval(body, word_boundary=True).alias("approves_word"),
        intent.is_rejection(body, word_boundary=True).alias("rejects_word"))


@query
def simulation_intent(t: Tables) -> DataFrame:
    body = F.col("text")
    return t.chat.select("conv_id", "turn", intent.wants_simulation(body).alias("simulates"),
                         intent.failure_keyword(body).alias("keyword"), intent.wants_help(body).alias("helps"))


@query
def route_messages(t: Tables) -> DataFrame:
    return chat.route_messages(t.chat, t.job_fixes).select(
        "conv_id", "turn", "job_ref", "message_class", "waiting_fix", "decided_fix")


@query
def chat_decisions(t: Tables) -> DataFrame:
    return chat.chat_decisions(chat.route_messages(t.chat, t.job_fixes))


@query
def result_badge(t: Tables) -> DataFrame:
    return t.verdicts.select("doc_id", intent.result_badge(F.col("content")).alias("badge"))


@query
def state_kind(t: Tables) -> DataFrame:
    kinds = logtext.state_lines(t.state_log).withColumn("kind", intent.state_kind(F.col("state")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def success_flag(t: Tables) -> DataFrame:
    """Success from a flag or from a status, whichever is there."""
    flag = F.when(F.col("event_type") == "click", F.lit(True)).when(F.col("event_type") == "view", F.lit(False))
    status = F.when(F.col("value") > 10, F.lit("success"))
    return t.table("events").select("event_id", text.succeeded(flag, status).alias("successful"))


# -- SQL functions and JSON actions -----------------------------------------------------------------

@query
def sql_functions(t: Tables) -> DataFrame:
    sqlfuncs.register_functions(t.spark)
    return t.run_logs.select(
        "run_id", F.expr("classify_issue(stderr)").alias("issue_type"),
        F.expr("confidence_band(length(stderr) / 100D)").alias("band"),
        F.expr("alias_failure_type(substring_index(stderr, ' ', 1))").alias("aliased"),
        F.expr("parse_job_id(concat('check job ', run_id))").alias("job_ref"))


def _spread(df: DataFrame, rows_a_task: int = LOG_ROWS_A_TASK) -> DataFrame:
    """Rows dealt over every core, and more tasks as they grow: a small file is one split, but its rows are costly."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_a_task))
    return df.repartition(tasks)


def _logs_json(t: Tables) -> DataFrame:
    """Logs as JSON text; runs of priority 5 send text that is no JSON."""
    stdout, stderr = t.log_texts(F.col("o_orderkey"))
    body = F.when(F.col("o_orderpriority").startswith("5"), F.lit("{not json")).otherwise(
        F.to_json(F.struct(stdout.alias("stdout"), stderr.alias("stderr"))))
    return _spread(t.table("orders")).select(F.col("o_orderkey").alias("run_id"), body.alias("logs"))


@query
def diagnose_json(t: Tables) -> DataFrame:
    answer = F.from_json("answer", "issue_type string, confidence double, evidence array<string>, error string")
    return (_logs_json(t).withColumn("answer", sqlfuncs.diagnose_json(F.col("logs"))).withColumn("a", answer)
            .select("run_id", "a.issue_type", "a.confidence", F.array_join("a.evidence", "\n").alias("evidence"), "a.error"))


@query
def suggest_fix_json(t: Tables) -> DataFrame:
    stderr = F.get_json_object("logs", "$.stderr")
    answer = F.from_json("answer", "fix_type string, fix_confidence double, packages array<string>, error string")
    return (_logs_json(t).withColumn("answer", sqlfuncs.suggest_fix_json(text.once(stderr, dx.issue_type_of), F.col("logs")))
            .withColumn("a", answer)
            .select("run_id", "a.fix_type", "a.fix_confidence", F.array_join("a.packages", "|").alias("packages"), "a.error"))


@query
def sql_actions(t: Tables) -> DataFrame:
    """The five actions, one after the other, called from SQL for every run."""
    checked = verify.verify_next_run(t.fixes, t.issue_runs, DAY_SCALE_TIMEOUT).join(t.suggestions.select("fix_id", "run_id"), "fix_id")
    actions.register_actions(t.spark, t.runs, t.clusters, checked)
    found = t.spark.sql("""
        SELECT q.run_id, d.issue_type, s.fix_type, s.fix_confidence, s.parameters, d.error AS diagnose_error
        FROM {requests} q, LATERAL diagnose_logs(q.logs) d, LATERAL suggest_fix_for(d.issue_type, q.logs) s""", requests=_logs_json(t))
    applied = t.spark.sql("""
        SELECT q.*, a.cluster_id, a.target_workers, a.payload, a.error AS apply_error
        FROM {found} q, LATERAL apply_fix(q.run_id, q.fix_type, q.parameters) a""", found=stored(found, "actions-found"))
    return t.spark.sql("""
        SELECT q.run_id, q.issue_type, q.fix_type, q.fix_confidence, q.diagnose_error, q.cluster_id, q.target_workers, q.payload,
               q.apply_error, v.outcome, v.next_run_id, v.error AS verify_error, r.report, r.error AS report_error
        FROM {applied} q, LATERAL verify_fix(q.run_id) v,
             LATERAL report_for(q.issue_type, IF(q.run_id % 7 = 0, 'no steps', concat('[{{"step":"verify","result":"', coalesce(v.outcome, '-'), '"}}]')),
                                v.outcome = 'success') r""", applied=stored(applied, "actions-applied"))


# -- streams ---------------------------------------------------------------------------------------

@query
def follow_states(t: Tables) -> DataFrame:
    live = follow.follow_states(t.states_of(t.stream("events")), LOGGER)
    return run_available(live.select("file", "line_no", "ts", "state", "kind"), t.spark, "follow-states")


@query
def follow_growing_logs(t: Tables) -> DataFrame:
    """State lines of a folder of logs that gains files between two triggers; each line arrives once."""
    home = shared_folder(t.spark, "growing-logs")
    states = t.state_log.select("line_no", "value")
    live = follow.follow_states(growing.read_growing_logs(t.spark, f"{home}/logs", "part-"), LOGGER).select("ts", "state", "kind")
    for half in (0, 1):
        states.where(F.col("line_no") % 2 == half).select("value").write.mode("append").text(f"{home}/logs")
        finished(live.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint")
                 .trigger(availableNow=True).start())
    return t.spark.read.schema(live.schema).parquet(f"{home}/out")


def _landing(orders: DataFrame, days_late: int = 0) -> tuple[Column, int]:
    """Which landing an order comes with, in order of its date or up to ``days_late`` days after it, and a landing's days."""
    first, last = orders.agg(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).first()
    days = max(1, -(-((last - first).days + days_late + 1) // LANDINGS)) if first else 1
    day = F.date_diff(F.to_date("o_orderdate"), F.lit(first)) + F.pmod(F.xxhash64("o_orderkey"), F.lit(days_late + 1))
    return F.floor(day / days).cast("int"), days


@query
def diagnose_stream(t: Tables) -> DataFrame:
    """Orders land in order of their dates; every tenth lands a second time with the next landing."""
    orders = t.table("orders")
    place, days = _landing(orders)
    again = orders.where(F.col("o_orderkey") % 10 == 0)
    exports = orders.withColumn("_place", place).unionByName(
        again.withColumn("_place", F.least(place + 1, F.lit(LANDINGS - 1)))).repartition("_place")
    path = landed(exports, F.col("_place"), LANDINGS, "exports")
    stdout, stderr = t.log_texts(F.col("o_orderkey"))
    arriving = one_a_trigger(t.spark, path, exports).select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("job_id"),
        t.run_status(F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").cast("timestamp").alias("start_ts"),
        stdout.alias("stdout"), stderr.alias("stderr"))
    live = follow.diagnose_stream(arriving, lateness=f"{2 * days} days").select(
        "run_id", "job_id", "issue_type", "confidence", "fix_id", "fix_type", "fix_confidence")
    home = shared_folder(t.spark, "diagnose")
    finished(ledger.batches_once(live, f"{home}/out", f"{home}/checkpoint").trigger(availableNow=True).start(), keep_all=True)
    return ledger.read_batches(t.spark, f"{home}/out", live.schema)


@query
def verify_stream(t: Tables) -> DataFrame:
    """Fixes and runs land up to 30 days out of order; what the watermark has not passed at the end is ``open``."""
    orders = t.table("orders")
    place, _ = _landing(orders, SCRAMBLED_DAYS)
    path = landed(orders, place, LANDINGS, "scrambled")
    _, stderr = t.log_texts(F.col("o_orderkey"))
    status = t.run_status(F.col("o_orderstatus"))
    live = one_a_trigger(t.spark, path, orders).select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("job_id"), F.col("o_orderdate").alias("start_ts"),
        status.alias("status"), F.when(status == "FAILED", text.once(stderr, dx.issue_type_of)).alias("issue_type"))
    fixes = live.where(F.col("status") == "FAILED").select(
        remedy.fix_id(F.col("run_id"), F.lit("live")).alias("fix_id"), "job_id", F.col("start_ts").alias("fix_ts"), "issue_type")
    answers = verify_live.verify_stream(fixes, live, DAY_SCALE_TIMEOUT, f"{SCRAMBLED_DAYS + 1} days")
    settled = verify_live.settled(run_available(answers, t.spark, "verify", keep_all=True))
    asked = t.suggestions.select(remedy.fix_id(F.col("run_id"), F.lit("live")).alias("fix_id"), "job_id", "issue_type")
    return verify_live.with_open(asked, settled)


@query
def approvals_stream(t: Tables) -> DataFrame:
    """Turns arrive over four triggers in no order at all."""
    turns = t.table("conversations")
    path = landed(turns, F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)), 4, "shuffled-chat")
    live = approvals_live.approvals_stream(t.chat_of(one_a_trigger(t.spark, path, turns)), t.job_fixes)
    return run_available(live, t.spark, "approvals")
