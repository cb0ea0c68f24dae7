"""Entity views over the test tables.

The tables hold orders, line items and events, not runs and logs, so each entity
is a fixed mapping of rows to rows. ``oracle`` states the same mappings in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runhealth.functions.remedy import fix_id
from runhealth.plans.incident import failed_diagnoses, fixes_of, runs_with_issues

# Failure texts, one per kind of run; the last one is for runs that left no text.
STDERR = [
    "ERROR executor lost: java.lang.OutOfMemoryError: Java heap space\nmemory ran short on host 4",
    "Container stopped: Out of Memory while sorting",
    "java.lang.OutOfMemoryError: GC overhead limit exceeded\n at Main.run",
    "write failed: No space left on device\ndisk /local is full",
    "Disk quota used up for this user",
    "Caused by: java.lang.ClassNotFoundException: a.b.Widget",
    "No module named 'x.y'\nretrying\nNo module named 'x.y'\njava.lang.ClassNotFoundException: a.b.Widget \n at Main",
    "a required library could not be resolved",
    "process ended with exit code 1",
    "memory use written to the log",
    "memory low: heap space gone\ndisk space low too\nfailed to import tables",
    None,
]
STDOUT = "run started\nloading module tables\nexit code 1"
STATES = [
    "AGENT STATE: Starting monitoring",
    "AGENT STATE: Diagnosing logs",
    "AGENT STATE: Diagnosed issue: memory_exceeded with confidence 0.6",
    "AGENT STATE: Suggested fix: increase_memory",
    "Suggested fix: restart_cluster (confidence: 0.5) - awaiting user approval",
    "AGENT STATE: Applying fix",
    "heartbeat",
    "AGENT STATE: Error while applying",
]
LOGGER = "runhealth.agent"
N_PHRASES = 12
FAILURE_NAMES = ["oom", "Disk_Space_Exceeded", "library", "UNKNOWN", "storage", "other"]


def pick(values: list[str | None], index: Column) -> Column:
    """The value at a 0-based index."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


class Tables:
    """The test tables of one directory and the entities made from them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The same table as a file stream."""
        return (self.spark.readStream.schema(self.table(name).schema)
                .option("pathGlobFilter", f"{name}.parquet").parquet(self.path))

    # -- runs, jobs, clusters -----------------------------------------------------

    @staticmethod
    def run_status(status: Column) -> Column:
        return F.when(status == "F", "FAILED").when(status == "O", "SUCCESS").otherwise("RUNNING")

    @cached_property
    def runs(self) -> DataFrame:
        work = self.table("lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
            F.min("l_suppkey").alias("cluster_id"), F.sum("l_quantity").cast("bigint").alias("duration_seconds"))
        status = self.run_status(F.col("o_orderstatus"))
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("job_id"),
            F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_name"),
            status.alias("status"),
            F.when(status == "RUNNING", "RUNNING").otherwise("TERMINATED").alias("life_cycle_state"),
            F.when(status != "RUNNING", status).alias("result_state"),
            F.col("o_orderdate").alias("start_ts"))
        return orders.join(work, "run_id", "left").withColumn(
            "end_ts", F.col("start_ts") + F.make_dt_interval(secs=F.col("duration_seconds").cast("decimal(18,6)")))

    @staticmethod
    def log_texts(run_id: Column) -> tuple[Column, Column]:
        kind = run_id % len(STDERR)
        silent = kind == len(STDERR) - 1
        stderr = F.when(silent & (run_id % (2 * len(STDERR)) != kind), F.lit("")).otherwise(pick(STDERR, kind))
        return F.when(silent, F.lit("")).otherwise(F.lit(STDOUT)), stderr

    @cached_property
    def run_logs(self) -> DataFrame:
        """Log text of the failed runs."""
        stdout, stderr = self.log_texts(F.col("o_orderkey"))
        return self.table("orders").where(F.col("o_orderstatus") == "F").select(
            F.col("o_orderkey").alias("run_id"), stdout.alias("stdout"), stderr.alias("stderr"))

    @cached_property
    def jobs(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("job_id"), F.col("c_mktsegment").alias("creator"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_time"),
            F.struct(F.col("c_name").alias("name"),
                     F.when(F.col("c_acctbal") > 0, "daily").alias("schedule")).alias("settings"))

    @cached_property
    def clusters(self) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        key = F.col("s_suppkey")
        return self.table("supplier").join(nation, "s_nationkey").select(
            key.alias("cluster_id"), F.col("s_name").alias("name"),
            pick(["RUNNING", "RUNNING", "TERMINATED", "ERROR"], key % 4).alias("state"),
            F.lit("ops").alias("creator"), F.col("n_name").alias("node_type"), F.lit("17.x").alias("runtime"),
            F.nullif((key % 9).cast("int"), F.lit(0)).alias("num_workers"),
            F.create_map(F.lit("spark.a"), F.lit("1"), F.lit("spark.node"), F.col("n_name")).alias("spark_conf"))

    @cached_property
    def objects(self) -> DataFrame:
        return self.table("pages").select(F.col("url").alias("path"))

    @cached_property
    def requests(self) -> DataFrame:
        """A request per customer: some name a run, some of those runs do not exist."""
        named = (F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey") * 10)
                 .when(F.col("c_mktsegment") == "MACHINERY", F.col("c_custkey") + 1_000_000_000_000))
        return self.table("customer").select(F.col("c_custkey").alias("job_id"), named.alias("run_id"))

    # -- events: activity, logs, calls ----------------------------------------------

    @cached_property
    def activity(self) -> DataFrame:
        kind = F.col("event_type")
        action = (
            F.when(F.col("event_id") % 17 == 0, "LOGIN").when(kind == "click", "CLUSTER_RESIZE")
            .when(kind == "purchase", "JOB_RUN").when(kind == "view", "NOTEBOOK_OPEN")
            .when(kind == "signup", "WAREHOUSE_START").otherwise("JOB_CLUSTER_FAIL"))
        user = F.when(kind != "signup", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
        return self.table("events").select("event_id", "ts", action.alias("action_type"), user.alias("user_name"))

    @cached_property
    def cluster_events(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("cluster_id"), "ts", F.upper("event_type").alias("type"),
            F.col("props").alias("details"))

    @staticmethod
    def prop(events_props: Column) -> Column:
        return F.get_json_object(events_props, "$.k").cast("bigint")

    @cached_property
    def logs(self) -> DataFrame:
        kind = F.col("event_type")
        level = (F.when(kind == "error", "ERROR").when(kind == "signup", "WARNING")
                 .when(kind == "view", "DEBUG").otherwise("INFO"))
        log_type = (
            F.when(kind == "error", "stderr").when(kind == "click", "audit").when(kind == "purchase", "driver")
            .when(kind == "signup", "executor").when(F.col("value") >= 10, "cluster").otherwise("stdout"))
        message = F.when(kind == "error", pick(STDERR, F.col("event_id") % len(STDERR))).otherwise(
            F.concat_ws(" | ", kind, F.col("props")))
        return self.table("events").select(
            "event_id", "ts", log_type.alias("log_type"), F.col("user_id").alias("cluster_id"),
            self.prop(F.col("props")).alias("run_id"),
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user"), level.alias("level"),
            F.lit("driver").alias("source"), F.lit(LOGGER).alias("logger"), message.alias("message"))

    @staticmethod
    def log_record(level: Column, logger: Column, message: Column) -> Column:
        return F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, logger,
                           F.coalesce(message, F.lit("")))

    @staticmethod
    def log_file(user_id: Column) -> Column:
        return F.concat(F.lit("agent-"), user_id.cast("string"), F.lit(".log"))

    @cached_property
    def log_records(self) -> DataFrame:
        return self.logs.select(
            self.log_file(F.col("cluster_id")).alias("file"), "event_id",
            self.log_record(F.col("level"), F.col("logger"), F.col("message")).alias("record"))

    @cached_property
    def log_text(self) -> DataFrame:
        """Log files as lines; records of several lines are split up."""
        return self.log_records.select(
            "file", "event_id", F.posexplode(F.split("record", "\n")).alias("at", "value")
        ).select("file", (F.col("event_id") * 16 + F.col("at")).alias("line_no"), "value")

    @classmethod
    def states_of(cls, events: DataFrame) -> DataFrame:
        level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
        logger = F.when(F.col("event_type") == "signup", "runhealth.other").otherwise(LOGGER)
        return events.select(
            cls.log_file(F.col("user_id")).alias("file"), F.col("event_id").alias("line_no"),
            cls.log_record(level, logger, pick(STATES, F.col("event_id") % len(STATES))).alias("value"))

    @cached_property
    def state_log(self) -> DataFrame:
        return self.states_of(self.table("events"))

    @cached_property
    def api_calls(self) -> DataFrame:
        ok = F.col("event_type") != "error"
        error = F.when(~ok, F.struct(
            F.when(F.col("value") > 10, "TimeoutError").otherwise("ConnectionError").alias("type"),
            F.lit("call failed").alias("message")))
        k = self.prop(F.col("props"))
        return self.table("events").select(
            F.col("event_id").alias("call_id"), "ts", F.col("event_type").alias("operation"), ok.alias("success"),
            F.create_map(F.lit("k"), k.cast("string"), F.lit("token"), F.lit("t-1"), F.lit("Token"), F.lit("kept"),
                         F.lit("password"), F.lit("p-1")).alias("parameters"),
            k.alias("result_size"), F.col("value").alias("duration_seconds"), error.alias("error"))

    @cached_property
    def metrics(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("cluster_id"),
            F.when(F.col("l_linenumber") == 1, "driver").otherwise("worker").alias("node_role"),
            F.col("l_linenumber").alias("node_id"), F.col("l_shipdate").alias("sampled_ts"),
            F.when(F.col("l_returnflag") == "A", "cpu").when(F.col("l_returnflag") == "N", "memory")
            .otherwise("disk").alias("resource"),
            F.col("l_quantity").alias("used"), F.lit(50.0).alias("total"))

    # -- chat, verdicts, scores -------------------------------------------------------

    @staticmethod
    def chat_of(turns: DataFrame) -> DataFrame:
        """Conversations whose user turns carry requests and answers."""
        conv, raw = F.col("conv_id").cast("string"), F.col("text")
        phrases = [
            raw, F.concat(F.lit("Monitor job_"), conv), F.concat(F.lit("please check job "), conv), F.lit("yes"),
            F.lit("no thanks"), F.lit("approve it"), F.concat(raw, F.lit(" diagnose "), conv), F.lit("don't apply"),
            F.lit("help"), F.lit("simulate a memory failure"), F.lit(" ok "), F.lit("yes, apply job-7")]
        chosen = F.element_at(F.array(*phrases), ((F.col("conv_id") + F.col("turn")) % N_PHRASES + 1).cast("int"))
        return turns.select("conv_id", "turn", "role", F.when(F.col("role") == "user", chosen).otherwise(raw).alias("text"))

    @cached_property
    def chat(self) -> DataFrame:
        return self.chat_of(self.table("conversations"))

    @cached_property
    def verdicts(self) -> DataFrame:
        contents = [
            F.lit('{"issue_type": "memory_exceeded", "confidence": 0.72, "evidence": ["first", "second"], '
                  '"root_cause": "heap"}'),
            F.lit("{}"), F.concat(F.col("text"), F.lit(" memory and heap space")),
            F.lit('{"confidence": "high"}'), F.lit(None).cast("string")]
        return self.table("documents").select(
            "doc_id", F.element_at(F.array(*contents), (F.col("doc_id") % 5 + 1).cast("int")).alias("content"))

    @cached_property
    def scores(self) -> DataFrame:
        q, t = F.col("quality"), F.col("toxic")
        return self.table("labels").select(
            "doc_id", (t * 0.75).alias("harmful"), F.lit(0.0).alias("harassment"), (q * 0.25).alias("hate"),
            (q * t * 0.5).alias("sexual"), (t * 0.125).alias("self_harm"))

    # -- derived: diagnoses, suggestions, approvals ------------------------------------

    @cached_property
    def suggestions(self) -> DataFrame:
        return failed_diagnoses(self.runs, self.run_logs)

    @cached_property
    def fixes(self) -> DataFrame:
        return fixes_of(self.suggestions)

    @cached_property
    def issue_runs(self) -> DataFrame:
        return runs_with_issues(self.runs, self.suggestions)

    @cached_property
    def approvals(self) -> DataFrame:
        """Approvals of fixes whose run had a returned line, and some of unknown fixes."""
        returned = self.table("lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("run_id"))
        known = self.suggestions.join(returned, "run_id", "left_semi").select(
            "fix_id", "job_id", (F.col("start_ts") + F.expr("INTERVAL 1 DAY")).alias("decided_ts"))
        unknown = self.table("customer").where(F.col("c_acctbal") < 0).select(
            fix_id(F.col("c_name"), F.lit("none")).alias("fix_id"), F.col("c_custkey").alias("job_id"),
            F.lit("2001-01-01 00:00:00").cast("timestamp_ntz").alias("decided_ts"))
        return known.unionByName(unknown).withColumn("decision", F.lit("approve"))

    @cached_property
    def job_fixes(self) -> DataFrame:
        """The fix suggested for each job's newest failed run, by the name chat uses."""
        newest = self.suggestions.groupBy("job_id").agg(
            F.max_by("fix_id", F.struct("start_ts", "run_id")).alias("fix_id"))
        return newest.select(F.concat(F.lit("job_"), F.col("job_id").cast("string")).alias("job_ref"), "fix_id")
