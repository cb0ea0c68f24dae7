"""DuckDB statements for the queries, written from the rules and not from the plans.

``ENTITIES`` states the mapping of test tables to runs, logs and so on; the statements below build
on it. What depends on order is replayed row by row in recursive statements.
"""

from __future__ import annotations

from runhealth.functions import reporting
from runhealth.plans.bindings import FAILURE_NAMES, LOGGER, STATES, STDERR, STDOUT


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def pick(values: list[str | None], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


def any_of(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(t)})" for t in terms) + ")"


def keyword(text: str) -> str:
    low = f"lower({text})"
    return (f"CASE WHEN contains({low}, 'memory') AND {any_of(low, ['oom', 'out of memory', 'heap space'])} THEN 'memory_exceeded' "
            f"WHEN contains({low}, 'disk') AND {any_of(low, ['space', 'quota'])} THEN 'disk_space_exceeded' "
            f"WHEN {any_of(low, ['dependency', 'module', 'package', 'import', 'library'])} THEN 'dependency_error' ELSE 'unknown' END")


PY, JVM = r"No module named ''([^'']+)''", r"ClassNotFoundException: ([^\n]+)"


def issue(text: str) -> str:
    return (f"CASE WHEN {keyword(text)} <> 'unknown' THEN {keyword(text)} "
            f"WHEN regexp_matches({text}, 'OutOfMemoryError|GC overhead limit exceeded') THEN 'memory_exceeded' "
            f"WHEN regexp_matches({text}, 'Library resolution failed|{PY}|{JVM}') THEN 'dependency_error' ELSE 'unknown' END")


def packages(text: str) -> str:
    return (f"coalesce(list_concat(regexp_extract_all({text}, '{PY}', 1), list_transform(regexp_extract_all({text}, '{JVM}', 1), "
            f"lambda x: trim(string_split(x, '.')[-1], chr(32) || chr(9) || chr(10) || chr(13)))), [])")


SIGNS = ("OutOfMemoryError|GC overhead limit exceeded|AZURE_QUOTA_EXCEEDED_EXCEPTION|QuotaExceeded|Connection refused|RPC timed out"
         "|unreachable during run|Library resolution failed|No module named ''|ClassNotFoundException: ")
TERMS = "memory|oom|out of memory|heap space|disk|quota|dependency|module|package|import|library"


def by_issue(memory: str, disk: str, dependency: str, other: str, column: str = "issue_type") -> str:
    return (f"CASE {column} WHEN 'memory_exceeded' THEN {memory} WHEN 'disk_space_exceeded' THEN {disk} "
            f"WHEN 'dependency_error' THEN {dependency} ELSE {other} END")


def guided(texts: dict[str, str]) -> str:
    return by_issue(*[lit(texts[k]) for k in ("memory_exceeded", "disk_space_exceeded", "dependency_error", "unknown")], "p.issue_type")


def band(x: str) -> str:
    return f"CASE WHEN {x} * 100 >= 80 THEN 'high' WHEN {x} * 100 >= 50 THEN 'moderate' WHEN {x} * 100 > 0 THEN 'low' ELSE 'unavailable' END"


def status(x: str) -> str:
    return f"CASE {x} WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCESS' ELSE 'RUNNING' END"


def stdout_of(run: str) -> str:
    return f"CASE WHEN {run} % 12 = 11 THEN '' ELSE {lit(STDOUT)} END"


def stderr_of(run: str) -> str:
    return f"CASE WHEN {run} % 24 = 23 THEN '' ELSE {pick(STDERR, f'({run} % 12)')} END"


def record(level: str, logger: str, message: str) -> str:
    return f"strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | ' || {level} || ' | ' || {logger} || ' | ' || coalesce({message}, '')"


def kind_of(state: str) -> str:
    rules = [(["Starting"], "start"), (["Diagnosing"], "diagnose"), (["Diagnosed issue"], "issue"), (["Suggesting fix", "Suggested fix"], "suggest"),
             (["Applying fix"], "apply"), (["Applied fix"], "applied"), (["Generated report"], "report"), (["Error"], "error")]
    return "CASE " + " ".join(f"WHEN {any_of(state, t)} THEN '{n}'" for t, n in rules) + " ELSE 'other' END"


def class_of(action: str) -> str:
    return ("CASE " + " ".join(f"WHEN contains({action}, '{t}') THEN '{n}'" for t, n in
            (("CLUSTER", "clusters"), ("JOB", "jobs"), ("NOTEBOOK", "notebooks"), ("WAREHOUSE", "warehouses"))) + " ELSE 'unclassified' END")


GROUPED = "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END"
STATE_TEXT = pick(STATES, f"(event_id % {len(STATES)})")
MESSAGE = f"CASE WHEN event_type = 'error' THEN {pick(STDERR, '(event_id % 12)')} ELSE concat_ws(' | ', event_type, props) END"
PROP = "(props ->> '$.k')::BIGINT"

ENTITIES = f"""
runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS job_id, 'run-' || o_orderkey AS run_name, {status('o_orderstatus')} AS status,
    CASE WHEN o_orderstatus IN ('F', 'O') THEN 'TERMINATED' ELSE 'RUNNING' END AS life_cycle_state,
    CASE WHEN o_orderstatus IN ('F', 'O') THEN {status('o_orderstatus')} END AS result_state, o_orderdate AS start_ts,
    cluster_id, duration_seconds, o_orderdate + to_seconds(duration_seconds) AS end_ts
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS cluster_id, sum(l_quantity)::BIGINT AS duration_seconds
                         FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
run_logs AS (
  SELECT o_orderkey AS run_id, {stdout_of('o_orderkey')} AS stdout, {stderr_of('o_orderkey')} AS stderr FROM orders WHERE o_orderstatus = 'F'),
jobs AS (
  SELECT c_custkey AS job_id, c_mktsegment AS creator, c_name AS name, CASE WHEN c_acctbal > 0 THEN 'daily' END AS schedule FROM customer),
clusters AS (
  SELECT s_suppkey AS cluster_id, s_name AS name, {pick(['RUNNING', 'RUNNING', 'TERMINATED', 'ERROR'], '(s_suppkey % 4)')} AS state,
    'ops' AS creator, n_name AS node_type, '17.x' AS runtime, nullif((s_suppkey % 9)::INT, 0) AS num_workers
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
requests AS (
  SELECT c_custkey AS job_id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey * 10
    WHEN c_mktsegment = 'MACHINERY' THEN c_custkey + 1000000000000 END AS run_id FROM customer),
latest AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY start_ts DESC, run_id DESC) = 1),
resolved AS (
  SELECT q.job_id, q.run_id, coalesce(q.run_id, l.run_id) AS resolved_run_id,
    CASE WHEN q.run_id IS NOT NULL THEN 'request' WHEN l.run_id IS NOT NULL THEN 'latest' ELSE 'none' END AS resolved_by
  FROM requests q LEFT JOIN latest l USING (job_id)),
activity AS (
  SELECT event_id, ts, CASE WHEN event_id % 17 = 0 THEN 'LOGIN' WHEN event_type = 'click' THEN 'CLUSTER_RESIZE'
    WHEN event_type = 'purchase' THEN 'JOB_RUN' WHEN event_type = 'view' THEN 'NOTEBOOK_OPEN'
    WHEN event_type = 'signup' THEN 'WAREHOUSE_START' ELSE 'JOB_CLUSTER_FAIL' END AS action_type,
    CASE WHEN event_type <> 'signup' THEN 'user-' || user_id END AS user_name FROM events),
logs AS (
  SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'stderr' WHEN 'click' THEN 'audit' WHEN 'purchase' THEN 'driver'
    WHEN 'signup' THEN 'executor' ELSE CASE WHEN value >= 10 THEN 'cluster' ELSE 'stdout' END END AS log_type, user_id AS cluster_id,
    {PROP} AS run_id, 'user-' || user_id AS "user",
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
    'driver' AS source, {lit(LOGGER)} AS logger, {MESSAGE} AS message FROM events),
log_records AS (SELECT 'agent-' || cluster_id || '.log' AS file, event_id, {record('level', 'logger', 'message')} AS record FROM logs),
log_text AS (
  SELECT file, event_id * 16 + piece - 1 AS line_no, parts[piece] AS value
  FROM (SELECT file, event_id, parts, unnest(range(1, len(parts) + 1)) AS piece
        FROM (SELECT file, event_id, string_split(record, chr(10)) AS parts FROM log_records))),
states AS (
  SELECT 'agent-' || user_id || '.log' AS file, event_id AS line_no, date_trunc('second', ts) AS ts,
    CASE WHEN message LIKE 'AGENT STATE: %' THEN message[14:]
      WHEN message LIKE 'Suggested fix: %' THEN 'Suggested fix: restart_cluster with confidence 0.5' END AS state
  FROM (SELECT *, {STATE_TEXT} AS message FROM events) WHERE event_type NOT IN ('error', 'signup') AND state IS NOT NULL),
api_calls AS (
  SELECT event_id AS call_id, ts, event_type AS operation, event_type <> 'error' AS success, {PROP} AS result_size, value AS duration_seconds,
    CASE WHEN event_type = 'error' THEN CASE WHEN value > 10 THEN 'TimeoutError' ELSE 'ConnectionError' END END AS error_type FROM events),
chat AS (
  SELECT conv_id, turn, role, CASE WHEN role <> 'user' THEN text ELSE CASE (conv_id + turn) % 12
    WHEN 0 THEN text WHEN 1 THEN 'Monitor job_' || conv_id WHEN 2 THEN 'please check job ' || conv_id WHEN 3 THEN 'yes'
    WHEN 4 THEN 'no thanks' WHEN 5 THEN 'approve it' WHEN 6 THEN text || ' diagnose ' || conv_id WHEN 7 THEN 'don''t apply'
    WHEN 8 THEN 'help' WHEN 9 THEN 'simulate a memory failure' WHEN 10 THEN ' ok ' WHEN 11 THEN 'yes, apply job-7' END END AS text
  FROM conversations),
verdicts AS (
  SELECT doc_id, doc_id % 5 AS k, CASE doc_id % 5
    WHEN 0 THEN '{{"issue_type": "memory_exceeded", "confidence": 0.72, "evidence": ["first", "second"], "root_cause": "heap"}}'
    WHEN 1 THEN '{{}}' WHEN 2 THEN text || ' memory and heap space' WHEN 3 THEN '{{"confidence": "high"}}' END AS content FROM documents),
diagnosed AS (
  SELECT *, CASE WHEN blank THEN 0.1 ELSE 0.6 END::DOUBLE AS confidence, issue_type <> 'unknown' AS issue_detected,
    list_filter(string_split(coalesce(stderr, ''), chr(10)), lambda x: regexp_matches(x, '{SIGNS}') OR regexp_matches(x, '{TERMS}', 'i')) AS evidence,
    {packages('stderr')} AS named, coalesce(contains(stderr, 'GC overhead limit exceeded'), false) AS gc
  FROM (SELECT run_id, stdout, stderr, coalesce(stdout, '') = '' AND coalesce(stderr, '') = '' AS blank,
          CASE WHEN coalesce(stdout, '') = '' AND coalesce(stderr, '') = '' THEN 'unknown' ELSE {issue('stderr')} END AS issue_type
        FROM run_logs)),
suggestions AS (
  SELECT *, sha256(run_id || '|' || fix_type) AS fix_id FROM (
    SELECT r.job_id, r.run_id, r.cluster_id, r.status, r.start_ts, d.* EXCLUDE (run_id, named),
      {by_issue("'increase_memory'", "'increase_disk_space'", "'install_dependencies'", "'restart_cluster'")} AS fix_type,
      {by_issue("CASE WHEN gc THEN 0.9 ELSE 0.8 END", "0.85", "CASE WHEN len(named) > 0 THEN 0.9 ELSE 0.6 END", "0.5")}::DOUBLE AS fix_confidence,
      {by_issue("'driver_memory=True,executor_memory=True,memory_increment=' || CASE WHEN gc THEN '100%' ELSE '50%' END",
                "'disk_increment=100%,local_disk=True'", "'install_method=' || CASE WHEN len(named) > 0 THEN 'cluster_libs' ELSE 'init_script' END",
                "'terminate_running_jobs=False'")} AS parameters,
      CASE WHEN issue_type = 'dependency_error' THEN named ELSE [] END AS packages,
      {by_issue("'memory x ' || CASE WHEN gc THEN '2.0' ELSE '1.5' END", "'disk x 2.0'",
                "CASE WHEN len(named) > 0 THEN 'packages: ' || array_to_string(named, ', ') ELSE 'packages: not named in the log' END", "'restart'")} AS description,
      {by_issue("'cluster_edit|pool_edit'", "'cluster_edit'", "'cluster_edit|libraries_install'", "'cluster_restart'")} AS required_permissions,
      {by_issue("'workers + / cost +'", "'disk + / cost +'", "'libraries + / start-up time +'",
                "'all jobs on the cluster - / start-up once'")} AS expected_impact,
      {by_issue("'5-10 minutes'", "'5-10 minutes'", "'10-15 minutes'", "'5-7 minutes'")} AS estimated_time
    FROM runs r JOIN diagnosed d USING (run_id) WHERE r.status = 'FAILED')),
approvals AS (
  SELECT fix_id, job_id, 'approve' AS decision FROM suggestions
  WHERE run_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
  UNION ALL SELECT sha256(c_name || '|none'), c_custkey, 'approve' FROM customer WHERE c_acctbal < 0),
checked AS (
  SELECT fix_id, job_id, start_ts AS fix_ts, fix_type, s.issue_type, confidence, n.run_id AS next_run_id, n.status AS next_status,
    n.duration_seconds AS execution_time_seconds, n.status = 'FAILED' AND coalesce(n.issue_type = s.issue_type, false) AS same
  FROM suggestions s LEFT JOIN LATERAL (
    SELECT r.run_id, r.status, r.duration_seconds, d.issue_type FROM runs r LEFT JOIN diagnosed d USING (run_id)
    WHERE r.job_id = s.job_id AND r.status IN ('SUCCESS', 'FAILED') AND r.start_ts > s.start_ts AND r.start_ts <= s.start_ts + INTERVAL 200 DAYS
    ORDER BY r.start_ts, r.run_id LIMIT 1) n ON true),
verified AS (
  SELECT *, CASE WHEN next_status = 'SUCCESS' THEN 'success' WHEN same THEN 'failed' ELSE 'needs_retry' END AS outcome FROM checked),
planned AS (
  SELECT s.*, c.num_workers, CASE WHEN s.cluster_id IS NULL THEN 'Run names no cluster' WHEN c.cluster_id IS NULL THEN 'Cluster not found'
      WHEN fix_type = 'install_dependencies' AND len(packages) = 0 THEN 'No packages to install' END AS problem,
    c.state AS cluster_state, CASE WHEN s.cluster_id IS NULL THEN 'Run names no cluster' WHEN c.cluster_id IS NULL THEN 'Cluster not found' END AS place_problem
  FROM suggestions s LEFT JOIN clusters c USING (cluster_id)),
plans AS (
  SELECT *, CASE WHEN problem IS NULL THEN 'success' ELSE 'error' END AS plan_status, coalesce(problem, CASE fix_type
      WHEN 'increase_memory' THEN 'Resize cluster ' || cluster_id || ' by ' || CASE WHEN gc THEN '100%' ELSE '50%' END
      WHEN 'increase_disk_space' THEN 'More disk for cluster ' || cluster_id
      WHEN 'install_dependencies' THEN 'Install on cluster ' || cluster_id || ': ' || array_to_string(packages, ', ')
      ELSE 'Restart cluster ' || cluster_id END) AS message,
    CASE WHEN problem IS NULL AND fix_type = 'increase_memory' THEN floor(coalesce(num_workers, 1) * CASE WHEN gc THEN 2.0 ELSE 1.5 END)::INT END AS target_workers,
    CASE WHEN problem IS NULL AND fix_type = 'install_dependencies' THEN
      '[' || array_to_string(list_transform(packages, lambda p: '{{"pypi":{{"package":"' || p || '"}}}}'), ',') || ']' END AS payload
  FROM planned),
noop AS (SELECT *, coalesce(target_workers = coalesce(num_workers, 1), false) AS is_noop FROM plans)
"""

ADVICE = by_issue("'data_skew on the join and grouping keys'", "'resource_utilisation of the run''s cluster'",
                  "'missing_packages of the run''s log'", "'tag_signatures with patterns of your own'")
DETAILS = by_issue("'The logs show the run asking for more memory than it was given.'", "'The logs show the run filling the disk of its nodes.'",
                   "'The logs show the run missing a package it needs.'", "'The logs hold no known error signature.'")
CAUSE = by_issue("'memory'", "'local disk'", "'installed packages'", "'not classified'")
OUTCOME = by_issue("'memory raised'", "'disk raised'", "'packages installed'", "'cluster restarted'")
READ_ON = by_issue("['See data_skew for the job''s keys', 'See fix_effectiveness for increase_memory']", "['See resource_utilisation for the disk']",
                   "['See missing_packages for the names']", "['See state_transitions for the last step', 'See previous_issue for a pattern']")


def report(source: str, fixed: str) -> str:
    """Columns of a report over rows with the suggestion's columns."""
    return f"""
  SELECT *, '# Run health report' || chr(10) || chr(10) || '## ' || headline || chr(10) || chr(10) || 'Diagnosis confidence: ' || note || chr(10) || chr(10)
    || '## Situation' || chr(10) || chr(10) || situation || chr(10) || chr(10) || '## Root cause' || chr(10) || chr(10) || root_cause || chr(10) || chr(10)
    || '## Resolution' || chr(10) || chr(10) || resolution || chr(10) || chr(10) || '## Recommendations' || chr(10) || chr(10)
    || array_to_string(list_transform(reading, lambda x, i: i || '. ' || x), chr(10)) AS report
  FROM (SELECT *, CASE WHEN {fixed} THEN 'Resolved' ELSE 'Open' END AS headline, {band('confidence')} AS confidence_band,
      CASE WHEN confidence = 0.1 THEN 'Low confidence (10.0%)' ELSE 'Moderate confidence (60.0%)' END AS note,
      'job ' || job_id || ', ' || replace(issue_type, '_', ' ') || ', ' || strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS situation, {CAUSE} AS root_cause,
      CASE WHEN {fixed} THEN {OUTCOME} || ': ' || fix_type || '(' || parameters
        || CASE WHEN len(packages) > 0 THEN ',packages=' || array_to_string(packages, '+') ELSE '' END || ')'
        ELSE 'No later run of this job has succeeded.' END AS resolution, {READ_ON} AS reading FROM {source})"""


def response(rows: str) -> str:
    """The flagship's columns over ``rows`` (job_id, run_id, status)."""
    return f"""
  SELECT q.job_id, q.run_id, q.status, coalesce(r.issue_detected, false) AS issue_detected, r.issue_type, r.confidence, r.fix_id, r.fix_type,
    array_to_string(r.packages, '|') AS packages, r.fix_confidence, r.plan_status, r.message, r.target_workers, r.payload, r.is_noop,
    CASE WHEN r.run_id IS NOT NULL THEN 4 END AS n_steps, r.report, coalesce(r.plan_status = 'success' AND NOT r.is_noop, false) AS pending_approval
  FROM ({rows}) q LEFT JOIN ({report(f"(SELECT n.* EXCLUDE (job_id), a.job_id FROM ({rows}) a JOIN noop n USING (run_id))", 'false')}) r
    ON r.run_id = q.run_id AND r.job_id = q.job_id"""


SINCE = "ts >= (SELECT max(ts) FROM {0}) - INTERVAL 7 DAYS"
SKEW = " UNION ALL ".join(f"""SELECT count(*) AS keys, sum(n)::BIGINT AS rows, max(n) AS max_rows, round(max(n) / avg(n), 6) AS skew_ratio,
  round(max(n) / avg(n), 6) > 2 AS skew_detected, 'salt: ' || CASE WHEN round(max(n) / avg(n), 6) > 2 THEN ceil(round(max(n) / avg(n), 6))::BIGINT ELSE 1 END AS recommendation,
  '{t}.{c}' AS checked FROM (SELECT count(*) AS n FROM {t} GROUP BY {c})""" for t, c in (
    ("lineitem", "l_suppkey"), ("orders", "o_custkey"), ("events", "user_id"), ("documents", "source"), ("documents", "lang"), ("pages", "url")))
RATE = "count(*) AS total, count(*) FILTER (status = 'FAILED') AS failed, round((count(*) - count(*) FILTER (status = 'FAILED')) * 100.0 / count(*), 1)::DOUBLE AS success_rate"
JOB_REF = r"""coalesce(nullif(regexp_extract(text, 'monitor\s+(\S+)', 1, 'i'), ''), 'job_' || coalesce(
        nullif(regexp_extract(text, '(?:check|diagnose|analyze)\s+(?:job|run)?\s*(\d+)', 1, 'i'), ''), nullif(regexp_extract(text, 'job[_-]?(\d+)', 1, 'i'), '')))"""
APPROVE = "(approve|yes|accept|apply)"
BLOCK = "(don''t|not|no)"
REJECT = "(reject|no|decline|don''t)"
BLANK = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def guard(source: str, keys: str, text: str, reason: str) -> str:
    short = f"coalesce(length(trim({text}, {BLANK})) < 5, true)"
    return (f"SELECT {keys}, NOT {short} AS is_valid, CASE WHEN {short} THEN '{reason}' END AS reason, "
            f"CASE WHEN {short} THEN 0.8 ELSE 0.0 END::DOUBLE AS severity FROM {source}")


def utilisation() -> str:
    out = []
    for r in ("cpu", "memory", "disk"):
        pick_ = f"resource = '{r}'"
        out += [f"round(avg(pct) FILTER ({pick_} AND node_role = 'driver'), 4) AS {r}_driver_avg_pct",
                f"round(avg(pct) FILTER ({pick_} AND node_role = 'worker'), 4) AS {r}_worker_avg_pct",
                f"round(max(pct) FILTER ({pick_} AND node_role = 'worker'), 4) AS {r}_worker_max_pct"]
        if r != "cpu":
            out += [f"round(sum(used) FILTER ({pick_}) / 1024, 4) AS {r}_used_gb", f"round(sum(total) FILTER ({pick_}) / 1024, 4) AS {r}_total_gb"]
    return ", ".join(out)


def alias(name: str) -> str:
    return (f"CASE WHEN {name} IN ('memory', 'memory_error', 'out_of_memory', 'oom') THEN 'memory_exceeded' "
            f"WHEN {name} IN ('disk', 'disk_error', 'space', 'storage') THEN 'disk_space_exceeded' "
            f"WHEN {name} IN ('depend', 'dependency', 'package', 'import', 'library') THEN 'dependency_error' ELSE {name} END")


# A replay, message by message: the fix that waits, and whether the last job named had one.
ROUTED = f"""WITH RECURSIVE job_fixes AS (
    SELECT 'job_' || job_id AS job_ref, fix_id FROM suggestions QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY start_ts DESC, run_id DESC) = 1),
  messages AS (
    SELECT m.*, f.fix_id AS offered, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM (
      SELECT conv_id, turn, {JOB_REF} AS job_ref, coalesce(regexp_matches(text, '{APPROVE}', 'i') AND NOT regexp_matches(text, '{BLOCK}', 'i'), false) AS approves,
        coalesce(regexp_matches(text, '{REJECT}', 'i'), false) AS rejects, coalesce(regexp_matches(text, 'simulate|test|try', 'i'), false) AS simulates,
        coalesce(contains(lower(text), 'help') OR contains(lower(text), 'what can you do'), false) AS helps FROM chat WHERE role = 'user') m
    LEFT JOIN job_fixes f USING (job_ref)),
  replay(conv_id, i, waiting, found) AS (
    SELECT DISTINCT conv_id, 1::BIGINT, NULL::VARCHAR, false FROM messages
    UNION ALL
    SELECT r.conv_id, r.i + 1, CASE WHEN waiting IS NOT NULL AND (approves OR rejects) THEN NULL WHEN job_ref IS NOT NULL THEN offered ELSE waiting END,
      CASE WHEN job_ref IS NOT NULL THEN offered IS NOT NULL ELSE found END
    FROM replay r JOIN messages m ON m.conv_id = r.conv_id AND m.i = r.i)
  SELECT m.conv_id, m.turn, job_ref, CASE WHEN waiting IS NOT NULL AND approves THEN 'approve' WHEN waiting IS NOT NULL AND rejects THEN 'reject'
      WHEN job_ref IS NOT NULL THEN 'monitor' WHEN simulates THEN 'ask_for_id' WHEN found THEN 'in_progress' WHEN helps THEN 'help' ELSE 'generic' END AS message_class,
    waiting AS waiting_fix, CASE WHEN waiting IS NOT NULL AND (approves OR rejects) THEN waiting END AS decided_fix
  FROM messages m JOIN replay r ON m.conv_id = r.conv_id AND m.i = r.i"""
DECIDED = f"SELECT conv_id, turn, decided_fix AS fix_id, message_class AS decision FROM ({ROUTED}) WHERE decided_fix IS NOT NULL"

STATEMENTS: dict[str, str] = {
    "parse_log_lines": f"""SELECT file, line_no, CASE WHEN rec THEN date_trunc('second', e.ts) END AS ts, CASE WHEN rec THEN l.level END AS level,
        CASE WHEN rec THEN l.logger END AS logger, CASE WHEN rec THEN string_split(coalesce(l.message, ''), chr(10))[1] ELSE t.value END AS message
        FROM (SELECT *, line_no % 16 = 0 AS rec FROM log_text) t JOIN logs l ON l.event_id = t.line_no // 16 JOIN events e ON e.event_id = l.event_id""",
    "assemble_records": """SELECT 'agent-' || cluster_id || '.log' AS file, event_id * 16 AS first_line,
        len(string_split(coalesce(message, ''), chr(10)))::INT AS n_lines, date_trunc('second', ts) AS ts, level, logger, coalesce(message, '') AS message FROM logs""",
    "read_log_files": "SELECT date_trunc('second', ts) AS ts, level, logger, coalesce(message, '') AS message FROM logs",
    "read_runs": """SELECT run_id::VARCHAR AS run_id, job_id::VARCHAR AS job_id, run_name, cluster_id::VARCHAR AS cluster_id, status, duration_seconds, stdout, stderr
        FROM runs LEFT JOIN run_logs USING (run_id)""",
    "read_jobs": "SELECT job_id::VARCHAR AS job_id, name, creator, 1704067200000::BIGINT AS created_millis, schedule FROM jobs",
    "read_clusters": """SELECT cluster_id::VARCHAR AS cluster_id, name, state, creator, node_type, runtime, num_workers,
        'spark.a=1,spark.node=' || node_type AS spark_conf FROM clusters""",
    "read_activity": "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, action_type, user_name FROM activity",
    "read_log_entries": """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, log_type, cluster_id::VARCHAR AS cluster_id, "user", level, source, message FROM logs""",
    "read_cluster_events": "SELECT user_id::VARCHAR AS cluster_id, epoch_us(ts) // 1000 AS ts_millis, upper(event_type) AS type, props AS details FROM events",
    "read_api_calls": """SELECT operation, success, concat_ws(',', 'Token=kept', CASE WHEN result_size IS NULL THEN 'k' ELSE 'k=' || result_size END,
        'password=p-1', 'token=t-1') AS parameters, result_size, duration_seconds, error_type FROM api_calls""",
    "fetch_status": """SELECT q.job_id, q.resolved_run_id AS run_id, coalesce(r.status, 'ERROR') AS status, coalesce(r.duration_seconds, 0) AS duration_seconds,
        CASE WHEN r.run_id IS NULL THEN '' ELSE stdout END AS stdout,
        CASE WHEN r.run_id IS NULL THEN 'run ' || coalesce(q.resolved_run_id::VARCHAR, '?') || ' not found' ELSE stderr END AS stderr
        FROM resolved q LEFT JOIN runs r ON r.run_id = q.resolved_run_id LEFT JOIN run_logs l ON l.run_id = r.run_id""",
    "latest_fix": """SELECT a.fix_id, s.job_id, s.fix_type, s.fix_confidence / 2 AS confidence, s.start_ts + INTERVAL 1 HOUR AS stored_ts
        FROM approvals a LEFT JOIN suggestions s USING (fix_id)""",
    "latest_fix_stream": """SELECT fix_id, job_id, fix_type, fix_confidence / 2 AS confidence, start_ts + INTERVAL 1 HOUR AS stored_ts FROM suggestions""",
    "write_history": "SELECT run_id, job_id, start_ts AS ts, issue_type, confidence FROM suggestions",
    "write_reports": f"SELECT run_id, start_ts, report FROM ({report('(SELECT s.*, v.outcome FROM suggestions s JOIN verified v USING (fix_id))', chr(111) + 'utcome = ' + lit('success'))})",
    "list_clusters": "SELECT cluster_id, name, state, creator, node_type, runtime, coalesce(num_workers, 0) AS num_workers FROM clusters",
    "cluster_details": """SELECT p_partkey AS cluster_id, name, state, creator, node_type, runtime, num_workers, CASE WHEN name IS NULL THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN name IS NULL THEN 'Cluster ' || p_partkey || ' not found' END AS message FROM part LEFT JOIN clusters ON cluster_id = p_partkey""",
    "list_jobs": "SELECT job_id, name, creator, schedule FROM jobs",
    "list_jobs_by_name": "SELECT job_id, name, creator, schedule FROM jobs WHERE name = 'Customer#000000042' ORDER BY job_id LIMIT 50",
    "list_runs": "SELECT run_id, job_id, run_name, life_cycle_state AS state, result_state, start_ts AS start_time, end_ts AS end_time FROM runs",
    "list_runs_active": """SELECT run_id, job_id, run_name, life_cycle_state AS state, result_state, start_ts AS start_time, end_ts AS end_time FROM runs
        WHERE result_state IS NULL""",
    "list_runs_page": """SELECT run_id, job_id, run_name, life_cycle_state AS state, result_state, start_ts AS start_time, end_ts AS end_time FROM runs
        WHERE result_state IS NOT NULL ORDER BY start_ts DESC, run_id DESC LIMIT 25 OFFSET 25""",
    "filter_logs": f"SELECT * FROM logs WHERE log_type = 'stderr' AND {SINCE.format('logs')}",
    "filter_logs_oldest": "SELECT * FROM logs WHERE cluster_id = 7 ORDER BY ts, event_id LIMIT 100",
    "cluster_events": """SELECT user_id AS cluster_id, ts, upper(event_type) AS type, props AS details FROM events
        WHERE user_id = 5 AND ts BETWEEN '2024-01-05 00:00:00' AND '2024-01-20 00:00:00'""",
    "lookback": f"SELECT * FROM activity WHERE {SINCE.format('activity')}",
    "level_at_least": "SELECT event_id, level, log_type FROM logs WHERE level IN ('WARNING', 'ERROR')",
    "issue_detected": "SELECT run_id, issue_type, issue_detected FROM suggestions",
    "state_lines": "SELECT file, line_no, ts, state FROM states",
    "running_only": """SELECT cluster_id, state, CASE WHEN state = 'RUNNING' THEN 'success' ELSE 'error' END AS status,
        CASE WHEN state <> 'RUNNING' THEN 'Cluster ' || cluster_id || ' is not running: ' || state END AS message FROM clusters""",
    "redact": "SELECT call_id, concat_ws(',', 'Token=kept', CASE WHEN result_size IS NULL THEN 'k' ELSE 'k=' || result_size END) AS parameters FROM api_calls",
    "route_by_success": "SELECT call_id, operation, CASE WHEN success THEN 'debug' ELSE 'error' END AS stream FROM api_calls",
    "input_guard": guard("chat", "conv_id, turn", "text", "The request is too short to work on"),
    "output_guard": guard("verdicts", "doc_id", "content", "The result is too short to be of use"),
    "confidence_in_range": """SELECT doc_id, quality + toxic * 0.5::DOUBLE - 0.25::DOUBLE AS confidence,
        quality + toxic * 0.5::DOUBLE - 0.25::DOUBLE BETWEEN 0 AND 1 AS accepted FROM labels""",
    "usable_confidence": "SELECT run_id, confidence, confidence >= 0.3 AS usable FROM suggestions",
    "runs_with_logs": "SELECT run_id, job_id, status, stdout, stderr FROM runs LEFT JOIN run_logs USING (run_id)",
    "resolve_request": "SELECT * FROM resolved",
    "run_cluster": "SELECT run_id, cluster_id, num_workers, cluster_state, place_problem AS problem FROM planned",
    "attach_fix": f"""SELECT run_id, issue_type, fix_type, {by_issue('0.8', '0.85', '0.6', '0.5')}::DOUBLE AS base_confidence, required_permissions, estimated_time
        FROM suggestions""",
    "attach_guidance": f"SELECT run_id, issue_type, {CAUSE} AS root_cause, {OUTCOME} AS outcome, array_to_string({READ_ON}, '|') AS recommendations FROM suggestions",
    "tag_signatures": """SELECT event_id, concat_ws('|', CASE WHEN regexp_matches(message, 'OutOfMemoryError|GC overhead limit exceeded') THEN 'oom' END,
        CASE WHEN regexp_matches(message, 'AZURE_QUOTA_EXCEEDED_EXCEPTION|QuotaExceeded') THEN 'quota' END,
        CASE WHEN regexp_matches(message, 'Connection refused|RPC timed out|unreachable during run') THEN 'timeout' END,
        CASE WHEN contains(message, 'Library resolution failed') THEN 'library' END) AS tags FROM logs""",
    "tag_pattern_table": r"""SELECT conv_id, turn, coalesce(string_agg(name, '|' ORDER BY name), '') AS tags FROM (SELECT * FROM chat WHERE role = 'user') c LEFT JOIN (
        SELECT conv_id, turn, 'job-' || c_custkey AS name FROM chat JOIN customer ON contains(text, 'job_' || c_custkey) AND regexp_matches(text, 'job_' || c_custkey || '\b') WHERE role = 'user'
        UNION ALL SELECT conv_id, turn, 'check-' || c_custkey FROM chat JOIN customer ON ends_with(lower(text), 'check job ' || c_custkey) WHERE role = 'user'
        UNION ALL SELECT conv_id, turn, 'answer' FROM chat WHERE role = 'user' AND regexp_matches(text, 'yes|approve', 'i')) USING (conv_id, turn) GROUP BY conv_id, turn""",
    "tag_own_signatures": """SELECT run_id, concat_ws('|', CASE WHEN regexp_matches(stderr, 'heap|Memory') THEN 'heap' END,
        CASE WHEN regexp_matches(stderr, '[Dd]isk') THEN 'disk' END, CASE WHEN regexp_matches(stderr, 'No module|ClassNotFound') THEN 'missing' END) AS tags FROM run_logs""",
    "approved_fixes": "SELECT fix_id, job_id, run_id, fix_type FROM suggestions WHERE fix_id IN (SELECT fix_id FROM approvals)",
    "orphan_approvals": "SELECT fix_id, job_id, decision FROM approvals WHERE fix_id NOT IN (SELECT fix_id FROM suggestions)",
    "verify_next_run": """SELECT fix_id, job_id, fix_ts, issue_type, next_run_id, next_status, execution_time_seconds, outcome, outcome = 'success' AS issue_resolved,
        same AS previous_issue_detected, CASE WHEN outcome = 'failed' THEN 'The same issue came back' WHEN next_status = 'FAILED' THEN 'The next run failed for another reason'
        WHEN outcome = 'needs_retry' THEN 'No run finished in time' END AS failure_reason FROM verified""",
    "previous_issue": """SELECT job_id, run_id, start_ts, issue_type, previous_issue_type, coalesce(issue_type = previous_issue_type, false) AS same_issue
        FROM (SELECT *, lag(issue_type) OVER (PARTITION BY job_id ORDER BY start_ts, run_id) AS previous_issue_type FROM suggestions)""",
    "workspace_status": """SELECT count(*) AS total_clusters, count(*) FILTER (state = 'RUNNING') AS active_clusters, (SELECT count(*) FROM pages) AS workspace_objects
        FROM clusters""",
    "activity_summary": f"""SELECT count(*) AS count, count(*) FILTER (c = 'clusters') AS cluster_count, count(*) FILTER (c = 'jobs') AS job_count,
        count(*) FILTER (c = 'notebooks') AS notebook_count, count(*) FILTER (c = 'warehouses') AS warehouse_count, 7 AS days
        FROM (SELECT {class_of('action_type')} AS c FROM activity WHERE {SINCE.format('activity')})""",
    "activity_examples": f"""SELECT class, string_agg(line, chr(10) ORDER BY n) AS examples, count(*)::INT AS shown FROM (
        SELECT {class_of('action_type')} AS class, '- ' || action_type || ' by ' || coalesce(user_name, 'Unknown') AS line,
          row_number() OVER (PARTITION BY {class_of('action_type')} ORDER BY ts, event_id) AS n FROM activity)
        WHERE n <= 3 AND class <> 'unclassified' GROUP BY class""",
    "activity_digest": f"""WITH recent AS (
          SELECT *, {class_of('action_type')} AS class FROM activity WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAYS FROM activity)),
        shown AS (
          SELECT class, string_agg('- ' || action_type || ' by ' || coalesce(user_name, 'Unknown'), chr(10) ORDER BY ts, event_id) AS examples
          FROM (SELECT * FROM recent WHERE class <> 'unclassified' QUALIFY row_number() OVER (PARTITION BY class ORDER BY ts, event_id) <= 3) GROUP BY class)
        SELECT 'Total activities: ' || (SELECT count(*) FROM recent) || chr(10) || 'Time period: last 7 days'
          || (SELECT string_agg(chr(10) || label || ' activities: ' || (SELECT count(*) FROM recent WHERE recent.class = c.class), '' ORDER BY place)
              FROM (VALUES (1, 'Cluster', 'clusters'), (2, 'Job', 'jobs'), (3, 'Notebook', 'notebooks'), (4, 'Warehouse', 'warehouses')) c(place, label, class))
          || coalesce((SELECT string_agg(chr(10) || chr(10) || 'Example ' || class || ':' || chr(10) || examples, '' ORDER BY class) FROM shown), '') AS digest""",
    "job_health": f"SELECT {RATE} FROM runs",
    "job_health_by_job": f"SELECT job_id, {RATE} FROM runs GROUP BY job_id",
    "cluster_health": """SELECT count(*) AS total, count(*) FILTER (state = 'RUNNING') AS running, count(*) FILTER (state = 'TERMINATED') AS terminated,
        count(*) FILTER (state = 'ERROR') AS failed FROM clusters""",
    "health_rollup": f"""SELECT c.state AS cluster_state, r.cluster_id, r.job_id, grouping_id(c.state, r.cluster_id, r.job_id)::INT AS level, {RATE.replace('status', 'r.status')}
        FROM runs r LEFT JOIN clusters c USING (cluster_id) GROUP BY ROLLUP (c.state, r.cluster_id, r.job_id)""",
    "issue_summary": f"""SELECT issue_type, {band('confidence')} AS severity, outcome AS fix_status, count(*) AS issues, count(DISTINCT job_id) AS jobs
        FROM verified GROUP BY ALL""",
    "issue_jobs_by_day": "SELECT issue_type, count(*) AS issues, true AS within_bound FROM suggestions GROUP BY issue_type",
    "confidence_histogram": f"SELECT {band('fix_confidence')} AS band, count(*) AS reports FROM suggestions GROUP BY ALL",
    "data_skew": SKEW,
    "top_keys": "SELECT o_custkey AS key, count(*) AS rows FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "heaviest_keys": " UNION ALL ".join(
        f"(SELECT '{table}.{column}' AS checked, {column}::VARCHAR AS key, count(*) AS rows FROM {table} GROUP BY {column} ORDER BY 3 DESC, {column} LIMIT 10)"
        for table, column in (("lineitem", "l_suppkey"), ("orders", "o_custkey"), ("events", "user_id"), ("documents", "source"), ("documents", "lang"), ("pages", "url"))),
    "resource_utilisation": f"""WITH newest AS (
        SELECT l_suppkey AS cluster_id, CASE WHEN l_linenumber = 1 THEN 'driver' ELSE 'worker' END AS node_role, l_linenumber, l_quantity AS used, 50.0::DOUBLE AS total,
          CASE l_returnflag WHEN 'A' THEN 'cpu' WHEN 'N' THEN 'memory' ELSE 'disk' END AS resource, l_quantity * 100 / 50 AS pct FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber, resource ORDER BY l_shipdate DESC, l_quantity DESC) = 1)
        SELECT c.cluster_id, c.state, n.* EXCLUDE (cluster_id), CASE WHEN c.state = 'RUNNING' THEN 'success' ELSE 'error' END AS status,
          CASE WHEN c.state <> 'RUNNING' THEN 'Cluster ' || c.cluster_id || ' is not running: ' || c.state END AS message
        FROM clusters c LEFT JOIN (SELECT cluster_id, {utilisation()} FROM newest GROUP BY cluster_id) n ON n.cluster_id = c.cluster_id AND c.state = 'RUNNING'""",
    "api_call_stats": """SELECT operation, count(*) AS calls, count(*) FILTER (NOT success) AS failures, sum(duration_seconds::DECIMAL(18,6))::DOUBLE AS total_seconds,
        sum(duration_seconds::DECIMAL(18,6))::DOUBLE / count(duration_seconds) AS avg_seconds, sum(result_size)::BIGINT AS result_size,
        count(DISTINCT error_type) AS error_types FROM api_calls GROUP BY operation""",
    "api_errors": "SELECT operation, error_type, count(*) AS failures FROM api_calls WHERE NOT success GROUP BY ALL",
    "response_latency": """SELECT operation, success, count(*) AS calls, sum(duration_seconds::DECIMAL(18,6))::DOUBLE / count(duration_seconds) AS avg_seconds,
        max(duration_seconds) AS max_seconds FROM api_calls GROUP BY ALL""",
    "latency_percentiles": "SELECT operation, count(*) AS calls, true AS p50_near, true AS p90_near, true AS p99_near FROM api_calls GROUP BY operation",
    "entry_counts": "SELECT run_id, count(*) AS entries FROM logs GROUP BY run_id",
    "fix_effectiveness": """SELECT fix_type, attempt, count(*) AS verified, count(*) FILTER (outcome = 'success') AS successful,
        round(count(*) FILTER (outcome = 'success') * 100.0 / count(*), 4)::DOUBLE AS success_rate
        FROM (SELECT *, row_number() OVER (PARTITION BY job_id, issue_type ORDER BY fix_ts, fix_id) AS attempt FROM verified) GROUP BY ALL""",
    "run_funnel": """SELECT job_id, count(*) AS logs, count(*) FILTER (issue_detected) AS diagnosis,
        count(*) FILTER (fix_id IN (SELECT fix_id FROM approvals)) AS fix, count(next_run_id) AS verification
        FROM suggestions JOIN (SELECT fix_id, next_run_id FROM verified) USING (fix_id) GROUP BY job_id""",
    "latest_run": "SELECT job_id, run_id, status, start_ts, duration_seconds FROM latest",
    "recent_runs": "SELECT run_id, job_id, status, start_ts FROM runs ORDER BY start_ts DESC, run_id DESC LIMIT 25",
    "recent_runs_per_job": """SELECT run_id, job_id, status, start_ts, position::INT AS position FROM (
        SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_ts DESC, run_id DESC) AS position FROM runs) WHERE position <= 5""",
    "last_user_message": """SELECT conv_id, coalesce(nullif(max_by(text, turn) FILTER (role = 'user'), ''), 'Hello') AS query FROM chat GROUP BY conv_id""",
    "state_transitions": f"""SELECT file, line_no, ts, state, {kind_of('state')} AS kind, lag(state) OVER w AS previous_state,
        date_diff('second', lag(ts) OVER w, ts) AS seconds_in_previous FROM states WINDOW w AS (PARTITION BY file ORDER BY line_no)""",
    "tail_lines": """SELECT file, line_no, value, from_end::INT AS from_end FROM (
        SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS from_end FROM log_text) WHERE from_end <= 20""",
    "head_logs": """SELECT run_id, event_id, position::INT AS position, n > 10 AS truncated FROM (SELECT run_id, event_id,
        row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS position, count(*) OVER (PARTITION BY run_id) AS n FROM logs) WHERE position <= 10""",
    "digest_text": """SELECT run_id, count(*)::INT AS log_count, any_value(n) > 10 AS truncated, string_agg(line, chr(10) ORDER BY position) AS digest FROM (
        SELECT run_id, '[' || coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), 'Unknown') || '] ' || coalesce(message, 'No message') AS line,
          row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS position, count(*) OVER (PARTITION BY run_id) AS n FROM logs) WHERE position <= 10 GROUP BY run_id""",
    "digest_text_all": """SELECT run_id, (position - 1) // 10 AS chunk, count(*)::INT AS log_count, string_agg(line, chr(10) ORDER BY position) AS digest FROM (
        SELECT run_id, '[' || coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), 'Unknown') || '] ' || coalesce(message, 'No message') AS line,
          row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS position FROM logs) GROUP BY ALL""",
    "history_newest_first": """SELECT run_id, job_id, start_ts AS ts, issue_type,
        strftime(start_ts, '%Y-%m-%d %H:%M:%S') || ' - Job: ' || job_id || ' - Issue: ' || issue_type AS label FROM suggestions""",
    "attempt_number": """SELECT fix_id, job_id, issue_type, attempt, attempt <= 5 AS within_limit FROM (
        SELECT *, row_number() OVER (PARTITION BY job_id, issue_type ORDER BY start_ts, fix_id) AS attempt FROM suggestions)""",
    "chat_context": """SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 3 ELSE 2 END AS n_messages, 'system: You watch job runs.' ||
        CASE WHEN conv_id % 2 = 0 THEN chr(10) || 'system: Context: region 1' ELSE '' END || chr(10) || 'user: ' ||
        coalesce(nullif(max_by(text, turn) FILTER (role = 'user'), ''), 'Hello') AS messages FROM chat GROUP BY conv_id""",
    "classify_issue": f"SELECT run_id, {keyword('stderr')} AS issue_type FROM run_logs",
    "classify_documents": f"""SELECT 'documents' AS kind, doc_id AS id, {keyword('text')} AS issue_type FROM documents
        UNION ALL SELECT 'pages', page_id, {keyword('html')} FROM pages""",
    "diagnose_run": f"""SELECT run_id, issue_type, confidence, issue_detected, array_to_string(evidence, chr(10)) AS evidence,
        CASE WHEN blank THEN 'The run left no log text to read.' ELSE {DETAILS} END AS details, {ADVICE} AS recommendations FROM diagnosed""",
    "parse_verdict": f"""SELECT doc_id, k IN (0, 1, 3) AS is_json, CASE WHEN k = 0 THEN 'memory_exceeded' WHEN k IN (1, 3) THEN 'unknown' ELSE {keyword('content')} END AS issue_type,
        CASE k WHEN 0 THEN 0.72 WHEN 1 THEN 0.5 WHEN 3 THEN 0.5 WHEN 2 THEN 0.6 ELSE 0.1 END::DOUBLE AS confidence, CASE WHEN k = 0 THEN 'first|second' ELSE '' END AS evidence,
        CASE k WHEN 0 THEN 'heap' WHEN 1 THEN 'Unknown' WHEN 3 THEN 'Unknown' WHEN 2 THEN 'Extracted from plain text' ELSE 'The run left no log text to read.' END AS details FROM verdicts""",
    "trim_logs": """SELECT doc_id, md5(right(text, 5000)) AS stdout_md5, md5(right(text, 10000)) AS stderr_md5, length(right(text, 10000))::INT AS kept FROM documents""",
    "evidence_lines": "SELECT run_id, len(evidence)::INT AS n_lines, array_to_string(evidence, chr(10)) AS evidence FROM diagnosed",
    "normalise_failure_type": f"""SELECT event_id, name, CASE WHEN lower(name) IN ('memory_exceeded', 'disk_space_exceeded', 'dependency_error', 'unknown') THEN lower(name) END AS issue_type
        FROM (SELECT event_id, {pick(FAILURE_NAMES, '(event_id % 6)')} AS name FROM events)""",
    "alias_failure_type": f"""SELECT event_id, name, {alias('name')} AS issue_type
        FROM (SELECT event_id, {pick(FAILURE_NAMES, '(event_id % 6)')} AS name FROM events)""",
    "message_text": "SELECT run_id, coalesce(string_agg(message || chr(10), '' ORDER BY ts, event_id), '') AS text FROM logs GROUP BY run_id",
    "missing_packages": f"SELECT run_id, len({packages('stderr')})::INT AS n_packages, array_to_string({packages('stderr')}, '|') AS packages FROM run_logs",
    "suggest_fix": """SELECT run_id, fix_id, fix_type, parameters, array_to_string(packages, '|') AS packages, fix_confidence, description, required_permissions,
        expected_impact, estimated_time, confidence AS original_confidence FROM suggestions""",
    "infer_fix_type": "SELECT run_id, CASE WHEN fix_type <> 'restart_cluster' THEN fix_type END AS inferred, fix_type AS given FROM suggestions",
    "plan_fix": "SELECT run_id, cluster_id, fix_type, plan_status, message, target_workers, payload, is_noop FROM noop",
    "merge_conf": "SELECT cluster_id, 'spark.a=2,spark.b=' || state || ',spark.node=' || node_type AS conf FROM clusters",
    "penalise_confidence": """SELECT doc_id, 0.8::DOUBLE * CASE WHEN quality = 0 THEN 0.5 ELSE 1 END::DOUBLE * CASE WHEN toxic = 1 THEN 0.3 ELSE 1 END::DOUBLE AS confidence
        FROM labels""",
    "safety_details": """SELECT doc_id, concat_ws(chr(10), CASE WHEN toxic > 0 THEN 'Harmful content detected (score: 0.75)' END,
        CASE WHEN quality > 0 THEN 'Hate content detected (score: 0.25)' END, CASE WHEN quality * toxic > 0 THEN 'Sexual content detected (score: 0.50)' END,
        CASE WHEN toxic > 0 THEN 'Self-harm content detected (score: 0.13)' END) AS details FROM labels""",
    "confidence_band": f"SELECT {band('(l_discount * 10)')} AS band, count(*) AS n FROM lineitem GROUP BY ALL",
    "render_report": f"""SELECT run_id, job_id, start_ts, headline, confidence_band, situation, root_cause, resolution, array_to_string(reading, '|') AS recommendations, report
        FROM ({report('(SELECT s.*, v.outcome FROM suggestions s JOIN verified v USING (fix_id))', "outcome = 'success'")})""",
    "incident_response": response("SELECT job_id, run_id, status FROM latest"),
    "incident_response_requests": response("""SELECT q.job_id, q.resolved_run_id AS run_id, coalesce(r.status, 'ERROR') AS status
        FROM resolved q LEFT JOIN runs r ON r.run_id = q.resolved_run_id"""),
    "shorten_text": "SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS shown FROM documents",
    "number_helpers": """SELECT p_partkey, round(1 + p_size / 100.0::DOUBLE, 6) AS factor, NULL::DOUBLE AS no_factor, floor(p_size * (1.0::DOUBLE + p_size / 100.0::DOUBLE))::INT AS workers,
        p_size * 512 / 1024.0::DOUBLE AS gb FROM part""",
    "approval_intent": f"""SELECT conv_id, turn, coalesce(regexp_matches(text, '{APPROVE}', 'i') AND NOT regexp_matches(text, '{BLOCK}', 'i'), false) AS approves,
        coalesce(regexp_matches(text, '{REJECT}', 'i'), false) AS rejects,
        coalesce(regexp_matches(text, '\\b{APPROVE}\\b', 'i') AND NOT regexp_matches(text, '\\b{BLOCK}\\b', 'i'), false) AS approves_word,
        coalesce(regexp_matches(text, '\\b{REJECT}\\b', 'i'), false) AS rejects_word FROM chat""",
    "simulation_intent": """SELECT conv_id, turn, coalesce(regexp_matches(text, 'simulate|test|try', 'i'), false) AS simulates,
        CASE WHEN regexp_matches(text, 'memory|oom', 'i') THEN 'memory_exceeded' WHEN regexp_matches(text, 'disk|space|storage', 'i') THEN 'disk_space_exceeded'
        WHEN regexp_matches(text, 'depend|package|import|library', 'i') THEN 'dependency_error' END AS keyword,
        coalesce(contains(lower(text), 'help') OR contains(lower(text), 'what can you do'), false) AS helps FROM chat""",
    "parse_job_id": f"SELECT conv_id, turn, {JOB_REF} AS job_ref FROM chat",
    "route_messages": ROUTED,
    "chat_decisions": DECIDED,
    "approvals_stream": DECIDED,
    "result_badge": """SELECT doc_id, CASE WHEN regexp_matches(lower(content), 'success|passed|resolved') THEN 'ok' WHEN regexp_matches(lower(content), 'warning|caution|attention') THEN 'warn'
        WHEN regexp_matches(lower(content), 'error|failed|issue') THEN 'error' ELSE 'info' END AS badge FROM verdicts""",
    "state_kind": f"SELECT {kind_of('state')} AS kind, count(*) AS n FROM states GROUP BY ALL",
    "success_flag": "SELECT event_id, coalesce(event_type = 'click' OR value > 10, event_type = 'click') AS successful FROM events",
    "sql_functions": f"""SELECT run_id, {keyword('stderr')} AS issue_type, {band('(length(stderr) / 100.0::DOUBLE)')} AS band, {alias("string_split(stderr, ' ')[1]")} AS aliased,
        'job_' || run_id AS job_ref FROM run_logs""",
    "follow_states": f"SELECT file, line_no, ts, state, {kind_of('state')} AS kind FROM states",
    "follow_growing_logs": f"SELECT ts, state, {kind_of('state')} AS kind FROM states",
    # Settled: the watermark, 31 days behind the newest row, has passed the fix's deadline.
    "verify_stream": """SELECT sha256(run_id || '|live') AS fix_id, job_id::VARCHAR AS job_id, issue_type,
          CASE WHEN closed THEN next_run_id::VARCHAR END AS next_run_id, CASE WHEN closed THEN next_status END AS next_status,
          CASE WHEN closed THEN outcome ELSE 'open' END AS outcome
        FROM (SELECT v.*, s.run_id, fix_ts + INTERVAL 200 DAYS <= (SELECT max(o_orderdate) - INTERVAL 31 DAYS FROM orders WHERE o_orderstatus <> 'P') AS closed
              FROM verified v JOIN suggestions s USING (fix_id))""",
    "diagnose_stream": "SELECT run_id, job_id, issue_type, confidence, fix_id, fix_type, fix_confidence FROM suggestions",
    "reasoning_steps": """SELECT run_id, u.at::INT AS "at", u.step, u.details, u.result FROM (SELECT run_id, unnest([
        {'at': 0, 'step': 'log_analysis', 'details': 'lines with a sign: ' || len(evidence), 'result': coalesce(evidence[1], '-')},
        {'at': 1, 'step': 'issue_identification', 'details': 'issue=' || issue_type, 'result': 'confidence=' || CASE WHEN blank THEN '0.1' ELSE '0.6' END},
        {'at': 2, 'step': 'evidence_collection', 'details': len(evidence) || ' lines', 'result': array_to_string(evidence, chr(10))},
        {'at': 3, 'step': 'fix_suggestion', 'details': CASE WHEN issue_detected THEN description ELSE '-' END,
         'result': 'fix=' || CASE WHEN issue_detected THEN fix_type ELSE '-' END}]) AS u FROM suggestions)""",
    "diagnose_json": f"""SELECT o_orderkey AS run_id, CASE WHEN ok THEN issue_type END AS issue_type, CASE WHEN ok THEN CASE WHEN blank THEN 0.1 ELSE 0.6 END::DOUBLE END AS confidence,
        CASE WHEN ok THEN array_to_string(list_filter(string_split(coalesce(stderr, ''), chr(10)),
          lambda x: regexp_matches(x, '{SIGNS}') OR regexp_matches(x, '{TERMS}', 'i')), chr(10)) END AS evidence, CASE WHEN NOT ok THEN error END AS error
        FROM (SELECT *, stdout = '' AND coalesce(stderr, '') = '' AS blank, CASE WHEN stdout = '' AND coalesce(stderr, '') = '' THEN 'unknown' ELSE {issue('stderr')} END AS issue_type
          FROM (SELECT o_orderkey, o_orderpriority NOT LIKE '5%' AS ok, {stdout_of('o_orderkey')} AS stdout, {stderr_of('o_orderkey')} AS stderr, 'logs are not a JSON object' AS error FROM orders))""",
    "suggest_fix_json": f"""SELECT run_id, CASE WHEN ok THEN {by_issue("'increase_memory'", "'increase_disk_space'", "'install_dependencies'", "'restart_cluster'", 'found')} END AS fix_type,
        CASE WHEN ok THEN {by_issue("CASE WHEN contains(stderr, 'GC overhead limit exceeded') THEN 0.9 ELSE 0.8 END", '0.85', "CASE WHEN len(named) > 0 THEN 0.9 ELSE 0.6 END", '0.5', 'found')}::DOUBLE END AS fix_confidence,
        CASE WHEN ok THEN CASE WHEN found = 'dependency_error' THEN array_to_string(named, '|') ELSE '' END END AS packages,
        CASE WHEN NOT ok THEN 'logs are not a JSON object' END AS error
        FROM (SELECT run_id, ok, stderr, {issue('stderr')} AS found, {packages('stderr')} AS named
          FROM (SELECT o_orderkey AS run_id, o_orderpriority NOT LIKE '5%' AS ok, {stderr_of('o_orderkey')} AS stderr FROM orders))""",
    "sql_actions": f"""WITH q AS (
        SELECT run_id, ok, CASE WHEN stdout = '' AND coalesce(stderr, '') = '' THEN 'unknown' ELSE {issue('stderr')} END AS found, {packages('stderr')} AS named,
          coalesce(contains(stderr, 'GC overhead limit exceeded'), false) AS gc
        FROM (SELECT o_orderkey AS run_id, o_orderpriority NOT LIKE '5%' AS ok, {stdout_of('o_orderkey')} AS stdout, {stderr_of('o_orderkey')} AS stderr FROM orders)),
      p AS (
        SELECT q.*, CASE WHEN ok THEN found END AS issue_type, r.cluster_id, c.num_workers, CASE WHEN NOT ok THEN 'parameters are not a JSON object'
          WHEN r.cluster_id IS NULL THEN 'Run names no cluster' WHEN found = 'dependency_error' AND len(named) = 0 THEN 'No packages to install' END AS problem
        FROM q JOIN runs r USING (run_id) LEFT JOIN clusters c ON c.cluster_id = r.cluster_id)
      SELECT p.run_id, p.issue_type, CASE WHEN ok THEN {by_issue("'increase_memory'", "'increase_disk_space'", "'install_dependencies'", "'restart_cluster'", 'found')} END AS fix_type,
        CASE WHEN ok THEN {by_issue("CASE WHEN gc THEN 0.9 ELSE 0.8 END", '0.85', "CASE WHEN len(named) > 0 THEN 0.9 ELSE 0.6 END", '0.5', 'found')}::DOUBLE END AS fix_confidence,
        CASE WHEN NOT ok THEN 'logs are not a JSON object' END AS diagnose_error, p.cluster_id,
        CASE WHEN problem IS NULL AND found = 'memory_exceeded' THEN floor(coalesce(num_workers, 1) * CASE WHEN gc THEN 2.0 ELSE 1.5 END)::INT END AS target_workers,
        CASE WHEN problem IS NULL AND found = 'dependency_error' THEN
          '[' || array_to_string(list_transform(named, lambda x: '{{"pypi":{{"package":"' || x || '"}}}}'), ',') || ']' END AS payload, problem AS apply_error,
        v.outcome, v.next_run_id, CASE WHEN v.run_id IS NULL THEN 'No fix to verify' END AS verify_error,
        CASE WHEN p.run_id % 7 <> 0 THEN '# ' || CASE WHEN outcome = 'success' THEN {lit(reporting.HEADLINE_OK)} ELSE {lit(reporting.HEADLINE_FAILED)} END
          || chr(10) || chr(10) || {guided(reporting.ROOT_CAUSE)} || chr(10) || chr(10) || '- verify: ' || coalesce(outcome, '-') || chr(10) || chr(10)
          || CASE WHEN outcome = 'success' THEN {guided(reporting.OUTCOME)} ELSE {lit(reporting.NOT_RESOLVED)} END END AS report,
        CASE WHEN p.run_id % 7 = 0 THEN 'reasoning steps are not a JSON array' END AS report_error
      FROM p LEFT JOIN (SELECT s.run_id, verified.outcome, verified.next_run_id FROM verified JOIN suggestions s USING (fix_id)) v ON v.run_id = p.run_id""",
    "text_helpers": """SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS title,
        lower(p_name) AS words, trim(string_split(p_brand || '.' || p_type || '.' || p_name, '.')[-1]) AS last_part,
        CASE WHEN p_type = 'ECONOMY' THEN 'N/A' ELSE p_type END AS type_or_default, p_name AS stripped FROM part""",
    "time_helpers": """SELECT event_id, epoch_us(ts) // 1000 AS millis, strftime(ts, '%H:%M:%S') AS clock, (epoch_us(ts) // 1000 - 1704067200000) // 1000 AS elapsed,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed, NULL::TIMESTAMP AS not_a_time FROM events""",
}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH {ENTITIES}, answer AS ({body}) SELECT * FROM answer" for name, body in STATEMENTS.items()}
