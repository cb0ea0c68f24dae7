"""Route chat messages, with the fix a conversation is waiting on in mind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runhealth.functions import intent
from runhealth.operators.scan import states_before

TURNS_PER_BUCKET = 256


def message_intents(chat: DataFrame, word_boundary: bool = False) -> DataFrame:
    text = F.col("text")
    return chat.withColumns({
        "job_ref": intent.parse_job_id(text),
        "is_approval": intent.is_approval(text, word_boundary),
        "is_rejection": intent.is_rejection(text, word_boundary),
        "wants_simulation": intent.wants_simulation(text),
        "failure_keyword": intent.failure_keyword(text),
        "wants_help": intent.wants_help(text),
    })


def route_messages(chat: DataFrame, job_fixes: DataFrame, word_boundary: bool = False,
                   turns_per_bucket: int = TURNS_PER_BUCKET) -> DataFrame:
    """Class of every user message, and the fix it approves or rejects.

    ``job_fixes`` maps ``job_ref`` to the ``fix_id`` suggested for that job. A
    message naming a job asks to monitor it: it drops a waiting fix and, if the
    job has a suggestion, waits for an answer on that one. Approval and
    rejection count only while a fix waits.

    What a message does to the state is a function of two cases, no fix waiting and some fix waiting, so
    messages compose and a conversation is a scan, not a replay (see ``scan``). User turns are unique within a conversation.
    """
    users = message_intents(chat.where(F.col("role") == "user"), word_boundary)
    rows = users.join(job_fixes.select("job_ref", F.col("fix_id").alias("offered")), "job_ref", "left")
    names_job = F.col("job_ref").isNotNull()
    found = states_before(
        rows, ["conv_id"], ["turn"], F.floor(F.col("turn") / turns_per_bucket).cast("bigint"), _does(names_job), _then, _after,
        F.struct(F.lit(None).cast("string").alias("fix"), F.lit(False).alias("found")), "_state")
    kind = (
        F.when(F.col("waiting_fix").isNotNull() & F.col("is_approval"), F.lit("approve"))
        .when(F.col("waiting_fix").isNotNull() & F.col("is_rejection"), F.lit("reject"))
        .when(names_job, F.lit("monitor"))
        .when(F.col("wants_simulation"), F.lit("ask_for_id"))
        .when(F.col("_state.found"), F.lit("in_progress"))
        .when(F.col("wants_help"), F.lit("help"))
        .otherwise(F.lit("generic"))
    )
    return (
        found.withColumn("waiting_fix", F.col("_state.fix")).withColumn("message_class", kind)
        .withColumn("decided_fix", F.when(F.col("message_class").isin("approve", "reject"), F.col("waiting_fix")))
        .drop("_state")
    )


def _does(names_job: Column) -> Column:
    """What a message leaves waiting if nothing waits (``none``) or a fix does (``keeps`` it, or ``some``), and, if it
    names a job, whether that job has a fix."""
    answers = F.col("is_approval") | F.col("is_rejection")
    offered = F.when(names_job, F.col("offered"))
    return F.struct(
        offered.alias("none"), (~answers & ~names_job).alias("keeps"), F.when(~answers, offered).alias("some"),
        F.when(names_job, F.col("offered").isNotNull()).alias("found"))


def _waits(fix: Column, f: Column) -> Column:
    return F.when(fix.isNull(), f["none"]).when(f["keeps"], fix).otherwise(f["some"])


def _after(state: Column, f: Column) -> Column:
    return F.struct(_waits(state["fix"], f).alias("fix"), F.coalesce(f["found"], state["found"]).alias("found"))


def _then(f: Column, g: Column) -> Column:
    return F.struct(
        _waits(f["none"], g).alias("none"), (f["keeps"] & g["keeps"]).alias("keeps"),
        F.when(f["keeps"], g["some"]).otherwise(_waits(f["some"], g)).alias("some"),
        F.coalesce(g["found"], f["found"]).alias("found"))


def chat_decisions(routed: DataFrame) -> DataFrame:
    """The approvals and rejections given in chat."""
    return routed.where(F.col("decided_fix").isNotNull()).select(
        F.col("decided_fix").alias("fix_id"), "conv_id", "turn", F.col("message_class").alias("decision"))
