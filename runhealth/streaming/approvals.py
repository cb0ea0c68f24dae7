"""Hold the fix each conversation waits on, and emit approvals and rejections, whatever order turns arrive in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runhealth.operators.chat import message_intents

DECISION = "conv_id bigint, turn bigint, fix_id string, decision string"
HELD = ["turn", "at", "names_job", "offered", "approves", "rejects"]


def decisions(turns: pd.DataFrame, waiting: str | None) -> tuple[pd.DataFrame, str | None]:
    """(turn, fix_id, decision) of turns in order that follow a state, and the fix that waits after them.

    An answer clears a waiting fix and a job's name replaces it. A turn that does both answers a waiting fix, else it starts a wait;
    so the state is the last turn with one outcome and the parity of the two-way turns since.
    """
    answers = (turns["approves"] | turns["rejects"]).to_numpy(bool)
    names = turns["names_job"].to_numpy(bool)
    offered = turns["offered"].where(turns["names_job"] & turns["offered"].notna(), None).to_numpy(object)
    two_way = answers & names & turns["offered"].notna().to_numpy()
    sets = (answers | names) & ~two_way
    # Row 0 is the state before the first turn.
    left = np.concatenate([[waiting], np.where(answers, None, offered)])
    offers = np.concatenate([[None], offered])
    count = np.concatenate([[0], np.cumsum(two_way)])
    places = np.arange(len(turns) + 1)
    last_set = np.maximum.accumulate(np.where(np.concatenate([[True], sets]), places, 0))
    last_two = np.maximum.accumulate(np.where(np.concatenate([[False], two_way]), places, 0))
    since = count - count[last_set]
    base = left[last_set]
    waits = np.not_equal(base, None) ^ (since % 2 == 1)
    state = np.where(waits, np.where(since == 0, base, offers[last_two]), None)
    decided = np.not_equal(state[:-1], None) & answers
    out = pd.DataFrame({
        "turn": turns["turn"].to_numpy()[decided], "fix_id": state[:-1][decided],
        "decision": np.where(turns["approves"].to_numpy(bool)[decided], "approve", "reject")})
    return out, state[-1]


BUFFER = ("next_turn bigint, fix_id string, turns array<bigint>, ats array<bigint>, names_job array<boolean>, offered array<string>, "
          "approves array<boolean>, rejects array<boolean>")


class TurnBuffer(StatefulProcessor):
    """The next turn and the waiting fix of each conversation, and the turns that came before their turn.

    Turns are released in sequence. What a missing turn holds back is released ``patience`` after it arrived by
    event time, when there are event times. A conversation's state is one value, read and written once a batch.
    """

    def __init__(self, first_turn: int, patience_ms: int | None):
        self.first_turn, self.patience_ms = first_turn, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getValueState("buffer", BUFFER)

    def _load(self) -> tuple[int, str | None, pd.DataFrame]:
        value = self.buffer.get()
        if value is None:
            return self.first_turn, None, pd.DataFrame({n: [] for n in HELD})
        following, fix, *columns = value
        return int(following), fix, pd.DataFrame(dict(zip(HELD, (list(c) for c in columns))))

    def _release(self, key, buffered: pd.DataFrame, fresh: pd.DataFrame, up_to: int, following: int,
                 fix: str | None) -> Iterator[pd.DataFrame]:
        """Decide all turns in sequence, and every turn up to ``up_to``; keep the rest. A turn that was passed is dropped."""
        turns = pd.concat([f for f in (buffered, fresh) if len(f)] or [fresh]).drop_duplicates("turn").sort_values("turn")
        turns = turns[turns["turn"] >= following].reset_index(drop=True)
        number = turns["turn"].to_numpy(np.int64)
        forced = int((number <= up_to).sum())
        start = number[forced - 1] + 1 if forced else following
        run = number[forced:] == start + np.arange(len(number) - forced)
        n = forced + (int(run.argmin()) if not run.all() else len(run))
        if n:
            decided, fix = decisions(turns.iloc[:n], fix)
            following = int(number[n - 1]) + 1
            if len(decided):
                decided.insert(0, "conv_id", key[0])
                yield decided
        rest = turns.iloc[n:]
        self.buffer.update((following, fix, [int(x) for x in rest["turn"]], [int(x) for x in rest["at"]],
                            [bool(x) for x in rest["names_job"]], [x if isinstance(x, str) else None for x in rest["offered"]],
                            [bool(x) for x in rest["approves"]], [bool(x) for x in rest["rejects"]]))
        if self.patience_ms is not None:
            for at in rest["at"][~rest["turn"].isin(buffered["turn"])]:
                self.handle.registerTimer(int(at) + self.patience_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))[HELD]
        following, fix, held = self._load()
        yield from self._release(key, held, fresh, self.first_turn - 1, following, fix)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        following, fix, held = self._load()
        due = held[held["at"] + self.patience_ms <= expiredTimerInfo.getExpiryTimeInMs()]
        if len(due):
            yield from self._release(key, held, held.iloc[:0], int(due["turn"].max()), following, fix)


def approvals_stream(chat: DataFrame, job_fixes: DataFrame, word_boundary: bool = False, first_turn: int = 0,
                     ts: str | None = None, patience: str = "1 hour") -> DataFrame:
    """Decisions as chat arrives, over ``conv_id turn role text`` and a static ``job_ref fix_id``.

    Turns may arrive in any order and over any number of triggers: a conversation's turns, of every role, are taken in the sequence
    ``first_turn``, ``first_turn`` + 1, ...; those that are early wait in the state. With an event time column ``ts``, turns wait for a
    missing one for ``patience`` at most, and a turn later than that is dropped; without one they wait until it comes. A turn that comes
    twice counts once.
    """
    facts = message_intents(chat, word_boundary)
    user = F.col("role") == "user"
    rows = facts.join(job_fixes.select("job_ref", F.col("fix_id").alias("offered")), "job_ref", "left")
    said = [F.col("conv_id"), F.col("turn"), (F.unix_millis(F.col(ts).cast("timestamp")) if ts else F.lit(0)).cast("bigint").alias("at"),
            *[F.coalesce(user & c, F.lit(False)).alias(n) for n, c in (
                ("names_job", F.col("job_ref").isNotNull()), ("approves", F.col("is_approval")), ("rejects", F.col("is_rejection")))],
            F.when(user, F.col("offered")).alias("offered")]
    if ts:
        timed = rows.select(*said, F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", patience)
        wait = int(chat.sparkSession.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {patience})").first()[0])
    else:
        timed, wait = rows.select(*said), None
    return timed.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=TurnBuffer(first_turn, wait), outputStructType=DECISION, outputMode="append",
        timeMode="EventTime" if ts else "None")
