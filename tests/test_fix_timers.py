"""One key holds the fixes and runs of many jobs: state calls follow its batches, answers stay each job's own."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd

from runhealth.streaming import verify

WIDTH = 1000


class Blocks:
    def __init__(self, calls: list):
        self.blocks, self.calls = [], calls

    def get(self):
        self.calls.append("get")
        return iter(list(self.blocks))

    def appendValue(self, value):
        self.calls.append("append")
        self.blocks.append(value)

    def put(self, values):
        self.calls.append("put")
        self.blocks = list(values)

    def clear(self):
        self.calls.append("clear")
        self.blocks = []


class Handle:
    def __init__(self):
        self.calls, self.timers, self.lists = [], set(), {}

    def getListState(self, name, schema):
        return self.lists.setdefault(name, Blocks(self.calls))

    def listTimers(self):
        self.calls.append("timers")
        return iter(list(self.timers))

    def registerTimer(self, ms):
        self.calls.append("register")
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls.append("delete")
        self.timers.discard(ms)


def rows(seed: int, jobs: int) -> pd.DataFrame:
    rng, out = random.Random(seed), []
    for job in [*map(str, range(jobs)), None]:
        for i in range(12):
            at, fix = rng.randrange(WIDTH), i < 4
            out.append((job, verify.FIX if fix else verify.RUN, f"{job}-{i}" if fix else str(i), at, at + 100 if fix else None,
                        rng.choice(["disk", None]), None if fix else rng.choice(["SUCCESS", "FAILED"]), 1))
    rng.shuffle(out)
    return pd.DataFrame(out, columns=["job_id", "kind", "id", "at", "deadline", "issue_type", "status", "buckets"])


def fired(timers: verify.FixTimers, handle: Handle, watermark: int) -> list[dict]:
    out = []
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark * 1000)
    for due in sorted(t for t in handle.timers if t <= watermark * 1000):
        frames = list(timers.handleExpiredTimer((0, 0), at, SimpleNamespace(getExpiryTimeInMs=lambda: due)))
        handle.timers.discard(due)
        out += [r for f in frames for r in f.to_dict("records")]
    return out


def test_a_key_answers_every_job_from_its_own_runs():
    frame, handle = rows(1, 200), Handle()
    timers = verify.FixTimers(WIDTH)
    timers.init(handle)
    # Rows come in order of time, two batches; the watermark is behind the first when its timers fire.
    early = frame[frame["at"] <= 600]
    timers.handleInputRows((0, 0), iter([early[:50], early[50:]]), None)
    got = fired(timers, handle, 400)
    timers.handleInputRows((0, 0), iter([frame[frame["at"] > 600]]), None)
    got += fired(timers, handle, 700)
    assert handle.timers and {r["fix_id"] for r in got} == {f.id for f in frame.itertuples() if f.kind == verify.FIX and f.deadline <= 700}
    got += fired(timers, handle, WIDTH)
    runs = frame[frame["kind"] == verify.RUN]
    want = {}
    for fix in frame[frame["kind"] == verify.FIX].itertuples():
        own = runs[runs["job_id"].isna() if fix.job_id is None else runs["job_id"] == fix.job_id]
        own = own[(own["at"] > fix.at) & (own["at"] <= fix.deadline)]
        first = min(((r.at, int(r.id), r.status) for r in own.itertuples()), default=(None, None, None))
        want[fix.id] = (str(fix.job_id), first[0], None if first[1] is None else str(first[1]), first[2])
    plain = lambda x: None if pd.isna(x) else x
    assert len(got) == len(want)
    assert {r["fix_id"]: (r["job_id"], plain(r["next_at"]), plain(r["next_run_id"]), plain(r["next_status"])) for r in got} == want
    assert not handle.timers and not any(x.blocks for x in handle.lists.values())


def test_open_fixes_keep_their_runs_also_without_a_job():
    day, handle = verify.DAY, Handle()
    timers = verify.FixTimers(10 * day)
    timers.init(handle)
    made = []
    for job in ("a", None):
        made += [(job, verify.FIX, f"{job}-early", 0, 2 * day, None, None, 1), (job, verify.FIX, f"{job}-late", day, 8 * day, None, None, 1),
                 (job, verify.RUN, "1", day + 60, None, None, "SUCCESS", 1), (job, verify.RUN, "2", 7 * day, None, None, "FAILED", 1)]
    timers.handleInputRows((0, 0), iter([pd.DataFrame(made, columns=["job_id", "kind", "id", "at", "deadline", "issue_type", "status", "buckets"])]), None)
    got = {r["fix_id"]: r["next_run_id"] for watermark in (5 * day, 9 * day) for r in fired(timers, handle, watermark)}
    assert got == {"a-early": "1", "a-late": "1", "None-early": "1", "None-late": "1"}


def test_state_calls_do_not_follow_the_rows():
    counts = []
    for jobs in (5, 500):
        handle = Handle()
        timers = verify.FixTimers(WIDTH)
        timers.init(handle)
        timers.handleInputRows((0, 0), iter([rows(2, jobs)]), None)
        assert len(fired(timers, handle, 500)) > jobs
        counts.append(sorted(handle.calls))
    assert counts[0] == counts[1] and len(counts[0]) < 12
