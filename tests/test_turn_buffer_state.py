"""A conversation's turns wait in one value, read and written once a batch, whatever the number of turns."""

from __future__ import annotations

import pandas as pd

from runhealth.streaming import approvals


class Value:
    def __init__(self, calls: list):
        self.value, self.calls = None, calls

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


class Handle:
    def __init__(self):
        self.calls: list[str] = []

    def getValueState(self, name, schema):
        return Value(self.calls)

    def registerTimer(self, ms):
        self.calls.append("timer")


def batch(turns: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(turns, columns=approvals.HELD)


def test_state_calls_do_not_follow_the_turns():
    handle = Handle()
    buffer = approvals.TurnBuffer(0, None)
    buffer.init(handle)
    # Turns 1..20 come first and wait for turn 0, which names job 7's fix; turn 21 approves.
    early = batch([(t, 0, False, None, False, False) for t in range(1, 21)])
    assert list(buffer.handleInputRows((5,), iter([early]), None)) == []
    assert handle.calls == ["get", "update"]
    handle.calls.clear()
    late = batch([(0, 0, True, "fix-7", False, False), (21, 0, False, None, True, False)])
    out = pd.concat(list(buffer.handleInputRows((5,), iter([late]), None)))
    assert handle.calls == ["get", "update"]
    assert out.to_dict("records") == [{"conv_id": 5, "turn": 21, "fix_id": "fix-7", "decision": "approve"}]
