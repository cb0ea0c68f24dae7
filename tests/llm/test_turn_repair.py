from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from runhealth.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, copies int, part long, key long"
TAKES, NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}, {0: 2, 1: 2, 2: 3, 3: 2}


def plain_search(rows):
    """Least (cost, audit) by a table over rows and states; rows are (initial, must go, truncated)."""
    now = {0: (0, "")}

    def with_inserts(table):
        for _ in range(4):
            for q, (cost, audit) in list(table.items()):
                table[NEXT[q]] = min(table.get(NEXT[q], (10 ** 9, "")), (cost + 3, audit + "I"))
        return table

    for initial, forced, truncated in rows:
        after = {}

        def reach(q, cost, audit):
            after[q] = min(after.get(q, (10 ** 9, "")), (cost, audit))
        for q, (cost, audit) in with_inserts(now).items():
            reach(q, cost + 4, audit + "D")
            if not forced:
                stays = 3 if truncated else 0
                reach(NEXT[q], cost + 3 + stays, audit + "R")
                if TAKES[q] == initial:
                    reach(NEXT[q], cost + stays, audit + "K")
                if q == 0 and initial == "s":
                    reach(1, cost + stays, audit + "K")
        now = after
    table = with_inserts(now)
    return min(table[q] for q in (0, 3) if q in table)


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        convs[conv]
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        convs[conv] += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return {conv: repaired(turns) for conv, turns in convs.items()}


def signed(text):
    found = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return found - (1 << 64) if found >> 63 else found


def repaired(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), signed(t[2])))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    seen, faults, rows = set(), [], []
    for _, role, text in turns:
        shown = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
        rows.append((role[:1], faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
    initials = [r[0] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = plain_search(rows)
    out, left = [], iter(turns)
    stays = len(audit) - audit.count("D")
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)[1:]
        if letter != "D":
            wanted = "u" if (stays - len(out)) % 2 == 0 else "a"
            out.append((role if letter == "K" else {"u": "user", "a": "assistant"}[wanted]) + ":" + text)
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def found(spark, rows):
    out = tr.repair_digests(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in out}


def conversations(seed, n, turns):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, turns)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ["user", "assistant"][turn % 2]
            role = "system" if turn == 0 and rng.random() < 0.3 else rng.choice(["tool", "", None, "sudo", role]) if rng.random() < 0.1 else role
            text = rng.choice(["yes.", "so", "ok!", " ", None, f"t{turn}?", f"word {turn}"])
            rows.append((conv, turn + rng.choice([0, 0, 0, 5]) if rng.random() < 0.97 else None, role, text, 9, 9, 9))
    return rows


ROWS = st.lists(st.tuples(st.sampled_from("sua?"), st.booleans(), st.booleans()), max_size=9)


@settings(max_examples=300, deadline=None)
@given(ROWS)
def test_search_from_both_ends_finds_the_least_audit(rows):
    layers = [tr.row_edges(*row, 1) for row in rows]
    assert tr.cheapest(layers, tr.START, tr.ENDS, True) == plain_search(rows)


@settings(max_examples=150, deadline=None)
@given(ROWS, st.integers(1, 4))
def test_stretches_join_to_the_same_answer(rows, size):
    layers = [tr.row_edges(*row, 1) for row in rows]
    parts = [tr.transfers(layers[i:i + size], False, True) for i in range(0, len(layers), size)]
    cost, audit = plain_search(rows)
    assert tr.transfers(parts, True, False)[0][1:3] == (cost, audit)
    sizes = [len(layers[i:i + size]) for i in range(0, len(layers), size)]
    if sizes:
        cut = tr.cut_audit(audit, sizes)
        assert "".join(letters for _, letters in cut) == audit
        again = [e for (before, letters), k in zip(cut, range(0, len(rows), size)) for e in tr.repaired_rows(
            before, letters, [{"role": r[0], "copies": 1} for r in rows[k:k + size]])]
        whole = tr.repaired_rows(tr.START, audit, [{"role": r[0], "copies": 1} for r in rows])
        assert [(a, b) for a, b, _ in again] == [(a, b) for a, b, _ in whole]


def test_copies_cost_what_rows_cost():
    for rows, copies in (([("u", False, True)] + [("u", True, False)] * 2 + [("a", False, False)], (3, 1)), ([("a", True, False)] * 4, (4,))):
        firsts = [r for i, r in enumerate(rows) if i == 0 or i >= copies[0]]
        layers = [tr.row_edges(*row, n) for row, n in zip(firsts, copies)]
        assert tr.cheapest(layers, tr.START, tr.ENDS, True) == plain_search(rows)


@pytest.mark.parametrize("size", [3, 256])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(tr, "SEGMENT_ROWS", size)
    monkeypatch.setattr(tr, "FAN", 2)
    rows = conversations(size, 60, 12) + [(900, t, "user" if t % 3 else "assistant", f"w{t % 50}.", 0, 0, 0) for t in range(300)]
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    long = "word " * 200_000
    dropped = next(c for c in range(1000, 9999) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    rows = [(None, None, None, None), (None, 3, "user", "a."), (None, 3, "user", "a."), (1, None, "system", "s."), (1, None, "system", "s."),
            (2, 0, "user", ""), (2, 1, "user", " \t\n"), (3, 0, "user", long), (3, 1, "assistant", long + "."), (4, 5, "", "x."),
            (5, 0, "assistant", " "), (5, 0, "assistant", " "), (6, -3, "a\nb", "x.\n"), (6, 4, "user", "é?\x0c"),
            (dropped, 0, "user", "gone."), (8, 1, "user", "same."), (8, 2, "assistant", "b."), (8, 3, "user", "same.")]
    rows = [(*r, 0, 0, 0) for r in rows]
    got = found(spark, rows)
    assert got == brute(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert tr.repair_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_are_counted_not_held(spark):
    rows = [(1, 1, "user", "again.", 0, 0, 0)] * 700 + [(1, 2, "assistant", "b.", 0, 0, 0)]
    assert tr.facts(spark.createDataFrame(rows, SCHEMA).withColumn("copies", tr.F.lit(1))).count() == 2
    assert found(spark, rows) == brute(rows)
