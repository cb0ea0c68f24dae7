"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, found by a Dijkstra
search from both ends of the lattice of edits."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from runhealth.llm.common import SPACES, kept, map_rows, row_keys

# Costs of the edits, and the roles that may be given.
DELETE, RENAME, INSERT, TRUNCATED = 4, 3, 3, 3
ROLES = {"u": "user", "a": "assistant"}
# States of `(s?(ua)+)?`: nothing yet, after s, after u, after a. Each takes one of u and a next.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
TAKES = {START: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
BEFORE = {s: [p for p in NEXT if NEXT[p] == s] for s in NEXT}
ENDS = (START, AFTER_A)
LEGAL = {"su", "ua", "au"}
SEGMENT_ROWS = 256
FAN = 8

Edge = tuple[int, int, str, int]  # state before, cost, audit letters, state after


def row_edges(initial: str, forced: bool, truncated: bool, copies: int) -> list[Edge]:
    """What may be done with one row; its copies after the first are always deleted.

    Their deletions follow the row's own letter at once: an insertion between them may as well follow
    them, at the same cost and with a lesser audit.
    """
    more, tail = DELETE * (copies - 1), "D" * (copies - 1)
    edges = [(q, DELETE + more, "D" + tail, q) for q in NEXT]
    if not forced:
        stays = TRUNCATED if truncated else 0
        edges += [(q, RENAME + stays + more, "R" + tail, NEXT[q]) for q in NEXT]
        edges += [(q, stays + more, "K" + tail, NEXT[q]) for q in NEXT if TAKES[q] == initial]
        if initial == "s":
            edges.append((START, stays + more, "K" + tail, AFTER_S))
    return edges


def cheapest(layers: list[list[Edge]], begin: int, ends: tuple[int, ...], insert: bool) -> tuple[int, str] | None:
    """Least cost, and least audit of that cost, over paths through all layers from ``begin`` to one of ``ends``.

    A node is a number of layers passed and a state. Heaps of both directions are ordered by cost, then by layers
    passed, then by audit; edges of no cost pass a layer, so a node that leaves a heap has its least audit
    (no audit of a node is the start of another one of equal cost). The directions take turns, the
    cheaper first, until their least open costs exceed the best crossing, so that every crossing of that cost
    has been met; then the least concatenated audit wins. None if there is no path.
    """
    n = len(layers)
    into = [{q: [e for e in layer if e[3] == q] for q in NEXT} for layer in layers]
    out_of = [{q: [e for e in layer if e[0] == q] for q in NEXT} for layer in layers]

    def ahead(i: int, q: int) -> list[tuple[int, str, int, int]]:
        found = [(cost, letters, i + 1, after) for _, cost, letters, after in out_of[i][q]] if i < n else []
        return found + [(INSERT, "I", i, NEXT[q])] if insert else found

    def back(i: int, q: int) -> list[tuple[int, str, int, int]]:
        found = [(cost, letters, i - 1, before) for before, cost, letters, _ in into[i - 1][q]] if i else []
        return found + [(INSERT, "I", i, p) for p in BEFORE[q]] if insert else found

    forward, reverse = [(0, 0, "", begin)], [(0, -n, "", q) for q in ends]
    heapq.heapify(reverse)
    met, seen = {}, {}  # nodes settled from the front, and from the back: cost, audit
    best = float("inf")
    while forward or reverse:
        front, rear = (heap[0][0] if heap else 0 for heap in (forward, reverse))
        if front + rear > best:
            break
        if forward and (not reverse or front <= rear):
            cost, i, audit, q = heapq.heappop(forward)
            if (i, q) in met:
                continue
            met[i, q] = cost, audit
            if (i, q) in seen:
                best = min(best, cost + seen[i, q][0])
            for more, letters, j, p in ahead(i, q):
                if (j, p) in seen:
                    best = min(best, cost + more + seen[j, p][0])
                if (j, p) not in met:
                    heapq.heappush(forward, (cost + more, j, audit + letters, p))
        else:
            cost, i, audit, q = heapq.heappop(reverse)
            i = -i
            if (i, q) in seen:
                continue
            seen[i, q] = cost, audit
            if (i, q) in met:
                best = min(best, cost + met[i, q][0])
            for more, letters, j, p in back(i, q):
                if (j, p) in met:
                    best = min(best, cost + more + met[j, p][0])
                if (j, p) not in seen:
                    heapq.heappush(reverse, (cost + more, -j, letters + audit, p))
    crossings = []
    for (i, q), (cost, audit) in met.items():
        for more, letters, j, p in [(0, "", i, q), *ahead(i, q)]:
            if (j, p) in seen and cost + more + seen[j, p][0] == best:
                crossings.append(audit + letters + seen[j, p][1])
    if not crossings:
        return None
    return int(best), min(crossings)


class Part(NamedTuple):
    """A stretch of a conversation: its faults, what its ends show, and its cheapest edits between states."""
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first_initial: str | None = None
    last_initial: str | None = None
    first_turn: int | None = None
    last_turn: int | None = None
    n_turns: int = 0
    n_rows: int = 0
    edges: list[Edge] = []


PART = ("blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, first_turn long, "
        "last_turn long, n_turns long, n_rows long, edges array<struct<before:int,cost:long,audit:string,after:int>>")


def transfers(layers: list[list[Edge]], whole: bool, insert: bool) -> list[Edge]:
    """The cheapest edge between each two states; for a whole conversation, from nothing to an end."""
    if whole:
        cost, audit = cheapest(layers, START, ENDS, insert)
        return [(START, cost, audit, AFTER_A if audit.strip("D") else START)]
    found = [(before, after, cheapest(layers, before, (after,), insert)) for before in NEXT for after in NEXT]
    return [(before, best[0], best[1], after) for before, after, best in found if best]


def joined(parts: list[Part]) -> Part:
    """Faults and ends of adjoining parts; edges are left to the caller."""
    total = Part()
    for part in parts:
        if not part.n_rows:
            continue
        meets = total.n_rows > 0 and total.last_initial + part.first_initial not in LEGAL
        same_turn = total.last_turn is not None and total.last_turn == part.first_turn
        total = Part(
            total.blank + part.blank, total.duplicate + part.duplicate, total.truncated + part.truncated,
            total.illegal + part.illegal + meets, part.first_initial if not total.n_rows else total.first_initial, part.last_initial,
            part.first_turn if total.first_turn is None else total.first_turn,
            total.last_turn if part.last_turn is None else part.last_turn,
            total.n_turns + part.n_turns - same_turn, total.n_rows + part.n_rows)
    return total


def part_of_row(row: dict) -> Part:
    copies, blank, late, turn = row["copies"], row["blank"], row["late"], row["turn"]
    late_copies = 0 if blank else copies if late else copies - 1
    return Part(copies if blank else 0, late_copies, int(row["truncated"] and not blank and not late),
                (copies - 1) * (row["initial"] * 2 not in LEGAL), row["initial"], row["initial"], turn, turn, int(turn is not None), copies)


def solved(rows: list[dict], whole: bool) -> Part:
    """A stretch of rows in order; rows that the damage dropped have no copies and only name their conversation."""
    rows = [r for r in rows if r["copies"]]
    layers = [row_edges(r["initial"], r["blank"] or r["late"], r["truncated"], r["copies"]) for r in rows]
    return joined([part_of_row(r) for r in rows])._replace(edges=transfers(layers, whole, True))


def composed(parts: list[Part], whole: bool) -> Part:
    """Adjoining stretches as one: the same search, with their edges as layers."""
    return joined(parts)._replace(edges=transfers([p.edges for p in parts], whole, False))


KEYS = ["conv_id", "turn", "role", "key", "key2"]


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null meets null."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how).drop(*[f"_{k}" for k in keys])


def facts(turns: DataFrame) -> DataFrame:
    """One narrow row per different turn row, without its text: how often it stands there and its faults."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    rows = turns.select(
        "conv_id", "turn", "role", *row_keys("text"), "copies", F.left("role", F.lit(1)).alias("initial"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    once = rows.groupBy(*KEYS).agg(F.sum("copies").alias("copies"), *[F.max(c).alias(c) for c in ("initial", "blank", "truncated")])
    said = ["conv_id", "role", "key", "key2"]
    # Nulls are least within a struct, as in the order of turns.
    firsts = once.where("copies > 0 and not blank").groupBy(*said).agg(
        F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    return attach(once, firsts, said, "left").withColumn("late", late).drop("first")


ROWS = "array<struct<turn:long,role:string,key:long,key2:long,copies:long>>"
SEGMENT = f"conv_id long, part long, whole boolean, {PART}, rows {ROWS}"


def segments(rows: DataFrame) -> DataFrame:
    """Stretches of at most SEGMENT_ROWS rows in order of ``part``, each solved where it lies.

    A sort by range splits a conversation of any length over tasks; one that begins and ends inside a task is whole.
    """
    placed = rows.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)

    def solve(stream: Iterator[dict]) -> Iterator[tuple]:
        number = TaskContext.get().partitionId() << 40
        conv, held, inside, first = None, [], False, True

        def record(whole: bool) -> tuple:
            nonlocal number
            number += 1
            found = solved(held, whole)
            return (conv, number, whole, *_plain(found),
                    [{"turn": r["turn"], "role": r["role"], "key": r["key"], "key2": r["key2"], "copies": r["copies"]} for r in held if r["copies"]])

        for row in stream:
            if first or row["conv_id"] != conv or len(held) >= SEGMENT_ROWS:
                if held:
                    yield record(inside and row["conv_id"] != conv)
                inside = not first and row["conv_id"] != conv
                conv, held, first = row["conv_id"], [], False
            held.append(row)
        if held:
            yield record(False)

    return map_rows(placed, SEGMENT, solve)


def _plain(part: Part) -> tuple:
    return (*part[:-1], [dict(zip(("before", "cost", "audit", "after"), e)) for e in part.edges])


def _parts(frame: pd.DataFrame) -> list[Part]:
    whole = [None if pd.isna(x) else int(x) for x in frame["first_turn"]], [None if pd.isna(x) else int(x) for x in frame["last_turn"]]
    return [Part(int(r.blank), int(r.duplicate), int(r.truncated), int(r.illegal), r.first_initial, r.last_initial, first, last,
                 int(r.n_turns), int(r.n_rows), [(int(e["before"]), int(e["cost"]), e["audit"], int(e["after"])) for e in r.edges])
            for r, first, last in zip(frame.itertuples(index=False), *whole)]


def whole_conversations(parts: DataFrame) -> DataFrame:
    """Solve the conversations that lie in several parts: FAN neighbours become one, level by level.

    A level holds FAN parts of a conversation in memory, and the last one its audit, which is one value of the result.
    """
    spec = StructType.fromDDL(f"conv_id long, place long, {PART}")
    here = parts.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("part")) - 1).cast("long").alias("place"),
                        *[f.name for f in StructType.fromDDL(PART)])
    names = spec.names

    def compose(whole: bool):
        def level(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("place")
            conv = frame["conv_id"].iloc[0]
            found = composed(_parts(frame), whole)
            out = pd.DataFrame([(None if pd.isna(conv) else int(conv), int(frame["place"].iloc[0]) // FAN, *_plain(found))], columns=names)
            return out.astype({c: "Int64" for c in ("conv_id", "first_turn", "last_turn")})

        return level

    while True:
        here = kept(here, "repair-level")
        most = here.agg(F.max("place")).first()[0]
        if most is None:
            return here.drop("place")
        last = most < FAN
        here = here.groupBy("conv_id", F.floor(F.col("place") / FAN).alias("_group")).applyInPandas(compose(last), spec)
        if last:
            return here.drop("place")


def cut_audit(audit: str, sizes: list[int]) -> list[tuple[int, str]]:
    """(state before, letters) of each part, given how many rows each has; insertions at a seam go to the later part."""
    letters = np.frombuffer(audit.encode(), dtype="u1")
    ends = np.flatnonzero(letters != ord("I")) + 1
    cuts = [0, *(int(ends[n - 1]) if n else 0 for n in np.cumsum(sizes, dtype=np.int64).tolist())]
    cuts[-1] = len(audit)
    stays = np.concatenate([[0], np.cumsum(letters != ord("D"))])
    odd = int(stays[-1]) % 2

    def state(at: int) -> int:
        n = int(stays[at])
        return START if not n else AFTER_S if n == odd else AFTER_U if (n - odd) % 2 else AFTER_A
    return [(state(a), audit[a:b]) for a, b in zip(cuts, cuts[1:])]


EDIT = ("conv_id long, part long, place long, edit string, new_role string, turn long, role string, key long, key2 long")


def repaired_rows(before: int, letters: str, rows: list[dict]) -> Iterator[tuple]:
    """The turns that stay or are put in: (edit, role, source row or None), in order."""
    state, left = before, iter([r for r in rows for _ in range(r["copies"])])
    for letter in letters:
        row = None if letter == "I" else next(left)
        if letter == "D":
            continue
        keeps_s = letter == "K" and row["role"][:1] == "s"
        yield letter, row["role"] if letter == "K" else ROLES[TAKES[state]], row
        state = AFTER_S if keeps_s else NEXT[state]


def repair(turns: DataFrame, copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: a summary per conversation, and the turns of the repaired conversations.

    ``turns`` has conv_id, turn, role, text and, if ``copies`` names it, how often each row stands there (none: the
    row only names its conversation). Other columns are ignored. Rows go by turn, nulls first, then by role and
    by a 128-bit hash of the text, so equal rows stand together. A null role or text is an empty one; rows without conv_id are one
    conversation. A row is blank (no character but white space), else duplicate (role and text stood earlier), else truncated
    (it does not end in one of ``.!?``). The role initials have to become ``(s?(ua)+)?``. A row is kept at no cost,
    gets role user or assistant (3), or is deleted (4, and blank and duplicate rows must be); an empty user or assistant turn is put in
    anywhere (3); a truncated row that stays costs 3 more and stays as it is.

    Summary: conv_id, gaps, blank, duplicate, truncated, illegal (neighbours whose initials are none of su, ua, au),
    cost, audit (initials of the cheapest edits; of several audits the least). Turns: conv_id, part and place (their order),
    edit, role, text. A conversation without rows has zeros and an empty audit. An empty table gives empty tables.

    Conversations are cut into stretches of SEGMENT_ROWS rows. A stretch's cheapest edits between any two states are found
    where it lies, and stretches are joined by the same search, so no task holds a long conversation; only
    its audit is one value. Texts are shuffled once, by row and not by conversation.
    """
    source = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"))
    cut = kept(segments(facts(source)), "repair-segments")
    plain = [f.name for f in StructType.fromDDL(PART)]
    solved_apart = kept(whole_conversations(cut.where("not whole")), "repair-long")
    both = cut.where("whole").select("conv_id", *plain).unionByName(solved_apart.select("conv_id", *plain))
    best = F.col("edges")[0]
    summary = both.select(
        "conv_id", F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))

    # Long conversations: their audit is cut where their parts meet.
    sizes = cut.where("not whole").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n_rows"))).alias("parts"))
    answers = solved_apart.select("conv_id", best["audit"].alias("audit"))
    asked = attach(answers, sizes, ["conv_id"])

    def cuts(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            pieces = cut_audit(row["audit"], [p["n_rows"] for p in row["parts"]])
            yield from ((row["conv_id"], p["part"], before, letters) for p, (before, letters) in zip(row["parts"], pieces))

    slices = map_rows(asked, "conv_id long, part long, before int, letters string", cuts)
    in_parts = cut.where("not whole").select("part", "rows").join(slices, "part")
    each = cut.where("whole").select("part", "rows", "conv_id", F.lit(START).alias("before"), best["audit"].alias("letters")) \
        .unionByName(in_parts)

    def edits(stream: Iterator[dict]) -> Iterator[tuple]:
        for part in stream:
            for place, (edit, role, row) in enumerate(repaired_rows(part["before"], part["letters"], part["rows"])):
                yield (part["conv_id"], part["part"], place, edit, role,
                       *((row["turn"], row["role"], row["key"], row["key2"]) if row else (None,) * 4))

    stay = kept(map_rows(each, EDIT, edits), "repair-edits")
    texts = source.where("copies > 0").select("conv_id", "turn", "role", *row_keys("text"), "text") \
        .groupBy(*KEYS).agg(F.any_value("text").alias("text"))
    found = attach(stay.where("edit <> 'I'"), texts, KEYS).unionByName(stay.where("edit = 'I'").withColumn("text", F.lit("")))
    return summary, found.select("conv_id", "part", "place", "edit", F.col("new_role").alias("role"), "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20, nulls as one space, and a column
    ``copies``: 0 for dropped rows, 2 for repeated ones.

    0 drops the row, 1 empties its text, 2 takes full stops, exclamation and question marks out of it, 3 repeats it, 4 sets role user.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text, role = shown("text"), shown("role")
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


DIGEST = "conv_id long, repaired_sha256 string"


def digest(turns: DataFrame) -> DataFrame:
    """Per conversation the SHA-256 of its ``role:text``, joined by line ends, read as a stream in order."""
    def hashed(stream: Iterator[dict]) -> Iterator[tuple]:
        for conv, rows in groupby(stream, lambda r: (r["conv_id"],)):
            state = hashlib.sha256()
            for i, row in enumerate(rows):
                state.update(f"{chr(10) if i else ''}{row['role']}:{row['text']}".encode())
            yield conv[0], state.hexdigest()

    return map_rows(turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place"), DIGEST, hashed)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Damage, repair and digest: a row per conversation."""
    summary, turns = repair(damaged(conversations), "copies")
    return attach(summary, digest(turns), ["conv_id"], "left").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
