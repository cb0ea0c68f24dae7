"""Chat formatting: render turns, reparse the rendering, and escape a turn's content until both agree."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from runhealth.llm.common import encoded, map_rows

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
PART_CHARS = 1 << 20


def escape(text: str) -> str:
    """One more backslash inside each control string, escaped ones included."""
    return CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    """A role is one line: backslashes and line ends become two characters, then control strings as in texts."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn, left to right; begin and end bound its content in ``rendered``.

    turn := START role LF content END LF; the role ends at the first LF, the content at the first
    END, and neither holds a control string. Anything else raises ValueError.
    """
    at = 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = rendered.index("\n", at)
        end = rendered.index(END, line + 1)
        role, content = rendered[at + len(START):line], rendered[line + 1:end]
        if START in role or END in role or START in content or not rendered.startswith("\n", end + len(END)):
            raise ValueError(f"the turn at {at} holds a control string")
        yield unescape_role(role), unescape(content), line + 1, end
        at = end + len(END) + 1


def recovered(rendered: str) -> list[tuple[str, str]] | None:
    try:
        return [(role, text) for role, text, _, _ in parse(rendered)]
    except ValueError:
        return None


def render(role: str, text: str) -> str:
    """One turn in the template. Plain content is tried first; what does not parse back as it was is escaped.

    The parser reads left to right and stops at a turn's end, so a turn that parses back
    alone also does so between others.
    """
    for r, t in ((role, text), (escape_role(role), text), (role, escape(text)), (escape_role(role), escape(text))):
        rendered = f"{START}{r}\n{t}{END}\n"
        if recovered(rendered) == [(role, text)]:
            return rendered
    raise AssertionError("escaped content always parses back")


def in_order(conversations: DataFrame) -> DataFrame:
    """Each conversation's turns side by side in one partition, streamed in order; nothing is grouped in memory."""
    turns = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


PART = "conv_id long, part int, formatted string, loss array<struct<begin:int,end:int>>"


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, loss): training text, and spans of assistant content in it.

    ``conversations`` has conv_id, turn, role, text; other columns are ignored. Turns go in the
    order of turn, then role and text; null turns come first, repeated rows are repeated turns,
    a null role or text is an empty one, and rows without conv_id form one conversation. A
    conversation longer than a million characters takes several parts, cut between turns, so
    memory is bounded by a part and the longest turn. Parts of a conversation follow each other
    in one partition. An empty table gives no rows.
    """
    def rows(stream: Iterator[dict]) -> Iterator[tuple]:
        conv, part, pieces, size, loss, open_ = None, 0, [], 0, [], False
        for row in stream:
            if open_ and (row["conv_id"] != conv or size >= PART_CHARS):
                yield conv, part, "".join(pieces), loss
                part = part + 1 if row["conv_id"] == conv else 0
                pieces, size, loss = [], 0, []
            conv, open_ = row["conv_id"], True
            rendered = render(row["role"], row["text"])
            if row["role"] == "assistant":
                begin = rendered.index("\n") + 1
                loss.append({"begin": size + begin, "end": size + len(rendered) - len(END) - 1})
            pieces.append(rendered)
            size += len(rendered)
        if open_:
            yield conv, part, "".join(pieces), loss

    return map_rows(in_order(conversations), PART, rows)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long")


def digest(parts: DataFrame) -> DataFrame:
    """Per conversation, what can be read back from :func:`format_chats`' own rows, hashed as a stream."""
    def rows(stream: Iterator[dict]) -> Iterator[tuple]:
        conv, state = None, None
        for row in stream:
            if state and row["part"] == 0:
                yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                state = None
            conv = row["conv_id"]
            state = state or [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(row["formatted"]):
                state[0] += 1
                state[1].update(encoded(f"{role}\n{text}\n"))
            for span in row["loss"]:
                text = unescape(row["formatted"][span["begin"]:span["end"]])
                state[2] += len(text)
                state[3].update(encoded(text))
            state[4] += len(row["formatted"])
        if state:
            yield conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    return map_rows(parts, DIGEST, rows)
