"""Quality rules: judge each line, drop the lines that fail, reject documents that lose too much."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from runhealth.llm.common import SPACES, map_rows, words

# Symbols that count, and separators of menus.
SYMBOLS = "#*$%&|<>"
SEPARATORS = {b"|", b">", b"\xc2\xbb", b"\xe2\x80\xba", b"\xc2\xb7", b"\xe2\x80\xa2"}
BOILERPLATE = re.compile(
    r"all rights reserved|accept (all )?cookies|uses? cookies|cookie policy|privacy policy|terms of (use|service)"
    r"|enable javascript|javascript is (required|disabled)|subscribe to our newsletter|click here|read more$"
    r"|share (this )?on (facebook|twitter)|lorem ipsum|log ?in or register|skip to content", re.IGNORECASE)
MARK = re.compile(r"[^\W_]")


@dataclass(frozen=True)
class Rules:
    """Production limits. ``max_lost`` is the share of a text's word characters that failing lines may hold."""

    max_symbols: float = 0.08
    min_separators: int = 2
    separators_per_word: float = 0.15
    boilerplate_words: int = 25
    max_lost: float = 0.4
    window: int = 5
    min_words: int = 10
    max_repeat: float = 0.2


def failing_rule(line: str, rules: Rules) -> str | None:
    """``punctuation``, ``navigation`` or ``boilerplate``; None for a line that passes. A line without words passes."""
    found = words(line)
    if not found:
        return None
    separators = sum(w in SEPARATORS for w in found)
    if separators >= rules.min_separators and separators >= rules.separators_per_word * len(found):
        return "navigation"
    symbols = sum(line.count(s) for s in SYMBOLS)
    if not MARK.search(line) or symbols > rules.max_symbols * sum(map(len, found)):
        return "punctuation"
    if len(found) <= rules.boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    return None


def repeated_words(found: list[bytes], window: int) -> int:
    """Words that lie in a window of ``window`` words which the text holds twice or more, the first one included."""
    grams = list(zip(*(found[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    often = Counter(grams)
    covered = reach = 0
    for at, gram in enumerate(grams):
        if often[gram] > 1:
            covered += at + window - max(at, reach)
            reach = at + window
    return covered


def measure(text: str | None, rules: Rules) -> tuple[int, int, int, int, int, bool, bool, str, int]:
    """Base figures, both verdicts, the text of passing lines, and how many lines failed."""
    text = text or ""
    found = words(text)
    lines = text.split("\n")
    filled = [line for line in lines if line.strip(SPACES)]
    repeats = repeated_words(found, rules.window)
    failed = len(found) < rules.min_words or repeats > rules.max_repeat * len(found)
    passing = [line for line in lines if failing_rule(line, rules) is None]
    left = sum(map(len, words("\n".join(passing))))
    lost = sum(map(len, found)) - left
    return (
        len(found), len(text) - sum(text.count(s) for s in SPACES), sum(text.count(s) for s in SYMBOLS),
        len(filled) - len(set(filled)), repeats, failed,
        not failed and lost <= rules.max_lost * (left + lost), "\n".join(passing), len(lines) - len(passing))


MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, kept boolean, cleaned string, n_failed_lines long")


def judge_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): figures, verdict, and the text of the lines that pass.

    Lines fail for too many symbols or no letter or digit (punctuation), for menu separators
    (navigation), or as a short line with a stock phrase (boilerplate). A document is rejected
    when its base figures fail or when failing lines hold over ``max_lost`` of its word
    characters. Null and empty text has no words and is rejected. Rows are judged on their own:
    repeated rows give repeated results, and other columns are ignored. No shuffle.
    """
    def rows(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            yield row["doc_id"], *measure(row["text"], rules)

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), f"doc_id long, {MEASURES}", rows)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, without their failing lines; columns of ``documents``."""
    def rows(stream: Iterator[dict]) -> Iterator[tuple]:
        for row in stream:
            *_, good, cleaned, n_failed = measure(row["text"], rules)
            if good:
                n_chars = len(cleaned) if n_failed else row["n_chars"]
                yield row["doc_id"], cleaned if n_failed else row["text"], row["lang"], row["source"], n_chars

    frame = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return map_rows(frame, frame.schema, rows)
