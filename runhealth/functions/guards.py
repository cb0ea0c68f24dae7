"""Checks on text, scores and parameters before they are used."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from runhealth.functions.text import strip

# Shortest text, severity, secret keys, penalties, log levels.
MIN_LENGTH = 5
SHORT_SEVERITY = 0.8
SECRET_KEYS = ["token", "password", "secret"]
SUSPECT_FACTOR = 0.5
UNSAFE_FACTOR = 0.3
LEVELS = {"debug": 10, "info": 20, "warning": 30, "error": 40, "critical": 50}
SCORE_NAMES = ["Harmful", "Harassment", "Hate", "Sexual", "Self-harm"]


def _length_guard(text: Column, minimum: int, reason: str) -> Column:
    short = F.coalesce(F.length(strip(text)) < minimum, F.lit(True))
    return F.struct(
        (~short).alias("is_valid"),
        F.when(short, F.lit(reason)).alias("reason"),
        F.when(short, F.lit(SHORT_SEVERITY)).otherwise(F.lit(0.0)).alias("severity"),
    )


def input_guard(text: Column, minimum: int = MIN_LENGTH) -> Column:
    return _length_guard(text, minimum, "The request is too short to work on")


def output_guard(text: Column, minimum: int = MIN_LENGTH) -> Column:
    return _length_guard(text, minimum, "The result is too short to be of use")


def confidence_in_range(confidence: Column) -> Column:
    return F.coalesce(confidence.between(0.0, 1.0), F.lit(False))


def redact(parameters: Column) -> Column:
    """Drop secret keys; the match is exact, so ``Token`` stays."""
    return F.map_filter(parameters, lambda k, _: ~k.isin(SECRET_KEYS))


def penalise_confidence(confidence: Column, suspect: Column, unsafe: Column) -> Column:
    """Lower a confidence for suspect output and for unsafe output; both can apply."""
    return (
        confidence
        * F.when(suspect, F.lit(SUSPECT_FACTOR)).otherwise(F.lit(1.0))
        * F.when(unsafe, F.lit(UNSAFE_FACTOR)).otherwise(F.lit(1.0))
    )


def safety_details(scores: list[Column]) -> Column:
    """A line per positive score, in the order of ``SCORE_NAMES``."""
    lines = [
        F.when(s > 0, F.format_string(f"{n} content detected (score: %.2f)", F.round(s, 2)))
        for n, s in zip(SCORE_NAMES, scores)
    ]
    return F.concat_ws("\n", *lines)


def level_rank(level: Column) -> Column:
    low = F.lower(level)
    chain = None
    for name, rank in LEVELS.items():
        chain = F.when(low == name, F.lit(rank)) if chain is None else chain.when(low == name, F.lit(rank))
    return chain.otherwise(F.lit(LEVELS["info"]))


def level_at_least(level: Column, threshold: str = "info") -> Column:
    """At or above a level; a name that is not a level counts as info on either side."""
    return level_rank(level) >= LEVELS.get(threshold.lower(), LEVELS["info"])
