"""Small string, number, time and map helpers shared by every module."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# Characters removed when text is stripped.
WHITESPACE = " \t\n\r\f\x0b"
# The log text layout.
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def succeeded(flag: Column, status: Column) -> Column:
    """Whether something succeeded: by its flag or, where that is not set, by its status."""
    return F.coalesce(F.nullif(flag, F.lit(False)), status == "success", F.lit(False))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, however often ``then`` names it.

    Spark copies a column's expression to each place that names it and evaluates the copies in branches again.
    """
    return F.transform(F.array(value), then)[0]


def contains_any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def title_words(name: Column) -> Column:
    """``cluster_restart`` -> ``Cluster Restart``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def plain_words(name: Column) -> Column:
    """``cluster_restart`` -> ``cluster restart``."""
    return F.replace(name, F.lit("_"), F.lit(" "))


def shorten(text: Column, limit: int = 200) -> Column:
    """Cut display text at ``limit`` characters and mark the cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def tail(text: Column, n: int) -> Column:
    """The last ``n`` characters."""
    return F.right(text, F.lit(n))


def last_segment(name: Column) -> Column:
    """Text after the last dot, stripped."""
    return strip(F.substring_index(name, ".", -1))


def or_default(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def percent_factor(text: Column) -> Column:
    """``"50%"`` -> 1.5; null when the text is not a percentage."""
    return 1.0 + F.btrim(text, F.lit("%")).try_cast("double") / 100.0


def percent_text(ratio: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", F.round(ratio * 100, decimals))


def mb_to_gb(megabytes: Column) -> Column:
    return megabytes / 1024


def lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def in_order(text: Column, rules: list[tuple[list[str], str]], default: str) -> Column:
    """First rule whose terms occur in ``text`` wins."""
    chain = None
    for terms, name in rules:
        hit = contains_any(text, terms)
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit(default))


def rendered_map(m: Column) -> Column:
    """``k=v`` pairs in key order joined by commas: a stable scalar form of a map."""
    pairs = F.array_sort(F.map_entries(m))
    return F.concat_ws(",", F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])))


# -- times -------------------------------------------------------------------

EPOCH = "1970-01-01 00:00:00"


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch for either timestamp type."""
    return F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts)


def epoch_millis(ts: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts)


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole elapsed seconds, computed from milliseconds."""
    return F.floor(F.timestamp_diff("MILLISECOND", start, end) / 1000).cast("bigint")


def time_bucket(ts: Column, width_seconds: int) -> Column:
    return F.floor(epoch_seconds(ts) / width_seconds).cast("bigint")


def log_time(text: Column) -> Column:
    """Parse the log clock; null when it is not a valid time."""
    return text.try_cast("timestamp_ntz")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")
