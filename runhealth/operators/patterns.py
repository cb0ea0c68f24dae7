"""Tag lines by a table of patterns, through an index of the patterns' literals by gram.

Every match of a pattern holds its literal, so it holds each run of characters in that. A pattern's grams are the runs of its literal as long
as the literal, up to ``GRAM`` characters; it is entered in the index under the gram that the fewest patterns share. A line meets only the
patterns entered under its own grams of 3 to ``GRAM`` characters, and a regular expression runs only where the whole literal is there.
Grams longer than three characters keep apart patterns that differ in a number: a million ``job_<n>`` patterns share every trigram of digits,
and a line with one of those would meet a share of all patterns that grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A pattern's plain beginning: characters that stand for themselves, and escaped punctuation.
PLAIN = r"^(?:[A-Za-z0-9 _'\":;,<>=!@#%&/~`-]|\\[^A-Za-z0-9\s])+"
FOLD = r"^\(\?i\)"
INDEX_ROWS = 1 << 20
GRAM = 8


def literal_of(pattern: Column) -> Column:
    """Lower-case text that every match of a pattern holds: its plain beginning, without a last character that a
    quantifier makes optional. Null if that is shorter than a trigram or an alternative stands outside of groups."""
    body = F.regexp_replace(pattern, FOLD, "")
    plain = F.regexp_extract(body, PLAIN, 0)
    rest = F.substring(body, F.length(plain) + 1, F.length(body))
    sure = F.when(rest.rlike(r"^[?*{]"), F.regexp_replace(plain, r"(\\.|[^\\])$", "")).otherwise(plain)
    literal = F.lower(F.regexp_replace(sure, r"\\(.)", "$1"))
    return F.when((F.length(literal) >= 3) & ~pattern.contains("|"), literal)


def grams(text: Column, size: Column | int) -> Column:
    """The different runs of ``size`` characters."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size))))


def line_grams(text: Column) -> Column:
    """The different runs of 3 to ``GRAM`` characters."""
    empty = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.coalesce(grams(text, size), empty) for size in range(3, GRAM + 1)]))


def pattern_index(patterns: DataFrame) -> DataFrame:
    """(gram, name, pattern, literal) of patterns with a literal, each under its rarest gram."""
    literal = F.col("literal")
    grams_of = patterns.where("literal IS NOT NULL").select(
        "name", "pattern", "literal", F.explode(grams(literal, F.least(F.length(literal), F.lit(GRAM)))).alias("gram"))
    shared = grams_of.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = F.min_by("gram", F.struct("_n", "gram"))
    return grams_of.join(shared, "gram").groupBy("name", "pattern", "literal").agg(rarest.alias("gram"))


def tag_patterns(lines: DataFrame, patterns: DataFrame, key: list[str], text: str = "message", index_rows: int = INDEX_ROWS) -> DataFrame:
    """``lines`` with ``tags``, the sorted names of all patterns that match; ``key`` names each line.

    ``patterns`` has name, pattern and, if it likes, ``literal``: text that every match holds. Letter case does not count for literals; it does
    for patterns, but for those that begin with ``(?i)``. A pattern without a literal is tried on every line: give it one.
    Up to ``index_rows`` patterns are sent to all tasks; a larger index is joined by shuffle. A null text has no tags. A match leaves a
    line's task as its key and a name.
    """
    known = patterns if "literal" in patterns.columns else patterns.withColumn("literal", F.lit(None).cast("string"))
    known = known.select("name", "pattern", F.coalesce(F.lower("literal"), literal_of(F.col("pattern"))).alias("literal")) \
        .withColumn("literal", F.when(F.length("literal") >= 3, F.col("literal")))
    index = pattern_index(known)
    held = lines.select(*key, F.col(text).alias("_text")).where("_text IS NOT NULL")
    small = known.limit(index_rows + 1).count() <= index_rows
    sides = F.broadcast if small else (lambda df: df)
    by_gram = held.withColumn("gram", F.explode(line_grams(F.lower("_text")))).join(sides(index), "gram") \
        .where(F.lower("_text").contains(F.col("literal")) & F.expr("_text RLIKE pattern"))
    loose = known.where("literal IS NULL").select("name", "pattern")
    on_every_line = held.join(sides(loose), F.expr("_text RLIKE pattern"))
    found = by_gram.select(*key, "name").unionByName(on_every_line.select(*key, "name")).groupBy(*key).agg(
        F.sort_array(F.collect_set("name")).alias("tags"))
    other = found.withColumnsRenamed({k: f"_{k}" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return lines.join(other, same, "left").drop(*[f"_{k}" for k in key]).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
