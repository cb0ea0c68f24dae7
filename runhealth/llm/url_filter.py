"""URL filter: rules by host and path, and a blocked Bloom filter before an exact join with listed URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
# Query parameters that name a visit and not a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS_PER_BLOCK = 8
BITS_PER_KEY = 16
# Blocks are joined by broadcast up to this size, by shuffle beyond it.
BROADCAST_BYTES = 32 << 20


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query). Host and path as the rules see them; all empty for null or no ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return F.translate(host, UPPER, LOWER), path, query


def canonical(host: Column, path: Column, query: Column) -> Column:
    """Host without a leading ``www.``, path without trailing slashes, sorted parameters without tracking ones."""
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    site = F.regexp_replace(host, r"^www\.", "")
    return F.concat(site, F.regexp_replace(path, r"/+$", ""),
                    F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (size, rule, verdict) of the longest fitting rule, null without one. ``rules`` is a short list by value."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
               F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """One bit in each of the block's eight 64-bit words, from six bits each of a second hash."""
    second = F.xxhash64(key, F.lit("bits"))
    bit = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS_PER_BLOCK)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bit]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w7): the filter as a table, made with one partial aggregation."""
    masks = _masks(F.col("key"))
    return listed.select(_block(F.col("key"), n_blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)]) \
        .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS_PER_BLOCK)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical, listed) for every row of ``pages`` (page_id, url).

    The longest fitting rule decides; without one, a page is blocked if its canonical URL is in
    ``listed`` (column ``url``), else allowed. Rows that may be listed are found with the Bloom
    filter, whose size follows the list (one counting job); only they meet the list in an exact
    join, which drops the filter's false positives. Pages that a rule decides skip both.
    A null URL, or one without ``://``, has empty host and path and is allowed. Repeated rows stay.
    An empty list blocks nothing. Other columns of ``pages`` are ignored.
    """
    host, path, query = host_and_path(F.col("url"))
    judged = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"), query.alias("query")) \
        .withColumn("key", canonical(F.col("host"), F.col("path"), F.col("query"))) \
        .withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    l_host, l_path, l_query = host_and_path(F.col("url"))
    keys = listed.where(F.col("url").contains("://")).select(canonical(l_host, l_path, l_query).alias("key")).distinct()

    n_blocks = max(1, -(-keys.count() * BITS_PER_KEY // (64 * WORDS_PER_BLOCK)))
    blocks = bloom_blocks(keys, n_blocks)
    if n_blocks * (WORDS_PER_BLOCK + 1) * 8 <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    masks = _masks(F.col("key"))
    hit = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(masks)])
    probed = judged.withColumn("block", _block(F.col("key"), n_blocks)).join(blocks, "block", "left") \
        .withColumn("maybe", F.col("best").isNull() & F.coalesce(hit, F.lit(False)))
    # Rows that the filter rules out never meet the list, so only possible hits are shuffled.
    hits = probed.where("maybe").join(keys.withColumn("found", F.lit(True)), "key", "left")
    found = probed.where("not maybe").withColumn("found", F.lit(None).cast("boolean")).unionByName(hits)
    return found.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("found"), "block").otherwise("allow")).alias("verdict"),
        F.col("key").alias("canonical"), F.coalesce("found", F.lit(False)).alias("listed"))
