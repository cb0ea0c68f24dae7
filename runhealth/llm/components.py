"""Connected components of a table of links, by rounds of star joins with each round's links written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runhealth.llm.common import kept

MAX_ROUNDS = 40


def _to_least(links: DataFrame, larger: bool) -> DataFrame:
    """Join each node's larger (or smaller) neighbours, itself included when smaller, to its least neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not larger:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.where("v > u") if larger else both.unionByName(least.select("u", F.col("u").alias("v")))
    return joined.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v): every linked node u but the least of its component, with that least node v.

    ``links`` (u, v) are undirected; self links and repeated links do no harm. Large-star and
    small-star rounds run until the links no longer change; their number grows with the
    logarithm of the longest chain. Nothing but a count and a checksum comes to the driver.
    """
    now = kept(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
               "links")
    state = None
    for _ in range(MAX_ROUNDS):
        now = kept(_to_least(_to_least(now, True), False), "links")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            return now
        state = seen
    raise RuntimeError(f"links still change after {MAX_ROUNDS} rounds")
