"""Running state within a key, as a parallel scan of composed functions.

What a row does to the state is a small function, given as a struct. Functions compose to functions of the same shape,
so the rows of a bucket become one function, buckets of buckets another, and so on; states then come down the
same levels. Rows are read and shuffled once, by key and bucket, so a key of any size is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

_B = "_bucket"
FAN = 512
LEVELS = 3

Compose = Callable[[Column, Column], Column]


def states_before(df: DataFrame, keys: list[str], order: list[str], bucket: Column, function: Column, compose: Compose,
                  apply: Compose, start: Column, name: str, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Add ``name``: the state before each row, ``start`` before a key's first.

    ``compose(f, g)`` is g after f, ``apply(state, f)`` the state after f. ``bucket`` is a whole number that never decreases along
    ``order``, ``order`` is unique within a key and its nulls come first; a null key is a key. A bucket's rows are one array in memory;
    ``fan`` buckets make one on the next level, and ``levels`` levels hold fan ** levels buckets before the last one grows.
    """
    rest = [c for c in df.columns if c not in {*keys, *order}]
    rows = df.withColumns({_B: bucket, "_does": function}).groupBy(*keys, _B).agg(
        F.array_sort(F.collect_list(F.struct(*order, "_does", *rest))).alias("_rows"))
    if levels:
        all_rows = F.aggregate(F.slice("_rows", 2, F.size("_rows")), F.col("_rows")[0]["_does"], lambda f, row: compose(f, row["_does"]))
        # Both uses of ``rows`` need the same shuffle, which is done once.
        buckets = rows.select(*keys, F.col(_B).alias("_place"), all_rows.alias("_step"))
        entered = states_before(buckets, keys, ["_place"], F.floor(F.col("_place") / fan).cast("bigint"), F.col("_step"),
                                compose, apply, start, "_enters", fan, levels - 1)
        other = entered.select(*[F.col(k).alias(f"_right_{k}") for k in keys], F.col("_place").alias(f"_right_{_B}"), "_enters")
        same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in [*keys, _B]]
        rows = rows.join(other, same).drop(*[f"_right_{k}" for k in [*keys, _B]])
    else:
        whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(_B, "_rows"))), lambda b: b["_rows"]))
        rows = rows.groupBy(*keys).agg(whole.alias("_rows")).withColumn("_enters", start)

    def step(done: Column, row: Column) -> Column:
        return F.struct(
            apply(done["state"], row["_does"]).alias("state"),
            F.concat(done["seen"], F.array(done["state"])).alias("seen"))
    begin = F.struct(F.col("_enters").alias("state"), F.slice(F.array("_enters"), 1, 0).alias("seen"))
    seen = F.aggregate("_rows", begin, step, lambda done: done["seen"])
    return rows.select(*keys, F.explode(F.arrays_zip(F.col("_rows").alias("row"), seen.alias("seen"))).alias("_one")).select(
        *keys, *[F.col(f"_one.row.{c}").alias(c) for c in [*order, *rest]], F.col("_one.seen").alias(name))
