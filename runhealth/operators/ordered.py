"""Ordered lookups within a key that hold when one key owns much of the table.

A plain window over ``key`` puts a whole key in one task. Here each key is cut
into buckets along its order. A window runs inside each (key, bucket), one
summary row per bucket carries the value across buckets, and the two are joined
on (key, bucket), the partitioning the window already has. The largest task
holds one key's rows of one bucket; the summary is bucket-count sized.

``bucket`` must be a pure function of the row that never decreases along
``order``. Rows with a null key have no neighbours in :func:`nearest`; totals and
numbers count a null key as a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

_B = "_bucket"


def _sort_columns(order: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]


def _attach(local: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys and bucket in which null keys meet null keys."""
    other = carried.select(*[F.col(c).alias(f"_right_{c}") for c in [*keys, _B]], "_carry")
    same = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in [*keys, _B]]
    return local.join(other, same, "left").drop(*[f"_right_{c}" for c in [*keys, _B]])


def nearest(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str,
            backward: bool = True) -> DataFrame:
    """Add ``name``: the nearest non-null ``value`` strictly before the row.

    ``backward=False`` looks strictly after it instead. ``order`` must be unique
    within a key for a fixed answer.
    """
    bucketed = df.withColumn(_B, bucket).withColumn("_value", value)
    inside = (
        Window.partitionBy(*keys, _B).orderBy(*_sort_columns(order, not backward))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = bucketed.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))

    # One row per bucket, those without a value included: they pass on what was carried past them.
    position = F.when(F.col("_value").isNotNull(), F.struct(*order))
    edge = (F.max_by if backward else F.min_by)(F.col("_value"), position)
    buckets = bucketed.groupBy(*keys, _B).agg(edge.alias("_edge"))
    across = (
        Window.partitionBy(*keys).orderBy(F.col(_B).asc() if backward else F.col(_B).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        buckets.withColumn("_carry", F.last("_edge", ignorenulls=True).over(across))
        .where(F.col("_carry").isNotNull())
        .select(*keys, _B, "_carry")
    )
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return (
        _attach(local, carried, keys)
        .withColumn(name, F.when(known, F.coalesce("_near", "_carry")))
        .drop("_near", "_carry", "_value", _B)
    )


def running_total(df: DataFrame, keys: list[str], order: list[str], bucket: Column, amount: Column,
                  name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the rows up to and including this one."""
    bucketed = df.withColumn(_B, bucket).withColumn("_amount", amount)
    inside = (
        Window.partitionBy(*keys, _B).orderBy(*_sort_columns(order, False))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = bucketed.withColumn("_local", F.sum("_amount").over(inside))
    across = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        bucketed.groupBy(*keys, _B).agg(F.sum("_amount").alias("_total"))
        .withColumn("_carry", F.sum("_total").over(across))
        .where(F.col("_carry").isNotNull())
        .select(*keys, _B, "_carry")
    )
    return (
        _attach(local, carried, keys)
        .withColumn(name, F.col("_local") + F.coalesce("_carry", F.lit(0)))
        .drop("_local", "_carry", "_amount", _B)
    )


def running_number(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Add ``name``: 1 for a key's first row, 2 for its second, and so on."""
    return running_total(df, keys, order, bucket, F.lit(1).cast("bigint"), name)


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "position") -> DataFrame:
    """The first ``n`` rows per key, numbered.

    Spark cuts each map task to ``n`` rows per key before the shuffle, so a hot
    key sends ``n`` rows per task at most.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, number).where(F.col(name) <= n)
