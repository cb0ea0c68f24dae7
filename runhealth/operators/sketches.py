"""Summaries that are kept by day and merged: distinct counts, quantiles and largest keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runhealth.operators.metrics import key_counts

# Sketch sizes. Distinct counts: 2 ** LG_K registers, a relative standard error of 1.04 / 2 ** (LG_K / 2), 0.8 % here.
# Quantiles: KLL with K 800, whose rank is off by 0.4 % at 99 % confidence.
LG_K, KLL_K = 14, 800
DISTINCT_ERROR = 1.04 / 2 ** (LG_K / 2)
RANK_ERROR = 0.015
BUCKETS = 1 << 16


def _day(ts: str) -> Column:
    return F.to_date(F.col(ts)).alias("dt")


def daily_distinct(df: DataFrame, ts: str, keys: list[str], column: str) -> DataFrame:
    """(dt, keys, rows, sketch): per day and keys the rows, and a sketch of the different values of ``column``, nulls left out."""
    return df.groupBy(_day(ts), *keys).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(column, F.lit(LG_K)).alias("sketch"))


def distinct_over(daily: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, distinct_values): the days of ``daily`` together."""
    return daily.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def daily_quantiles(df: DataFrame, ts: str, keys: list[str], column: str) -> DataFrame:
    """(dt, keys, rows, sketch): per day and keys the rows, and a sketch of the order of ``column``, nulls left out."""
    return df.groupBy(_day(ts), *keys).agg(
        F.count(F.lit(1)).alias("rows"), F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(KLL_K)).alias("sketch"))


def quantiles_over(daily: DataFrame, keys: list[str], ranks: Sequence[float]) -> DataFrame:
    """(keys, rows, p50, ...): values at ``ranks`` over the days of ``daily`` together; null where no value was seen."""
    merged = daily.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch").alias("_all"))
    some = F.kll_sketch_get_n_double("_all") > 0
    return merged.select(*keys, "rows", *[
        F.when(some, F.kll_sketch_get_quantile_double("_all", F.lit(r))).alias(f"p{round(r * 100)}") for r in ranks])


def store_days(daily: DataFrame, path: str) -> None:
    """Write days of sketches; a day that is written again replaces its earlier form, other days stay."""
    daily.hint("rebalance", "dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored days of a span, both ends included; other days' files are not opened."""
    days = spark.read.parquet(path)
    if first is not None:
        days = days.where(F.col("dt") >= F.lit(first).cast("date"))
    return days if last is None else days.where(F.col("dt") <= F.lit(last).cast("date"))


def heaviest_keys(df: DataFrame, column: str, k: int = 10, buckets: int = BUCKETS) -> DataFrame:
    """(key, rows) of the ``k`` largest keys, exact, ties to the smaller key, without a shuffle of all keys.

    Keys are counted by hash bucket first, at most ``buckets`` rows a task and in all. The keys of the fullest buckets are then counted
    one by one; the k-th of them has, say, T rows. A key with T rows or more lies in a bucket with T rows or more, so the keys of
    these buckets, counted one by one, hold every member: the others are proven to be none. A null is a key. On columns without large
    keys most buckets stay, and the count is the plain one.
    """
    bucket = F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")
    spark = df.sparkSession
    full = [(r["bucket"], r["rows"]) for r in df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows")).collect()]
    full.sort(key=lambda b: -b[1])

    def counted(among: list[tuple[int, int]]) -> DataFrame:
        if len(among) == len(full):
            return key_counts(df, column)
        wanted = F.broadcast(spark.createDataFrame([(b,) for b, _ in among], "_wanted int"))
        return key_counts(df.join(wanted, bucket == F.col("_wanted"), "left_semi"), column)

    def largest(found: DataFrame) -> DataFrame:
        return found.orderBy(F.col("rows").desc(), F.col("key").asc_nulls_last()).limit(k)

    first = largest(counted(full[:4 * k])).collect()
    least = first[-1]["rows"] if len(first) == k else 0
    return largest(counted([b for b in full if b[1] >= least]))
