"""Exact medians and means of numeric columns, without gathering the values in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Buckets per doubling of a value's size. Values of one bucket differ by less than 1/4096 of their size.
_BUCKETS_PER_DOUBLING = 4096


def _bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises: sign, binary exponent, leading digits of the mantissa."""
    beyond = F.lit(1 << 40)
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    mantissa = size / F.pow(F.lit(2.0), exponent)
    steps = (exponent + 1100) * _BUCKETS_PER_DOUBLING + F.floor((mantissa - 1) * _BUCKETS_PER_DOUBLING)
    return (
        F.when(value == 0, F.lit(0))
        .when(F.isnan(value) | (value == float("inf")), beyond)
        .when(value == float("-inf"), -beyond)
        .otherwise((F.signum(value) * steps).cast("bigint"))
    )


def median_and_mean(values: DataFrame) -> DataFrame:
    """``(metric, n, median, mean)`` from rows of ``(metric, value)``; NULL values are left out.

    Values are counted by distinct value, combined before the shuffle and spread over the cluster by value, so neither a
    common value nor a common metric overloads a task. A histogram over bounded buckets shows which buckets hold the two
    middle ranks, and only the distinct values of those are sorted.
    """
    counts = values.where(F.col("value").isNotNull()).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("c"))
    return median_and_mean_of_counts(counts)


def median_and_mean_of_counts(counts: DataFrame) -> DataFrame:
    """The same from distinct values with their counts, ``(metric, value, c)``."""
    # Never NULL, and known to be: a test for NULL on one of the two uses below would keep them from sharing a shuffle.
    counts = counts.withColumn("bucket", F.coalesce(_bucket(F.col("value")), F.lit(0)))
    histogram = counts.groupBy("metric", "bucket").agg(
        F.sum("c").alias("c"), F.sum(F.col("value") * F.col("c")).alias("total")
    )
    upward = Window.partitionBy("metric").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("metric")
    placed = histogram.select(
        "metric", "bucket", "c",
        F.coalesce(F.sum("c").over(upward), F.lit(0)).alias("below"),
        F.sum("c").over(whole).alias("n"),
        (F.sum("total").over(whole) / F.sum("c").over(whole)).alias("mean"),
    )
    lower_rank, upper_rank = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    # At most two buckets per metric hold a middle rank, and metrics are named in code: small enough to broadcast.
    middle = placed.where((F.col("below") <= upper_rank) & (F.col("below") + F.col("c") > lower_rank)).drop("c")
    inside = Window.partitionBy("metric", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.join(F.broadcast(middle), ["metric", "bucket"]).withColumn(
        "start", F.col("below") + F.coalesce(F.sum("c").over(inside), F.lit(0))
    )
    chosen = ranked.where((F.col("start") <= upper_rank) & (F.col("start") + F.col("c") > lower_rank))
    return chosen.groupBy("metric").agg(
        F.first("n").alias("n"), ((F.min("value") + F.max("value")) / 2).alias("median"), F.first("mean").alias("mean")
    )
