"""A left join that stays balanced when a few keys hold most of the left rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Keys are counted by hash bucket: at most BUCKETS rows per task reach the shuffle, whatever the number of keys, and the
# list of buckets is small enough to broadcast.
BUCKETS = 1 << 16
# Rows that a bucket may have before it is split, and that each of its parts has on average.
PART_ROWS = 1_000_000


def key_bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def heavy_buckets(df: DataFrame, keys: list[str], part_rows: int = PART_ROWS, weight: str | None = None) -> DataFrame:
    """``(_bucket, _parts)`` of the key buckets with more than ``part_rows`` rows, each counted as often as its ``weight`` says.

    Counts are exact, so computing this twice gives the same parts: both sides of a join can rely on it.
    """
    rows = F.lit(1) if weight is None else F.col(weight)
    counts = df.select(key_bucket(keys).alias("_bucket"), rows.alias("_rows")).groupBy("_bucket").agg(F.sum("_rows").alias("rows"))
    return counts.where(F.col("rows") > part_rows).select("_bucket", F.ceil(F.col("rows") / part_rows).cast("int").alias("_parts"))


def spread_left(
    left: DataFrame, heavy: DataFrame, keys: list[str], spread_by: list[str]
) -> DataFrame:
    """``left`` with ``_part``: rows of a heavy bucket are dealt to its parts by a hash of ``spread_by``."""
    # A NULL key matches nothing, so such rows may go anywhere.
    unmatched = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    parts = F.coalesce("_parts", F.when(unmatched, BUCKETS).otherwise(1))
    return left.withColumn("_bucket", key_bucket(keys)).join(heavy, "_bucket", "left").withColumn(
        "_part", F.pmod(F.xxhash64(*spread_by), parts).cast("int")
    ).drop("_bucket", "_parts")


def left_join_unique(
    left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str], how: str = "left",
    count_on: DataFrame | None = None, part_rows: int = PART_ROWS, weight: str | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which has at most one row per key.

    Left rows in a bucket of keys with more than ``part_rows`` rows are dealt to as many parts as keep each below that on
    average, and the right rows of that bucket are repeated once per part; all others are joined as usual. The result
    does not depend on how buckets are split. ``count_on`` may name a cheaper table with the same keys to count on, of which a
    row stands for as many left rows as its column ``weight`` says.
    """
    heavy = F.broadcast(heavy_buckets(left if count_on is None else count_on, keys, part_rows, weight))
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    spread_right = right.withColumn("_bucket", key_bucket(keys)).join(heavy, "_bucket", "left").withColumn(
        "_part", F.explode(parts)
    ).drop("_bucket", "_parts")
    return spread_left(left, heavy, keys, spread_by).join(spread_right, [*keys, "_part"], how).drop("_part")
