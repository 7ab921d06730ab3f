"""The most frequent values, exactly, without sending every rare value to the shuffle.

Tasks keep a summary of bounded size: counters, of which all lose the same amount whenever there are too many. What a value may
have lost is known, so merged summaries name every value that is frequent enough, with a bound on the count of all
others. A second pass counts the named values exactly. If the last one wanted is above the bound, no other can be among the
first; if not (counts are too even to tell), everything is counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# Counters of a summary.
COUNTERS = 2048


def trimmed(counts: dict[str, int], most: int) -> tuple[dict[str, int], int]:
    """At most ``most`` counters, and what each of them has lost: the count of the first one that has to go."""
    if len(counts) <= most:
        return counts, 0
    lost = sorted(counts.values(), reverse=True)[most]
    return {k: n - lost for k, n in counts.items() if n > lost}, lost


def summaries(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``(value, n, lost)`` of a task: its counters, and in a row without value what they have lost."""
    counts: Counter = Counter()
    lost = 0
    for batch in batches:
        for entry in pc.value_counts(batch.column(0).drop_null()).to_pylist():
            counts[entry["values"]] += entry["counts"]
        if len(counts) > 2 * most:
            kept, more = trimmed(counts, most)
            counts, lost = Counter(kept), lost + more
    kept, more = trimmed(counts, most)
    names = [*kept, None]
    yield pa.record_batch([pa.array(names, pa.string()), pa.array([*kept.values(), 0], pa.int64()), pa.array([0] * len(kept) + [lost + more], pa.int64())], ["value", "n", "lost"])


def frequent(df: DataFrame, value: str, most: int = COUNTERS) -> tuple[list[str], int]:
    """Values, ``most`` at most, and a bound that the count of no other value exceeds."""
    found = df.select(F.col(value).cast("string").alias("value")).mapInArrow(lambda b: summaries(b, most), "value string, n long, lost long")
    merged = found.groupBy("value").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))
    rows = merged.orderBy(F.col("value").isNotNull(), F.desc("n"), "value").limit(most + 2).collect()
    lost = sum(r.lost for r in rows if r.value is None)
    listed = [r for r in rows if r.value is not None]
    return [r.value for r in listed[:most]], lost + (listed[most].n if len(listed) > most else 0)


def top_values(df: DataFrame, value: str, seen: Column, limit: int, most: int = COUNTERS) -> DataFrame:
    """``(value, n)`` of the ``limit`` most frequent values; ties go to the value with the smallest ``seen``. NULL is no value."""
    def counted(rows: DataFrame) -> DataFrame:
        counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("first_seen"))
        return counts.orderBy(F.desc("n"), "first_seen").limit(limit)

    names, bound = frequent(df, value, most)
    listed = df.sparkSession.createDataFrame([(n,) for n in names], f"{value} string")
    # At most ``most`` names: small enough to broadcast.
    first = counted(df.join(F.broadcast(listed), value, "left_semi")).select(value, "n").collect()
    if bound == 0 or (len(first) == limit and first[-1].n > bound):
        return df.sparkSession.createDataFrame(first, f"{value} string, n long")
    return counted(df).select(value, "n")
