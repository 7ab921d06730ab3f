"""Partial results behind the statistics: counts by metric, key and value, which merge by adding.

One pass over a table gives everything that its statistics need: each row becomes a few entries, one for each count, profiled
value and list key that it contributes to, and equal entries are added up before they are shuffled. Facts of parts of a table
merge to the facts of the whole, and ``place`` (the row and position seen first) keeps the order of ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nbquarry.operators import summary as S
from nbquarry.operators.filters import has_output_columns
from nbquarry.operators.shred import import_pairs

_ENTRIES = "array<struct<metric: string, key: string, value: double, n: bigint, pos: int>>"
IMPORTS = "top_imports"


def _entry(metric: str, n: Column, key: Column | None = None, value: Column | None = None) -> Column:
    return F.struct(
        F.lit(metric).alias("metric"), (F.lit(None) if key is None else key).cast("string").alias("key"),
        (F.lit(None) if value is None else value).cast("double").alias("value"), n.cast("bigint").alias("n"), F.lit(0).alias("pos"),
    )


def _counted(conditions: dict[str, Column]) -> list[Column]:
    return [_entry(name, F.when(condition, 1)) for name, condition in conditions.items()]


def _valued(values: dict[str, Column]) -> list[Column]:
    return [_entry(name, F.when(value.isNotNull(), 1), value=value) for name, value in values.items()]


def _added_up(df: DataFrame, entries: Column, row_id: str, by: list[str]) -> DataFrame:
    # The outer form keeps the optimizer from testing the list for emptiness first, which would work it out twice.
    flat = df.select(*by, F.col(row_id).alias("row"), F.inline_outer(F.filter(entries.cast(_ENTRIES), lambda e: e.n.isNotNull())))
    return flat.where("metric is not null").groupBy(*by, "metric", "key", "value").agg(
        F.sum("n").alias("n"), F.min(F.struct("row", "pos")).alias("place")
    )


def collection_facts(collection: DataFrame, row_id: str = "row_id", by: list[str] | None = None) -> DataFrame:
    """``(metric, key, value, n, place)`` of a collection; apart for each value of the columns ``by``."""
    fixed = F.array(*_counted(S.collection_conditions()), *_valued(S.collection_values())).cast(_ENTRIES)
    imports = F.transform(import_pairs(F.col("top_imports_json")), lambda p: F.struct(
        F.lit(IMPORTS).alias("metric"), p.module.alias("key"), F.lit(None).cast("double").alias("value"), p.n.alias("n"), p.pos.alias("pos")
    )).cast(_ENTRIES)
    return _added_up(collection, F.concat(fixed, F.coalesce(imports, F.array().cast(_ENTRIES))), row_id, by or [])


def run_facts(runs: DataFrame, row_id: str = "row_id", by: list[str] | None = None) -> DataFrame:
    """The same of runs. What concerns outputs is in it only if their columns are."""
    compared = has_output_columns(runs)
    failed = [_entry(name, F.when(S.is_failure(), 1), key=key) for name, key in S.failure_keys().items()]
    return _added_up(runs, F.array(*_counted(S.run_conditions(compared)), *_valued(S.run_values(compared)), *failed), row_id, by or [])


def merged(facts: DataFrame) -> DataFrame:
    """Facts of parts as facts of the whole."""
    return facts.groupBy("metric", "key", "value").agg(F.sum("n").alias("n"), F.min("place").alias("place"))


def counts_of(facts: DataFrame, names: list[str]) -> DataFrame:
    """One row with a column for each count."""
    of = lambda name: F.coalesce(F.sum(F.when(F.col("metric") == name, F.col("n"))), F.lit(0))
    return facts.where(F.col("metric").isin(names)).agg(*[of(name).alias(name) for name in names])


def values_of(facts: DataFrame, names: list[str]) -> DataFrame:
    """``(metric, value, c)``: distinct values of profiled columns with their counts."""
    return facts.where(F.col("metric").isin(names)).select("metric", "value", F.col("n").alias("c"))
