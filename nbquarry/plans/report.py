"""The whole report as one long table ``(section, metric, dim, n, value)``.

Each input is read once, into its facts (``operators.facts``), which are stored: they hold distinct values and keys with their
counts, and all statistics are worked out from them. Only the examples of divergent runs take a second look at the runs.
Facts of window files can be kept and merged, so that a new window does not make the old ones be read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from nbquarry import constants as K
from nbquarry.operators import facts as P, summary as S
from nbquarry.operators.filters import has_output_columns
from nbquarry.operators.profile import median_and_mean_of_counts
from nbquarry.session import scratch_path

_FAILURE_METRICS = {
    "error": "top_errors", "repo_full_name": "failures_by_repo", "notebook": "failures_by_notebook",
}


def _part(df: DataFrame, section: Column, metric: Column, dim: Column, n: Column, value: Column) -> DataFrame:
    return df.select(
        section.alias("section"), metric.cast("string").alias("metric"), dim.cast("string").alias("dim"),
        n.cast("bigint").alias("n"), value.cast("double").alias("value"),
    )


def _none() -> Column:
    return F.lit(None)


def _profile(df: DataFrame, section: Column) -> DataFrame:
    """Two rows per metric: its median and its mean."""
    kinds = F.array(
        F.struct(F.lit("median").alias("dim"), F.col("median").alias("value")),
        F.struct(F.lit("mean").alias("dim"), F.col("mean").alias("value")),
    )
    long = df.select("metric", "n", F.inline(kinds))
    return _part(long, section, F.col("metric"), F.col("dim"), F.col("n"), F.col("value"))


def collection_report(facts: DataFrame) -> list[DataFrame]:
    """The parts of the report that concern the collection, from its facts."""
    section = F.lit("collection")
    counts = P.counts_of(facts, list(S.collection_conditions()))
    counted = S.rates(counts, [("rows", "rows", "rows"), *S.FLAG_RATES])
    share = F.when(F.col("metric") != "rows", F.col("pct"))
    imports = facts.where(F.col("metric") == P.IMPORTS).orderBy(F.desc("n"), "place").limit(K.TOP_IMPORTS)
    return [
        _part(counted, section, F.col("metric"), _none(), F.col("n"), share),
        _profile(median_and_mean_of_counts(P.values_of(facts, list(S.collection_values()))), section),
        _part(imports, section, F.lit(P.IMPORTS), F.col("key"), F.col("n"), _none()),
    ]


def _failure_lists(facts: DataFrame) -> DataFrame:
    """The first keys of each failure list. The longest list's length is a rank limit, applied before the shuffle."""
    order = Window.partitionBy("metric").orderBy(F.desc("n"), "place", "key")
    ranked = facts.where(F.col("metric").isin(list(S.FAILURE_LISTS))).withColumn("rank", F.row_number().over(order))
    length = F.create_map(*[F.lit(x) for item in S.FAILURE_LISTS.items() for x in item])[F.col("metric")]
    return ranked.where(F.col("rank") <= max(S.FAILURE_LISTS.values())).where(F.col("rank") <= length)


def run_report(facts: DataFrame, compared: bool, divergent: DataFrame | None = None) -> list[DataFrame]:
    """The parts that concern runs, from their facts; with ``compared`` also the comparison of outputs."""
    outputs_metrics = ["originals_found", "equal_all", "equal_ok", "reproduced", "reproduced_ok",
                       "n_outputs_orig", "n_outputs_exec"]
    metric = F.col("metric")
    section = F.when(metric.isin(outputs_metrics), F.lit("outputs")).otherwise(F.lit("runs"))
    entries = S.SUCCESS_RATE + (S.FOUND_RATE + S.EQUAL_RATES + S.KPIS if compared else [])
    kpis = ["reproduced", "reproduced_ok"]
    counts = P.counts_of(facts, list(S.run_conditions(compared)))
    counted = S.rates(counts, entries).where(~metric.isin(kpis) | (F.col("of") > 0))
    shown_base = F.when(metric.isin("success", *kpis), F.col("of"))
    list_name = F.coalesce(*[F.when(metric == k, F.lit(v)) for k, v in _FAILURE_METRICS.items()])
    parts = [
        _part(counted, section, metric, shown_base, F.col("n"), F.col("pct")),
        _part(_failure_lists(facts), F.lit("runs"), list_name, F.col("key"), F.col("n"), _none()),
        _profile(median_and_mean_of_counts(P.values_of(facts, list(S.run_values(compared)))), section),
    ]
    if divergent is not None:
        pair = F.concat_ws(" ", "notebook", "hash_orig", "hash_exec")
        parts.append(_part(divergent, F.lit("outputs"), F.lit("divergence"), pair, F.col("n_orig"), F.col("n_exec")))
    return parts


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def corpus_report(collection: DataFrame, runs: DataFrame | None = None, row_id: str = "row_id", work: str | None = None) -> DataFrame:
    """All statistics. The run block needs ``runs``, the output block its output columns.

    The inputs are read when this is called; their facts are stored under ``work``, a new folder in the shared one by default.
    """
    work = work or scratch_path(collection.sparkSession, "report")
    parts = collection_report(_stored(P.collection_facts(collection, row_id), f"{work}/collection"))
    if runs is not None:
        compared = has_output_columns(runs)
        divergent = S.divergence_examples(runs, row_id) if compared else None
        parts += run_report(_stored(P.run_facts(runs, row_id), f"{work}/runs"), compared, divergent)
    return reduce(DataFrame.unionByName, parts)


# ---- window by window ----

def keep_window_facts(windows: DataFrame, store: str, row_id: str = "row_order", window: str = "window_file") -> None:
    """Add the facts of window files to ``store``, one folder per file.

    ``windows`` has the rows of one or more files, told apart by ``window``. A file that is given again replaces its facts, so a run
    may be repeated. ``row_id`` must order rows across files.
    """
    named = windows.withColumn("window", F.sha1(F.col(window)))
    facts = P.collection_facts(named, row_id, by=["window"])
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window").parquet(store)


def report_over_windows(spark: SparkSession, store: str) -> DataFrame:
    """The collection's part of the report, from the facts of all windows; no window file is read again."""
    facts = P.merged(spark.read.parquet(store))
    return reduce(DataFrame.unionByName, collection_report(facts))
