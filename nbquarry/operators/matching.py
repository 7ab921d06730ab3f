"""Matching runs with archived originals and with collected notebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from nbquarry.functions.names import owner_of, repo_of, sanitize_file_name, sanitize_name
from nbquarry.operators.joins import PART_ROWS, left_join_unique


def originals_by_name(originals: DataFrame, carry: list[str]) -> DataFrame:
    """For each ``(owner, repo, name)`` the original with the smallest archive name that ends in ``_`` + name.

    The endings of an archive name after each underscore are finitely many and short, so they are listed, and a suffix
    match becomes an equality on a key with one row.
    """
    words = F.split("archive_name", "_", -1)
    endings = F.transform(
        F.sequence(F.lit(2), F.array_size(words)), lambda i: F.array_join(F.slice(words, i, F.array_size(words)), "_")
    )
    named = originals.where(F.contains("archive_name", F.lit("_"))).select(
        "owner", "repo", F.explode(endings).alias("match_name"), F.struct("archive_name", *carry).alias("original")
    )
    return named.groupBy("owner", "repo", "match_name").agg(
        F.min_by("original", F.col("original.archive_name")).alias("original")
    )


def match_originals(
    runs: DataFrame, originals: DataFrame, carry: list[str], spread_by: list[str], count_on: DataFrame | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Each run with the chosen original's ``archive_name`` and ``carry`` columns, NULL where none matches."""
    keys = ["_owner", "_repo", "_name"]
    keyed = lambda df: df.withColumns({
        "_owner": sanitize_name(owner_of(F.col("repo_full_name"))),
        "_repo": sanitize_name(repo_of(F.col("repo_full_name"))),
        "_name": sanitize_file_name(F.col("file_path")),
    })
    named = originals_by_name(originals, carry).toDF(*keys, "_original")
    counted = None if count_on is None else keyed(count_on)
    matched = left_join_unique(keyed(runs), named, keys, spread_by, count_on=counted, part_rows=part_rows)
    return matched.select(*runs.columns, *[F.col(f"_original.{c}").alias(c) for c in ["archive_name", *carry]])


NOTEBOOK = ["repo_full_name", "file_path"]
TRAITS = ["deps_any", "out_of_order", "has_abs_data_path"]


def runs_with_collection(
    runs: DataFrame, collection: DataFrame, carry: list[str], spread_by: list[str], part_rows: int = PART_ROWS
) -> DataFrame:
    """Each run next to the ``carry`` columns of its collected notebook, NULL where it was not collected.

    A notebook that is listed more than once gives a row for each listing. Runs of a notebook that is run very often are
    dealt to several tasks, with its listings repeated for each.
    """
    listed = collection.select(*NOTEBOOK, *carry)
    return left_join_unique(runs, listed, NOTEBOOK, spread_by, count_on=runs.select(*NOTEBOOK), part_rows=part_rows)


def errors_by_notebook_traits(runs: DataFrame, collection: DataFrame) -> DataFrame:
    """Runs counted by error and by the notebook's dependencies, order and absolute paths.

    Both sides are counted before they meet, so a notebook that is listed or run many times does not multiply rows; the
    product of the counts is what joining row by row would give. Runs without a collected notebook have NULL traits.
    """
    run_counts = runs.groupBy(*NOTEBOOK, "error").agg(F.count(F.lit(1)).alias("runs"))
    trait_counts = collection.groupBy(*NOTEBOOK, *TRAITS).agg(F.count(F.lit(1)).alias("listings"))
    joined = run_counts.join(trait_counts, NOTEBOOK, "left")
    weight = F.col("runs") * F.coalesce(F.col("listings"), F.lit(1))
    return joined.groupBy("error", *TRAITS).agg(F.sum(weight).alias("n"))


def error_cube(runs: DataFrame, collection: DataFrame) -> DataFrame:
    """The counts of :func:`errors_by_notebook_traits` with every subtotal over error and traits.

    ``level`` is the grouping id: a set bit marks a dimension that is added up (8 for the error, then 4, 2 and 1 for the traits),
    which tells a subtotal from a missing value. ``pct`` is the error's share among the runs with the same traits, 100 where errors
    are added up. The cube is taken over counted rows: as many as there are errors and traits, not runs.
    """
    dims = ["error", *TRAITS]
    counted = errors_by_notebook_traits(runs, collection)
    cube = counted.cube(*dims).agg(F.grouping_id(*dims).cast("int").alias("level"), F.sum("n").alias("n"))
    same_traits = Window.partitionBy(*TRAITS, F.col("level") % (1 << len(TRAITS)))
    return cube.withColumn("pct", 100 * F.col("n") / F.max("n").over(same_traits))
