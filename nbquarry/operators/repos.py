"""Repository tables: file lists, dependency files, work lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from nbquarry import constants as K
from nbquarry.functions.names import default_branch
from nbquarry.operators.joins import left_join_unique
from nbquarry.schema import DEPENDENCY_FIELDS


def list_notebook_paths(repo_tree: DataFrame) -> DataFrame:
    """Files whose name ends in ``.ipynb``, in any case and any folder."""
    return repo_tree.where((F.col("type") == "blob") & F.endswith(F.lower("path"), F.lit(K.NOTEBOOK_ENDING)))


def check_date_bounds(start: dt.date | str, end: dt.date | str) -> tuple[dt.date, dt.date]:
    """Both bounds as dates; raises if the end comes first."""
    a, b = (dt.date.fromisoformat(d) if isinstance(d, str) else d for d in (start, end))
    if b < a:
        raise ValueError(f"end date {b} is before start date {a}")
    return a, b


def with_checked_bounds(ranges: DataFrame, start: str = "a", end: str = "b", strict: bool = False) -> DataFrame:
    """Date ranges given as rows, with ``valid``: both ends are dates, and the end does not come first.

    With ``strict`` a range that is not valid fails the job with its bounds, as :func:`check_date_bounds` does on the driver.
    """
    a, b = F.to_date(F.col(start)), F.to_date(F.col(end))
    valid = F.coalesce(a <= b, F.lit(False))
    if strict:
        message = F.concat(F.lit("no date range: "), F.coalesce(a.cast("string"), F.lit("?")), F.lit(" to "), F.coalesce(b.cast("string"), F.lit("?")))
        valid = F.when(valid, True).otherwise(F.raise_error(message).cast("boolean"))
    return ranges.withColumn("valid", valid)


def filter_created_between(
    repos: DataFrame, start: dt.date | str, end: dt.date | str, date_col: str = "created_at"
) -> DataFrame:
    """Repositories created in ``[start, end]``, both days included.

    Comparing the column itself with the bounds, rather than its date, lets the scan skip files and row groups. A table
    stored by date (a ``created_date`` column) also skips folders.
    """
    a, b = check_date_bounds(start, end)
    created = F.col(date_col)
    kept = repos.where((created >= F.lit(a)) & (created < F.lit(b + dt.timedelta(days=1))))
    return kept.where(F.col("created_date").between(F.lit(a), F.lit(b))) if "created_date" in repos.columns else kept


def repo_dependencies(repo_tree: DataFrame) -> DataFrame:
    """Three flags per repository: does any path end like a dependency file?"""
    path = F.lower("path")
    ends = lambda ending: F.coalesce(F.bool_or(F.endswith(path, F.lit(ending))), F.lit(False))
    return repo_tree.groupBy("repo_full_name").agg(
        ends(K.REQUIREMENTS_ENDING).alias("deps_requirements_txt"),
        ends(K.SETUP_ENDING).alias("deps_setup_py"),
        ends(K.PIPFILE_ENDING).alias("deps_pipfile"),
    )


def fill_dependencies(df: DataFrame) -> DataFrame:
    """Missing flags become False, and ``deps_any`` is their disjunction."""
    flags = DEPENDENCY_FIELDS[:3]
    filled = df.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})
    return filled.withColumn("deps_any", F.col(flags[0]) | F.col(flags[1]) | F.col(flags[2]))


def attach_dependencies(metrics: DataFrame, dependencies: DataFrame, spread_by: list[str]) -> DataFrame:
    """Dependency flags of each row's repository; a repository without a file list has none."""
    return fill_dependencies(left_join_unique(metrics, dependencies, ["repo_full_name"], spread_by))


def one_env_per_repo(runs: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Repositories the runs need, once each, in order of first use, with the branch of that first use."""
    branch = default_branch(F.col("repo_default_branch"))
    work = runs.groupBy("repo_full_name").agg(
        F.min(F.struct(F.col(row_id).alias("first_row"), branch.alias("repo_default_branch"))).alias("first")
    )
    return work.select("repo_full_name", "first.repo_default_branch", "first.first_row").orderBy("first_row")
