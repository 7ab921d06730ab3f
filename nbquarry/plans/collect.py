"""From fetched contents to the collection table.

A notebook is one row, so all its metrics are computed inside the row: documents are never shuffled. Only the finished
metrics meet the repository tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from nbquarry.constants import DEFAULT_ITEM_LIMIT, TOP_IMPORTS
from nbquarry.functions import documents as D, marks
from nbquarry.functions.coerce import executed_percent
from nbquarry.functions.names import default_branch
from nbquarry.operators.code import FLAGS, code_features, imports_json, worth_parsing
from nbquarry.operators.filters import is_executed_state, is_python_document, project_fields
from nbquarry.operators.joins import left_join_unique
from nbquarry.operators.repos import fill_dependencies, repo_dependencies
from nbquarry.operators.sampling import CalendarWindow, calendar_windows, limit_items, window_quota
from nbquarry.schema import DEPENDENCY_FIELDS
from nbquarry.sources.archive import archive_row, decode_contents


def _order_metrics(counts: Column, stored: Column) -> list[Column]:
    """Metrics of the integer execution counts in document order; ``stored`` is the number of non-null counts."""
    n = F.array_size(counts)
    distinct = F.array_sort(F.array_distinct(counts))
    n_distinct = F.array_size(distinct)
    item = lambda i: F.element_at(distinct, i)
    return [
        ((n > 0) & (n == stored)).alias("has_unambiguous_order"),
        (counts != F.array_sort(counts)).alias("out_of_order"),
        F.when(n > 0, item(-1) - item(1) + 1 - n_distinct).when(n == 0, F.lit(0)).alias("n_skips_total"),
        F.when(n_distinct > 1, item(-1) - item(2) + 2 - n_distinct).when(n_distinct < 2, F.lit(0)).alias("n_skips_middle"),
        F.when(n > 0, F.array_max(counts)).when(n == 0, F.lit(0)).alias("max_execution_count"),
    ]


def notebook_metrics(notebooks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All content metrics, one row per notebook; NULL metrics where it is undecoded. No shuffle."""
    keep = keep or ["nb_id"]
    cells = notebooks.select(*keep, *D.metadata(notebooks).values(), D.cells_of(notebooks).alias("cells"))
    cells = D.computed_once(cells, "cells")
    of_type = lambda t: F.filter("cells", lambda c: c.cell_type == t)
    split = cells.withColumns({
        "code": of_type("code"),
        "markdown": of_type("markdown"),
        "n_cells_total": F.array_size("cells"),
        "n_raw": F.array_size(of_type("raw")),
    }).drop("cells")
    any_code = lambda test: F.exists("code", test)
    has_kind = lambda test: any_code(lambda c: test(c.mime_types))
    kinds = {name: has_kind(test).alias(name) for name, test in marks.OUTPUT_KINDS.items()}
    read = split.select(
        *keep, "kernel_name", "language", "python_version_declared", "n_cells_total", "n_raw",
        F.array_size("code").alias("n_code"),
        F.array_size("markdown").alias("n_markdown"),
        F.filter(F.transform("code", lambda c: c.execution_count), lambda e: e.isNotNull()).alias("counts"),
        F.array_size(F.filter("code", lambda c: c.execution_count_set)).alias("stored"),
        F.array_size(F.filter("code", lambda c: c.n_outputs > 0)).alias("n_cells_with_output"),
        *kinds.values(),
        any_code(lambda c: marks.has_error_output(c.output_types)).alias("outputs_error"),
        F.exists("markdown", lambda c: marks.mentions_ai(c.source)).alias("ai_marker_found"),
        any_code(lambda c: marks.has_code_fence(c.source)).alias("triple_backticks_in_code"),
        any_code(lambda c: marks.has_absolute_path(c.source)).alias("has_abs_data_path"),
        code_features(F.filter(F.transform("code", lambda c: c.source), worth_parsing)).alias("features"),
    )
    modules = F.col("features.modules")
    decoded = F.col("n_cells_total").isNotNull()
    return read.select(
        *keep, "kernel_name", "language", "python_version_declared",
        "n_cells_total", "n_code", "n_markdown", "n_raw",
        F.array_size("counts").alias("n_code_executed"),
        F.when(decoded, executed_percent(F.array_size("counts"), F.col("n_code"))).alias("percent_code_executed"),
        *_order_metrics(F.col("counts"), F.col("stored")),
        "n_cells_with_output", *kinds, "outputs_error",
        F.when(decoded, F.array_size(modules)).alias("imports_total"),
        F.when(decoded, imports_json(F.slice("features.module_counts", 1, TOP_IMPORTS))).alias("top_imports_json"),
        *[F.when(decoded, F.col(f"features.{flag}")).alias(flag) for flag in FLAGS],
        F.when(decoded, F.exists(modules, marks.is_test_module)).alias("uses_testing_module"),
        "ai_marker_found", "triple_backticks_in_code", "has_abs_data_path",
    )


def keep_unparsed(notebooks: DataFrame, only_python: bool = True) -> DataFrame:
    """Notebooks to measure. Undecoded ones always stay; others must pass the language filter if it is on."""
    if not only_python:
        return notebooks
    return notebooks.where(~D.is_decoded(notebooks) | is_python_document(notebooks))


def _measured(
    contents: DataFrame, only_python: bool, require_outputs: bool, more: Callable[[DataFrame], dict[str, Column]] | None = None
) -> DataFrame:
    """Facts and metrics of the files that pass the filters, one row each. No shuffle."""
    notebooks = keep_unparsed(decode_contents(contents), only_python)
    facts = ["repo_full_name", "file_path", "sha", "size", "html_url"]
    added = more(notebooks) if more else {}
    metrics = notebook_metrics(notebooks.withColumns(added), [*facts, *added]).withColumn("parsed", F.col("n_cells_total").isNotNull())
    return metrics.where(~F.col("parsed") | is_executed_state()) if require_outputs else metrics


def _with_repositories(metrics: DataFrame, repos: DataFrame, repo_tree: DataFrame, count_on: DataFrame) -> DataFrame:
    """The collection, from metrics and what is known of repositories."""
    # Overlapping search windows list a repository more than once.
    listed = ["id", "default_branch", "created_at", "stargazers_count"]
    once = repos.groupBy("full_name").agg(F.min(F.struct(*listed)).alias("r")).select("full_name", "r.*")
    repo_facts = once.select(
        F.col("full_name").alias("repo_full_name"),
        F.col("id").alias("repo_id"),
        default_branch(F.col("default_branch")).alias("repo_default_branch"),
        F.col("created_at").alias("repo_created_at"),
        F.coalesce("stargazers_count", F.lit(0)).alias("repo_stars"),
    ).join(repo_dependencies(repo_tree), "repo_full_name", "left")
    joined = left_join_unique(metrics, repo_facts, ["repo_full_name"], ["file_path"], count_on=count_on)
    deps = fill_dependencies(joined)
    named = deps.withColumnsRenamed({"sha": "file_sha", "size": "file_size", "parsed": "nb_ok_parse"})
    # Dependency flags are metrics too: an undecoded file has none.
    for flag in DEPENDENCY_FIELDS:
        named = named.withColumn(flag, F.when(F.col("nb_ok_parse"), F.col(flag)))
    return project_fields(named)


def build_collection(
    contents: DataFrame,
    repos: DataFrame,
    repo_tree: DataFrame,
    only_python: bool = True,
    require_outputs: bool = False,
    limit: int | None = None,
    order_by: list[Column | str] | None = None,
) -> DataFrame:
    """The 45-column collection.

    ``contents`` has one row per notebook file (``repo_full_name, file_path, sha, size, html_url, encoding, content,
    download_body``), ``repos`` one per repository (of several, the one with the smallest id, then branch, date and stars, counts),
    ``repo_tree`` one per path. Undecoded files give a row with
    ``nb_ok_parse`` False and NULL metrics, whatever the filters. ``limit`` keeps the first rows in ``order_by`` order
    (repository name and path by default).
    """
    metrics = _measured(contents, only_python, require_outputs)
    collection = _with_repositories(metrics, repos, repo_tree, contents)
    return limit_items(collection, order_by or ["repo_full_name", "file_path"], limit)


def _cut_at_quota(collection: DataFrame, windows: list[CalendarWindow] | None, order_by: list[Column | str] | None) -> DataFrame:
    order = order_by or [F.desc("repo_created_at"), "repo_id", "repo_full_name", "file_path"]
    return window_quota(collection, windows or calendar_windows(), F.col("repo_created_at"), order)


def collect_windows(
    contents: DataFrame, repos: DataFrame, repo_tree: DataFrame, windows: list[CalendarWindow] | None = None,
    only_python: bool = True, require_outputs: bool = False, order_by: list[Column | str] | None = None,
) -> DataFrame:
    """The collection of each calendar window, cut at the window's quota in scan order.

    Filters come before the quota: notebooks that they drop use none of it, undecoded ones do. Scan order is that of
    ``order_by``: newest repository first, then by its number and the path, unless given. Adds ``window_id``, its bounds and
    ``quota_rank``. Repositories without a creation date are in no window.
    """
    return _cut_at_quota(build_collection(contents, repos, repo_tree, only_python, require_outputs), windows, order_by)


# Files whose keys are broadcast at most, to pick their documents where they are.
MOST_PICKED = 1 << 20


def collect_and_archive(
    contents: DataFrame, repos: DataFrame, repo_tree: DataFrame, work: str, windows: list[CalendarWindow] | None = None,
    only_python: bool = True, require_outputs: bool = False, order_by: list[Column | str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(collection, archive)``: the collection of :func:`collect_windows`, and the archive rows of its decoded notebooks.

    Documents are decoded once. What passes the filters is written to ``work`` as it is measured, metrics and text side by side;
    the collection reads the metrics alone, and the archive picks texts out of that table where they lie: the quotas bound
    the number of files, so their keys are broadcast, and no document is shuffled.
    """
    archived = lambda notebooks: {"archived": F.when(D.is_decoded(notebooks), archive_row(notebooks, F.col("sha")))}
    measured = _measured(contents, only_python, require_outputs, archived)
    measured.write.mode("overwrite").parquet(work)
    stored = contents.sparkSession.read.schema(measured.schema).parquet(work)
    light = stored.drop("archived")
    collection = _cut_at_quota(_with_repositories(light, repos, repo_tree, light), windows, order_by)
    calendar = windows or calendar_windows()
    if sum(w.quota for w in calendar) > MOST_PICKED:
        raise ValueError(f"quotas of more than {MOST_PICKED} files in all")
    keys = ["repo_full_name", "file_path"]
    picked = F.broadcast(collection.where("nb_ok_parse").select(*keys).distinct())
    return collection, stored.where("archived is not null").join(picked, keys, "left_semi").select("archived.*")


def collected_originals(contents: DataFrame, collection: DataFrame) -> DataFrame:
    """The decoded notebooks that are in ``collection``, ready for ``write_notebook_archive``.

    ``collection`` should be a stored table: it only picks the files to decode.
    """
    keys = collection.where("nb_ok_parse").select("repo_full_name", "file_path").distinct()
    return decode_contents(contents.join(keys, ["repo_full_name", "file_path"], "left_semi")).withColumnRenamed("sha", "file_sha")


__all__ = ["DEFAULT_ITEM_LIMIT", "build_collection", "collect_and_archive", "collect_windows", "collected_originals", "keep_unparsed", "notebook_metrics"]
