"""Files in and out, and repository trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from nbquarry.operators import filters, repos, sampling as P
from nbquarry.schema import COLLECTION_SCHEMA, RUN_SCHEMA
from nbquarry.sources import tables as T
from nbquarry.streaming.quota import incremental_quota
from nbquarry.streaming.windows import incremental_windows
from registry import fixtures as X
from registry.book import checked
from registry.sampling_queries import WINDOWS
from registry.scratch import scratch_path

_COLLECTION = f"with {X.duck_views('fx_collection')}"
_RUNS = f"with {X.duck_views('fx_runs')}"
_TREE = f"with {X.duck_views('fx_tree')}"
_BOOL = lambda c: f"case when {c} <> '' then lower({c}) in ('true', '1', 'yes', 'y', 't') end"
_TEXT = lambda c: f"nullif({c}, '')"
_NUMBER = lambda c: f"case when {c} <> '' then coalesce(try_cast(try_cast({c} as double) as bigint), 0) end"

_FIELDS = [
    "repo_full_name", "file_path", "repo_created_at", "nb_ok_parse", "language", "n_code", "n_markdown",
    "percent_code_executed", "deps_any", "out_of_order", "top_imports_json",
]
_TYPED = f"""{_COLLECTION}
select repo_full_name, file_path, cast(left(repo_created_at, 10) || ' 12:00:00' as timestamp) as repo_created_at,
  {_BOOL('nb_ok_parse')} as nb_ok_parse, {_TEXT('language')} as language, {_NUMBER('n_code')} as n_code,
  {_NUMBER('n_markdown')} as n_markdown, case when percent_code_executed <> '' then coalesce(try_cast(percent_code_executed as double), 0) end as percent_code_executed,
  {_BOOL('deps_any')} as deps_any, {_BOOL('out_of_order')} as out_of_order, {_TEXT('top_imports_json')} as top_imports_json
from fx_collection"""


def _collection(spark, sf):
    return filters.project_fields(T.type_columns(X.view(spark, sf, "fx_collection"), COLLECTION_SCHEMA))


@checked("read_collection", _TYPED)
def read_collection(spark, sf):
    """Written as CSV and read back."""
    path = scratch_path(spark, "collection")
    T.write_collection(_collection(spark, sf), path, "csv")
    return T.read_collection(spark, path).select(*_FIELDS)


@checked("write_collection", _TYPED)
def write_collection(spark, sf):
    """Written as parquet and read back."""
    path = scratch_path(spark, "collection")
    T.write_collection(_collection(spark, sf), path)
    return spark.read.parquet(path).select(*_FIELDS)


@checked("filter_created_between_stored_by_date", f"""{_COLLECTION}
select repo_full_name, file_path, cast(left(repo_created_at, 10) as date) as created_date from fx_collection
where cast(left(repo_created_at, 10) as date) between date '2025-02-27' and date '2025-03-03'""")
def stored_by_date(spark, sf):
    path = scratch_path(spark, "collection")
    T.write_collection_by_date(_collection(spark, sf), path)
    kept = repos.filter_created_between(spark.read.parquet(path), "2025-02-27", "2025-03-03", "repo_created_at")
    return kept.select("repo_full_name", "file_path", "created_date")


@checked("windows_of_days_stored_by_date", f"""{_COLLECTION}, {WINDOWS}
select window_id, repo_full_name, file_path, cast(left(repo_created_at, 10) as date) as created_date
from fx_collection join windows on cast(left(repo_created_at, 10) as date) between a and b where window_id in (3, 4, 17)""")
def windows_stored_by_date(spark, sf):
    """Windows from a table; only the folders of their days are read."""
    path, calendar = scratch_path(spark, "collection"), scratch_path(spark, "calendar")
    T.write_collection_by_date(_collection(spark, sf), path)
    spark.createDataFrame(P.calendar_windows(), "window_id int, a date, b date, quota int").write.parquet(calendar)
    windows = spark.read.parquet(calendar).where("window_id in (3, 4, 17)")
    placed = P.assign_windows(spark.read.parquet(path), windows, F.col("repo_created_at"))
    return placed.select("window_id", "repo_full_name", "file_path", "created_date")


_RUN_FIELDS = [
    "repo_full_name", "file_path", "exec_ok", "error", "elapsed_s", "original_found", "outputs_equal",
    "outputs_hash_orig", "n_outputs_orig", "n_outputs_exec",
]
_TYPED_RUNS = f"""{_RUNS}
select repo_full_name, file_path, {_BOOL('exec_ok')} as exec_ok, {_TEXT('error')} as error,
  case when elapsed_s <> '' then coalesce(try_cast(elapsed_s as double), 0) end as elapsed_s, {_BOOL('original_found')} as original_found,
  {_BOOL('outputs_equal')} as outputs_equal, {_TEXT('outputs_hash_orig')} as outputs_hash_orig,
  {_NUMBER('n_outputs_orig')} as n_outputs_orig, {_NUMBER('n_outputs_exec')} as n_outputs_exec
from fx_runs"""


@checked("read_runs", _TYPED_RUNS)
def read_runs(spark, sf):
    path = scratch_path(spark, "runs")
    T.write_runs(T.type_columns(X.view(spark, sf, "fx_runs"), RUN_SCHEMA), path, "csv")
    return T.read_runs(spark, path).select(*_RUN_FIELDS)


@checked("write_runs", _TYPED_RUNS)
def write_runs(spark, sf):
    path = scratch_path(spark, "runs")
    T.write_runs(T.type_columns(X.view(spark, sf, "fx_runs"), RUN_SCHEMA), path)
    return spark.read.parquet(path).select(*_RUN_FIELDS)


@checked("read_runs_in_splits", _TYPED_RUNS.replace(f"{_TEXT('error')} as error", "error || chr(10) || '\"' || file_path || '\",' as error"))
def read_runs_in_splits(spark, sf):
    """One file with line breaks and quotes in fields, read by as many tasks as it has splits."""
    path = scratch_path(spark, "runs")
    runs = T.type_columns(X.view(spark, sf, "fx_runs").withColumn("error", F.expr("error || '\\n\"' || file_path || '\",'")), RUN_SCHEMA)
    T.write_runs(runs.coalesce(1), path, "csv")
    return T.read_runs(spark, path, split=True).select(*_RUN_FIELDS)


def _window_folders(spark, sf) -> str:
    """The collection as three CSV folders, standing for three window files."""
    base = scratch_path(spark, "windows")
    rows = X.view(spark, sf, "fx_collection")
    for window in range(3):
        part = filters.project_fields(T.type_columns(rows.where(F.col("row_id") % 3 == window), COLLECTION_SCHEMA))
        T.write_collection(part, f"{base}/window{window}", "csv")
    return base


_WINDOW_ROWS = f"""{_COLLECTION}
select 'window' || cast(row_id % 3 as varchar) as window_name, repo_full_name, file_path, {_NUMBER('n_code')} as n_code,
  {_TEXT('top_imports_json')} as top_imports_json from fx_collection"""


def _window_rows(df):
    name = F.regexp_extract("window_file", "/(window[0-9])/[^/]*$", 1)
    return df.select(name.alias("window_name"), "repo_full_name", "file_path", "n_code", "top_imports_json")


@checked("consolidate_windows", _WINDOW_ROWS)
def consolidate_windows(spark, sf):
    return _window_rows(T.consolidate_windows(spark, f"{_window_folders(spark, sf)}/*"))


@checked("incremental_windows", _WINDOW_ROWS)
def incremental(spark, sf):
    base, target, checkpoint = _window_folders(spark, sf), scratch_path(spark, "stream"), scratch_path(spark, "progress")
    # The second start finds nothing new and must add nothing.
    for _ in range(2):
        incremental_windows(spark, f"{base}/*", target, checkpoint).awaitTermination()
    return _window_rows(spark.read.parquet(target))


@checked("incremental_quota", f"""{_COLLECTION}, {WINDOWS},
notebooks as (
  select window_id, quota, repo_full_name, file_path, max(cast(left(repo_created_at, 10) as date)) as created_date, min(cast(repo_id as bigint)) as repo_id
  from fx_collection join windows on cast(left(repo_created_at, 10) as date) between a and b group by all),
ranked as (
  select *, row_number() over (partition by window_id order by created_date desc, repo_id, repo_full_name, file_path)::integer as quota_rank from notebooks)
select window_id, quota_rank, repo_full_name, file_path, created_date from ranked where quota_rank <= quota""")
def quota_across_runs(spark, sf):
    """Three window files that arrive in two runs, and a third run without a new one."""
    base, target, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "quota"), scratch_path(spark, "progress")
    rows = X.view(spark, sf, "fx_collection")
    for run in ([0, 1], [2], []):
        for window in run:
            part = filters.project_fields(T.type_columns(rows.where(F.col("row_id") % 3 == window), COLLECTION_SCHEMA))
            T.write_collection(part, f"{base}/window{window}", "csv")
        incremental_quota(spark, f"{base}/*", target, checkpoint).awaitTermination()
    return spark.read.parquet(target).select("window_id", "quota_rank", "repo_full_name", "file_path", F.to_date("repo_created_at").alias("created_date"))


@checked("validate_date_bounds", """
select l_orderkey, l_linenumber, coalesce(cast(l_shipdate as date) <= cast(l_shipdate as date) + cast(l_quantity - 25 as integer), false) as valid from lineitem""")
def validate_date_bounds(spark, sf):
    """Ranges that begin on the day of shipping; half of them end before that."""
    ranges = X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("a"), F.date_add(F.to_date("l_shipdate"), (F.col("l_quantity") - 25).cast("int")).alias("b")
    )
    return repos.with_checked_bounds(ranges).select("l_orderkey", "l_linenumber", "valid")


# ---- repository trees ----

checked("list_notebook_paths", f"{_TREE} select repo_full_name, path from fx_tree where type = 'blob' and lower(path) like '%.ipynb'")(
    lambda spark, sf: repos.list_notebook_paths(X.view(spark, sf, "fx_tree")).select("repo_full_name", "path")
)
_DEPENDENCIES = """
select repo_full_name, bool_or(lower(path) like '%requirements.txt') as deps_requirements_txt,
  bool_or(lower(path) like '%setup.py') as deps_setup_py, bool_or(lower(path) like '%pipfile') as deps_pipfile
from fx_tree group by repo_full_name"""
checked("repo_dependencies", f"{_TREE} {_DEPENDENCIES}")(lambda spark, sf: repos.repo_dependencies(X.view(spark, sf, "fx_tree")))


@checked("attach_dependencies", f"""{_COLLECTION}, {X.duck_views('fx_tree')}, deps as ({_DEPENDENCIES})
select row_id, coalesce(deps_requirements_txt, false) as deps_requirements_txt, coalesce(deps_setup_py, false) as deps_setup_py,
  coalesce(deps_pipfile, false) as deps_pipfile,
  coalesce(deps_requirements_txt or deps_setup_py or deps_pipfile, false) as deps_any
from fx_collection left join deps using (repo_full_name)""")
def attach_dependencies(spark, sf):
    rows = X.view(spark, sf, "fx_collection").select("row_id", "repo_full_name")
    deps = repos.repo_dependencies(X.view(spark, sf, "fx_tree"))
    return repos.attach_dependencies(rows, deps, ["row_id"]).drop("repo_full_name")
