"""Run rows, run logs and originals: outcomes, matching, statistics, the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from nbquarry.functions import names
from nbquarry.operators import divergence as DV, matching, outputs as O, repos, runs as R, summary as S
from nbquarry.plans.report import corpus_report, keep_window_facts, report_over_windows
from nbquarry.plans.run_table import run_table as build_run_table
from nbquarry.sources import bucketed
from nbquarry.sources.archive import with_document
from registry import collection_queries as CQ, fixtures as X
from registry.book import checked
from registry.scratch import scratch_path

_FX = f"with {X.duck_views('fx_runs')}"
_SRC = "from fx_runs"
_FAILED = "exec_ok = 'False'"


def _runs(spark, sf):
    return X.view(spark, sf, "fx_runs")


# ---- statistics ----

SUCCESS = f"select count(*) as n_runs, count(*) filter (exec_ok = 'True') as n_ok, 100.0::double * count(*) filter (exec_ok = 'True') / count(*) as pct {_SRC}"
checked("run_success_rate", f"{_FX} {SUCCESS}")(lambda spark, sf: S.run_success_rate(_runs(spark, sf)))


def _top(key: str, name: str, limit: int) -> str:
    return f"select {key} as {name}, count(*) as n {_SRC} where {_FAILED} group by 1 order by n desc, min(row_id) limit {limit}"


TOP_ERRORS = _top("case when error = '' then 'None' else error end", "error", 12)
BY_REPO = _top("repo_full_name", "repo_full_name", 10)
BY_NOTEBOOK = _top("repo_full_name || '/' || file_path", "notebook", 10)
checked("top_errors", f"{_FX} {TOP_ERRORS}")(lambda spark, sf: S.top_errors(_runs(spark, sf)))
checked("failures_by_repo", f"{_FX} {BY_REPO}")(lambda spark, sf: S.failures_by_repo(_runs(spark, sf)))
checked("failures_by_notebook", f"{_FX} {BY_NOTEBOOK}")(lambda spark, sf: S.failures_by_notebook(_runs(spark, sf)))

_SECONDS = "case when elapsed_s <> '' then cast(elapsed_s as double) end"
ELAPSED = CQ.duck_profile("fx_runs", {
    "elapsed_all": _SECONDS,
    "elapsed_ok": f"case when exec_ok = 'True' then {_SECONDS} end",
    "elapsed_failed": f"case when {_FAILED} then {_SECONDS} end",
})
checked("elapsed_profile", f"{_FX}, {ELAPSED} select * from profile")(
    lambda spark, sf: CQ.rounded(S.elapsed_profile(_runs(spark, sf)))
)
OUTPUT_COUNTS = CQ.duck_profile("fx_runs", {
    n: f"case when {n} <> '' then cast({n} as bigint) end" for n in ["n_outputs_orig", "n_outputs_exec"]
})
checked("output_count_profile", f"{_FX}, {OUTPUT_COUNTS} select * from profile")(
    lambda spark, sf: CQ.rounded(S.output_count_profile(_runs(spark, sf)))
)

FOUND = f"select count(*) filter (original_found = 'True') as n, 100.0::double * count(*) filter (original_found = 'True') / count(*) as pct {_SRC}"
checked("originals_found_rate", f"{_FX} {FOUND}")(lambda spark, sf: S.originals_found_rate(_runs(spark, sf)))


def _share(metric: str, part: str, whole: str, more: str = "") -> str:
    return (
        f"select '{metric}' as metric, count(*) filter ({part}) as n,{more}"
        f" case when count(*) filter ({whole}) = 0 then 0 else 100.0::double * count(*) filter ({part}) / count(*) filter ({whole}) end as pct {_SRC}"
    )


EQUAL = " union all ".join([
    _share("equal_all", "outputs_equal = 'True'", "true"),
    _share("equal_ok", "outputs_equal = 'True' and exec_ok = 'True'", "exec_ok = 'True'"),
])
checked("outputs_equal_rate", f"{_FX} {EQUAL}")(lambda spark, sf: S.outputs_equal_rate(_runs(spark, sf)))
_KPI = lambda metric, whole: _share(metric, f"{whole} and outputs_equal = 'True'", whole, f" count(*) filter ({whole}) as of_,")
KPIS = " union all ".join([
    _KPI("reproduced", "original_found = 'True'"), _KPI("reproduced_ok", "original_found = 'True' and exec_ok = 'True'"),
])
checked("reproducibility_kpis", f"{_FX} select * from ({KPIS}) k where of_ > 0")(
    lambda spark, sf: S.reproducibility_kpis(_runs(spark, sf)).withColumnRenamed("of", "of_")
)
DIVERGENCE = f"""select row_id, repo_full_name || '/' || file_path as notebook, left(outputs_hash_orig, 8) as hash_orig,
  left(outputs_hash_exec, 8) as hash_exec, coalesce(try_cast(n_outputs_orig as bigint), 0) as n_orig,
  coalesce(try_cast(n_outputs_exec as bigint), 0) as n_exec
{_SRC} where outputs_hash_orig <> '' and outputs_hash_exec <> '' and outputs_hash_orig <> outputs_hash_exec
order by row_id limit 10"""
checked("divergence_examples", f"{_FX} {DIVERGENCE}")(lambda spark, sf: S.divergence_examples(_runs(spark, sf)))

_LONG = lambda section, metric, dim, n, value, source: (
    f"select '{section}' as section, {metric} as metric, {dim} as dim, cast({n} as bigint) as n,"
    f" round(cast({value} as double), 6) as value from ({source}) x"
)


def _profile_rows(section: str, profile: str) -> str:
    # each profile brings its own CTEs, so it is wrapped as a subquery
    source = f"with {profile} select metric, n, 'median' as dim, median as value from profile union all select metric, n, 'mean', mean from profile"
    return _LONG(section, "metric", "dim", "n", "value", source)


_COLLECTION_REPORT = [
    _LONG("collection", "'rows'", "null", "n", "null", "select count(*) as n from fx_collection"),
    _LONG("collection", "metric", "null", "n", "pct", CQ.FLAG_RATES),
    _profile_rows("collection", CQ.PROFILE),
    _LONG("collection", "'top_imports'", "module", "n", "null", CQ.TOP_IMPORTS),
]
_RUN_REPORT = [
    _LONG("runs", "'success'", "cast(n_runs as varchar)", "n_ok", "pct", SUCCESS),
    _LONG("runs", "'top_errors'", "error", "n", "null", TOP_ERRORS),
    _profile_rows("runs", ELAPSED),
    _LONG("runs", "'failures_by_repo'", "repo_full_name", "n", "null", BY_REPO),
    _LONG("runs", "'failures_by_notebook'", "notebook", "n", "null", BY_NOTEBOOK),
]
_OUTPUT_REPORT = [
    _LONG("outputs", "'originals_found'", "null", "n", "pct", FOUND),
    _LONG("outputs", "metric", "null", "n", "pct", EQUAL),
    _LONG("outputs", "'divergence'", "notebook || ' ' || hash_orig || ' ' || hash_exec", "n_orig", "n_exec", DIVERGENCE),
    _profile_rows("outputs", OUTPUT_COUNTS),
    _LONG("outputs", "metric", "cast(of_ as varchar)", "n", "pct", f"select * from ({KPIS}) k where of_ > 0"),
]
_REPORT = f"with {X.duck_views('fx_collection', 'fx_runs')}, {CQ.PAIRS} "


def _report(spark, sf, runs):
    long = corpus_report(X.view(spark, sf, "fx_collection"), runs, work=scratch_path(spark, "report"))
    return long.withColumn("value", F.round("value", 6))


@checked("corpus_report", _REPORT + " union all ".join([*_COLLECTION_REPORT, *_RUN_REPORT, *_OUTPUT_REPORT]))
def report(spark, sf):
    return _report(spark, sf, _runs(spark, sf))


@checked("require_columns", _REPORT + " union all ".join([*_COLLECTION_REPORT, *_RUN_REPORT]))
def require_columns(spark, sf):
    """The guard of the output block: one of its six columns is missing, so the report has no such block."""
    return _report(spark, sf, _runs(spark, sf).drop("outputs_hash_exec"))


@checked("report_over_windows", _REPORT + " union all ".join(_COLLECTION_REPORT))
def windows_report(spark, sf):
    """Three window files, taken in two runs; one of them is given twice."""
    store = scratch_path(spark, "facts")
    rows = X.view(spark, sf, "fx_collection").withColumn("window_file", F.concat(F.lit("window"), (F.col("row_id") % 3).cast("string")))
    for run in (["window0", "window1"], ["window1", "window2"]):
        keep_window_facts(rows.where(F.col("window_file").isin(run)), store, "row_id")
    return report_over_windows(spark, store).withColumn("value", F.round("value", 6))


# ---- error classes, comparison, work list ----

@checked("classify_errors", f"""{_FX} select row_id,
  case when exc_msg like 'No module named ''%' then split_part(exc_msg, '''', 2) end as missing_module,
  exc_msg like '%401%' or error like '%AuthenticationError%' as auth_error, error like '%FileNotFoundError%' as file_missing
{_SRC}""")
def classify_errors(spark, sf):
    return R.classify_errors(_runs(spark, sf)).select("row_id", "missing_module", "auth_error", "file_missing")


@checked("outputs_equal", f"""{_FX} select row_id,
  case when original_found = 'True' and outputs_hash_orig <> '' then outputs_hash_orig = outputs_hash_exec end as outputs_equal
{_SRC}""")
def outputs_equal(spark, sf):
    runs = _runs(spark, sf).withColumn("original_found", F.col("original_found") == "True")
    return O.compare_outputs(runs).select("row_id", "outputs_equal")


@checked("one_env_per_repo", f"""{_FX}
select repo_full_name, arg_min(case when row_id % 6 = 0 then 'main' else 'dev' end, row_id) as repo_default_branch, min(row_id) as first_row
{_SRC} group by repo_full_name""")
def one_env_per_repo(spark, sf):
    branch = F.when(F.col("row_id") % 6 == 0, F.lit("")).otherwise(F.lit("dev"))
    return repos.one_env_per_repo(_runs(spark, sf).withColumn("repo_default_branch", branch))


@checked("match_originals", f"""with {X.duck_views('fx_runs', 'fx_originals')},
listed as (select owner, repo, archive_name, min(outputs_hash_orig) as h from fx_originals group by all),
matched as (
  select row_id, min(archive_name) as archive_name
  from fx_runs join fx_originals on owner || '/' || repo = repo_full_name
    and ends_with(archive_name, '_' || split_part(file_path, '/', 2))
  group by row_id)
select r.row_id, archive_name from fx_runs r left join matched m using (row_id)""")
def match_originals(spark, sf):
    runs = _runs(spark, sf).select("row_id", "repo_full_name", "file_path")
    return matching.match_originals(runs, X.view(spark, sf, "fx_originals"), [], ["row_id"]).select("row_id", "archive_name")


_TRAITS = f"""with {X.duck_views('fx_runs', 'fx_collection')}
select r.error, c.deps_any, c.out_of_order, c.has_abs_data_path, count(*) as n
from fx_runs r left join fx_collection c using (repo_full_name, file_path) group by all"""


@checked("runs_with_collection", f"""with {X.duck_views('fx_runs', 'fx_collection')}
select r.row_id, r.error, r.exec_ok, c.row_id as listing, c.deps_any, c.out_of_order, c.has_abs_data_path
from fx_runs r left join fx_collection c using (repo_full_name, file_path)""")
def runs_with_collection(spark, sf):
    listings = X.view(spark, sf, "fx_collection").withColumnRenamed("row_id", "listing")
    joined = matching.runs_with_collection(_runs(spark, sf), listings, ["listing", *matching.TRAITS], ["row_id"])
    return joined.select("row_id", "error", "exec_ok", "listing", *matching.TRAITS)


@checked("runs_with_notebooks_bucketed", f"""with {X.duck_views('fx_runs', 'fx_collection')},
notebooks as (select repo_full_name, file_path, min(row_id) as first_listing, count(*) as listings from fx_collection group by all)
select row_id, error, first_listing, listings from fx_runs left join notebooks using (repo_full_name, file_path)""")
def runs_bucketed(spark, sf):
    """Both tables stored by notebook, with the busiest notebooks kept apart."""
    listed = X.view(spark, sf, "fx_collection").groupBy("repo_full_name", "file_path").agg(F.min("row_id").alias("first_listing"), F.count(F.lit(1)).alias("listings"))
    path = scratch_path(spark, "bucketed")
    name = f"nbquarry_{path.rsplit('-', 1)[-1]}"
    bucketed.write_bucketed(_runs(spark, sf).select("row_id", "repo_full_name", "file_path", "error"), f"{name}_runs", f"{path}/runs", 8, part_rows=8)
    bucketed.write_bucketed(listed, f"{name}_notebooks", f"{path}/notebooks", 8, part_rows=None)
    return bucketed.join_bucketed(spark, f"{name}_runs", f"{name}_notebooks", ["row_id"]).select("row_id", "error", "first_listing", "listings")


@checked("error_cube", f"""with {X.duck_views('fx_runs', 'fx_collection')},
cells as (
  select r.error, c.deps_any, c.out_of_order, c.has_abs_data_path, count(*) as n,
    grouping_id(r.error, c.deps_any, c.out_of_order, c.has_abs_data_path)::integer as level
  from fx_runs r left join fx_collection c using (repo_full_name, file_path)
  group by cube(r.error, c.deps_any, c.out_of_order, c.has_abs_data_path))
select t.*, 100.0::double * t.n / w.n as pct from cells t join cells w
  on w.level = 8 + t.level % 8 and w.deps_any is not distinct from t.deps_any and w.out_of_order is not distinct from t.out_of_order
    and w.has_abs_data_path is not distinct from t.has_abs_data_path""")
def error_cube(spark, sf):
    return matching.error_cube(_runs(spark, sf), X.view(spark, sf, "fx_collection"))


@checked("errors_by_notebook_traits", _TRAITS)
def errors_by_notebook_traits(spark, sf):
    return matching.errors_by_notebook_traits(_runs(spark, sf), X.view(spark, sf, "fx_collection"))


# ---- run logs ----

_LOGS = f"with {X.duck_views('fx_logs')}"
# What the logs say, from the formulas behind them.
_OUTCOMES = f"""
said as (
  select log_id, repo_full_name, file_path, returncode, timed_out, launch_error, stdout, stderr, elapsed_s,
    timed_out or launch_error is not null as cut_off,
    case when log_id % 41 = 0 or log_id % 43 = 0 then 'nothing'
      when contains(stdout, 'ModuleNotFoundError') then 'failed' when contains(stdout, 'auth_error') then 'denied'
      else 'ok' end as kind
  from fx_logs),
outcomes as (
  select *, not cut_off and returncode = 0 and kind = 'ok' as exec_ok,
    case when timed_out then 'TimeoutExpired' when launch_error is not null then launch_error
      when returncode = 0 and kind = 'ok' then null
      when kind = 'failed' then 'ModuleNotFoundError'
      when returncode <> 0 then 'SubprocessError' else 'UnknownError' end as error,
    case when not cut_off and kind = 'ok' then regexp_extract(stdout, '"outputs_hash": "([^"]*)"', 1) else '' end as outputs_hash_exec,
    case when not cut_off and kind = 'ok' then cast(regexp_extract(stdout, '"n_outputs": ([0-9]*)', 1) as bigint) else 0 end as n_outputs_exec
  from said)
"""


def _logs(spark, sf):
    return X.view(spark, sf, "fx_logs")


@checked("parse_run_log", f"""{_LOGS}, {_OUTCOMES}
select log_id, case when log_id % 41 = 0 then null else kind = 'ok' end as ok,
  case kind when 'failed' then 'ModuleNotFoundError' when 'denied' then '' end as error from outcomes""")
def parse_run_log(spark, sf):
    parsed = R.parse_run_log(_logs(spark, sf))
    return parsed.select(
        "log_id", F.try_variant_get("info", "$.ok", "boolean").alias("ok"),
        F.try_variant_get("info", "$.error", "string").alias("error"),
    )


_OUTCOME_FIELDS = ["exec_ok", "error", "outputs_hash_exec", "n_outputs_exec"]


@checked("normalize_outcome", f"""{_LOGS}, {_OUTCOMES}
select log_id, {', '.join(_OUTCOME_FIELDS)}, round(elapsed_s, 3) as elapsed_s,
  case when not exec_ok and not cut_off then right(stderr, 2000) end as stderr_tail,
  case when not exec_ok and not cut_off and kind = 'failed' then regexp_extract(stdout, '"missing_module": "([^"]*)"', 1) end as missing_module,
  case when not exec_ok and not cut_off and kind = 'denied' then true end as auth_error from outcomes""")
def normalize_outcome(spark, sf):
    outcomes = R.normalize_outcome(R.parse_run_log(_logs(spark, sf)))
    return outcomes.select("log_id", *_OUTCOME_FIELDS, "elapsed_s", "stderr_tail", "missing_module", "auth_error")


checked("log_tail", f"{_LOGS} select log_id, right(stderr, 2000) as tail from fx_logs")(
    lambda spark, sf: _logs(spark, sf).select("log_id", names.log_tail(F.col("stderr")).alias("tail"))
)
checked("round_elapsed", f"{_LOGS} select log_id, round(elapsed_s, 3) as elapsed_s from fx_logs")(
    lambda spark, sf: _logs(spark, sf).select("log_id", names.round_elapsed(F.col("elapsed_s")).alias("elapsed_s"))
)

_ORIGINAL_NAME = "left(md5(cast(doc_id as varchar)), 8) || case doc_id % 4 when 0 then '_x_' else '_' end || cast(doc_id % 37 as varchar) || '.ipynb'"


_RUN_TABLE = f"""{_LOGS}, {X.duck_views('fx_collection')}, {_OUTCOMES}, {X.DUCK_DOC_CELLS},
declared as (
  select repo_full_name, file_path, min({{'b': case when repo_default_branch = '' then 'main' else repo_default_branch end,
    'k': kernel_name, 'l': language}}) as d
  from fx_collection where nb_ok_parse = 'True' group by repo_full_name, file_path),
originals as (
  select 'org' || cast(doc_id % 10 as varchar) || '/repo' || cast(doc_id % 100 as varchar) as repo_full_name,
    {_ORIGINAL_NAME} as archive_name, doc_id as nb_id
  from documents),
matched as (
  select log_id, arg_min(nb_id, archive_name) as nb_id
  from fx_logs l join originals o on l.repo_full_name = o.repo_full_name
    and ends_with(archive_name, '_' || split_part(file_path, '/', 2)) group by log_id),
executed as (
  select log_id, f.outputs_hash, f.n_outputs
  from matched m join fingerprints f on f.nb_id = m.nb_id + log_id % 3 where log_id % 3 < 2),
hashed as (
  select o.* exclude (outputs_hash_exec, n_outputs_exec), exec_ok and x.log_id is not null as hashed_here,
    case when exec_ok and x.log_id is not null then x.outputs_hash when o.outputs_hash_exec = '' then '' end as outputs_hash_exec,
    case when exec_ok and x.log_id is not null then x.n_outputs else o.n_outputs_exec end as n_outputs_exec
  from outcomes o left join executed x using (log_id)),
run_rows as (
  select o.repo_full_name, o.file_path, d.b as repo_default_branch, d.l as language,
    case trim(d.k) when 'ir' then 'ir' else 'python3' end as kernel_name, exec_ok, error, outputs_hash_exec, n_outputs_exec,
    f.nb_id is not null as original_found, f.outputs_hash as outputs_hash_orig, f.n_outputs as n_outputs_orig,
    case when f.nb_id is not null and (hashed_here or not exec_ok) then f.outputs_hash = coalesce(outputs_hash_exec, '') end as outputs_equal
  from hashed o join declared using (repo_full_name, file_path) left join matched m using (log_id)
    left join fingerprints f on f.nb_id = m.nb_id)"""


def _matched_texts(spark, sf):
    """``(originals, executed)``: archived notebooks, and those that runs left: the original (one in three), another one, or none."""
    nb = F.col("nb_id")
    broken = F.when(nb % 23 == 5, F.lit("not json")).when(nb % 29 == 3, F.lit("{}"))
    texts = X.document_texts(spark, sf).select("nb_id", F.coalesce(broken, F.col("body")).alias("_text"))
    named = texts.select(
        "nb_id", "_text",
        F.expr("'org' || cast(nb_id % 10 as string)").alias("owner"),
        F.expr("'repo' || cast(nb_id % 100 as string)").alias("repo"),
        F.expr(_ORIGINAL_NAME.replace("doc_id", "nb_id").replace("varchar", "string")).alias("archive_name"),
    )
    ran = _logs(spark, sf).where("log_id % 3 < 2").select(
        "log_id", F.split_part("repo_full_name", F.lit("/"), F.lit(1)).alias("owner"), F.split_part("repo_full_name", F.lit("/"), F.lit(2)).alias("repo"),
        F.split_part("file_path", F.lit("/"), F.lit(2)).alias("file"),
    )
    chosen = ran.join(
        named.select("nb_id", "owner", "repo", "archive_name", F.element_at(F.split("archive_name", "_"), -1).alias("file")), ["owner", "repo", "file"]
    ).groupBy("log_id").agg(F.min_by("nb_id", "archive_name").alias("orig_id"))
    executed = chosen.withColumn("nb_id", F.col("orig_id") + F.col("log_id") % 3).join(texts, "nb_id").drop("nb_id")
    return with_document(named), with_document(executed)


def _run_table(spark, sf):
    originals, executed = _matched_texts(spark, sf)
    collection = X.view(spark, sf, "fx_collection").withColumn("python_version_declared", F.lit(None).cast("string"))
    return build_run_table(collection, _logs(spark, sf), originals.drop("nb_id"), ["python3", "ir"], executed=executed.drop("orig_id"))


@checked("divergence", f"""{_RUN_TABLE},
numbered as (
  select nb_id, cell_idx, canon, row_number() over (partition by nb_id order by cell_idx) as k, count(*) over (partition by nb_id) as n
  from doc_cells where canon is not null),
pairs as (
  select log_id, m.nb_id as o, m.nb_id + log_id % 3 as e from matched m
    join fingerprints f on f.nb_id = m.nb_id join fingerprints x on x.nb_id = m.nb_id + log_id % 3 where log_id % 3 < 2),
steps as (select log_id, o, e, unnest(range(1, 1 + greatest((select max(n) from numbered), 1))) as k from pairs),
compared as (
  select s.*, a.cell_idx as a, b.cell_idx as b, a.canon is distinct from b.canon as differs
  from steps s left join numbered a on a.nb_id = o and a.k = s.k left join numbered b on b.nb_id = e and b.k = s.k)
select log_id, arg_min(coalesce(a, -1), k) as orig_cell_idx, arg_min(coalesce(b, -1), k) as exec_cell_idx,
  (select count(*) from numbered n where n.nb_id = any_value(c.o)) as n_orig, (select count(*) from numbered n where n.nb_id = any_value(c.e)) as n_exec
from compared c where differs group by log_id""")
def divergence(spark, sf):
    """The first output in which a run departs from the original; -1 where one of them has no more."""
    originals, executed = _matched_texts(spark, sf)
    orig = DV.hash_tree(originals, ["nb_id"]).toDF("orig_id", "orig_root", "orig_leaves")
    pairs = DV.hash_tree(executed, ["log_id", "orig_id"]).toDF("log_id", "orig_id", "exec_root", "exec_leaves").join(orig, "orig_id")
    cell = lambda side: F.coalesce(f"{side}_cell_idx", F.lit(-1)).alias(f"{side}_cell_idx")
    return DV.divergence(pairs, ["log_id"]).select("log_id", cell("orig"), cell("exec"), "n_orig", "n_exec")


@checked("run_table", f"{_RUN_TABLE} select * from run_rows")
def run_table(spark, sf):
    return _run_table(spark, sf).select(
        "repo_full_name", "file_path", "repo_default_branch", "language", "kernel_name", "exec_ok", "error",
        "outputs_hash_exec", "n_outputs_exec", "original_found", "outputs_hash_orig", "n_outputs_orig", "outputs_equal",
    )


@checked("run_table_kpis", f"""{_RUN_TABLE},
kpis as (
  select 'reproduced' as metric, count(*) filter (original_found and outputs_equal) as n, count(*) filter (original_found) as of_ from run_rows
  union all
  select 'reproduced_ok', count(*) filter (original_found and exec_ok and outputs_equal), count(*) filter (original_found and exec_ok) from run_rows)
select metric, n, of_, 100.0::double * n / of_ as pct from kpis where of_ > 0""")
def run_table_kpis(spark, sf):
    return S.reproducibility_kpis(_run_table(spark, sf)).withColumnRenamed("of", "of_")


@checked("run_table_outputs_equal", f"""{_RUN_TABLE}
select outputs_equal, exec_ok, count(*) as n from run_rows group by outputs_equal, exec_ok""")
def run_table_outputs_equal(spark, sf):
    return _run_table(spark, sf).groupBy("outputs_equal", "exec_ok").agg(F.count(F.lit(1)).alias("n"))
