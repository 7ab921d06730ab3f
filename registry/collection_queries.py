"""Collection rows: conversions, filters, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from nbquarry.functions import coerce, names
from nbquarry.operators import filters, runs as R, shred, summary as S
from nbquarry.schema import COLLECTION_FIELDS
from registry import fixtures as X
from registry.book import checked

_FX = f"with {X.duck_views('fx_collection')}"
_SRC = "from fx_collection"


def _collection(spark, sf):
    return X.view(spark, sf, "fx_collection")


def duck_profile(source: str, metrics: dict[str, str]) -> str:
    """CTE ``profile``: exact median and mean of each metric expression, by ranking its values."""
    stacked = " union all ".join(
        f"select '{name}' as metric, cast({value} as double) as value from {source}" for name, value in metrics.items()
    )
    return f"""
stacked as ({stacked}),
placed as (
  select metric, value, row_number() over (partition by metric order by value) as place,
    count(*) over (partition by metric) as n from stacked where value is not null),
profile as (
  select metric, max(n) as n,
    round(avg(value) filter (place in ((n + 1) // 2, n // 2 + 1)), 6) as median, round(avg(value), 6) as mean
  from placed group by metric)"""


def rounded(profile):
    return profile.select("metric", "n", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"))


_INT = lambda c: f"coalesce(try_cast(trunc(try_cast({c} as double)) as bigint), 0)"
_BOOL = lambda c: f"lower({c}) in ('true', '1', 'yes', 'y', 't')"

# ---- scalar conversions and names ----

checked("to_int", f"{_FX} select row_id, {_INT('n_code')} as n_code, {_INT('n_markdown')} as n_markdown {_SRC}")(
    lambda spark, sf: _collection(spark, sf).select(
        "row_id", coerce.to_int(F.col("n_code")).alias("n_code"), coerce.to_int(F.col("n_markdown")).alias("n_markdown"))
)
checked("to_float", f"{_FX} select row_id, coalesce(try_cast(percent_code_executed as double), 0) as p, coalesce(try_cast(n_code as double), 0) as c {_SRC}")(
    lambda spark, sf: _collection(spark, sf).select(
        "row_id", coerce.to_float(F.col("percent_code_executed")).alias("p"), coerce.to_float(F.col("n_code")).alias("c"))
)
checked("to_bool", f"{_FX} select row_id, {_BOOL('deps_any')} as deps_any, {_BOOL('nb_ok_parse')} as parsed {_SRC}")(
    lambda spark, sf: _collection(spark, sf).select(
        "row_id", coerce.to_bool(F.col("deps_any")).alias("deps_any"), coerce.to_bool(F.col("nb_ok_parse")).alias("parsed"))
)
checked("pct", f"{_FX} select row_id, case when row_id % 7 = 0 then 0 else 100.0::double * (row_id % 5) / (row_id % 7) end as pct {_SRC}")(
    lambda spark, sf: _collection(spark, sf).select(
        "row_id", coerce.pct(F.col("row_id") % 5, F.col("row_id") % 7).alias("pct"))
)
checked("sanitize_name", f"with {X.duck_views('fx_tree')} select path, regexp_replace(split_part(path, '/', -1), '[^A-Za-z0-9_.-]', '_', 'g') as name from fx_tree")(
    lambda spark, sf: X.view(spark, sf, "fx_tree").select("path", names.sanitize_file_name(F.col("path")).alias("name"))
)
checked("split_full_name", f"{_FX} select row_id, split_part(repo_full_name, '/', 1) as owner, split_part(repo_full_name, '/', 2) as repo {_SRC}")(
    lambda spark, sf: _collection(spark, sf).select(
        "row_id", names.owner_of(F.col("repo_full_name")).alias("owner"), names.repo_of(F.col("repo_full_name")).alias("repo"))
)
checked("short_sha", f"{_FX} select row_id, case when file_sha = '' then 'noSHA' else left(file_sha, 8) end as sha8 {_SRC}")(
    lambda spark, sf: _collection(spark, sf).select("row_id", names.short_sha(F.col("file_sha")).alias("sha8"))
)
checked("default_branch", f"{_FX} select row_id, case when repo_default_branch = '' then 'main' else repo_default_branch end as branch {_SRC}")(
    lambda spark, sf: _collection(spark, sf).select("row_id", names.default_branch(F.col("repo_default_branch")).alias("branch"))
)
checked("notebook_label", f"{_FX} select row_id, repo_full_name || '/' || file_path as label {_SRC}")(
    lambda spark, sf: _collection(spark, sf).select("row_id", names.notebook_label(F.col("repo_full_name"), F.col("file_path")).alias("label"))
)
_KERNEL = "case trim(kernel_name) when 'python3' then 'python3' when 'ir' then 'ir' else 'python3' end"
checked("resolve_kernel", f"{_FX} select row_id, {_KERNEL} as kernel_name {_SRC}")(
    lambda spark, sf: R.resolve_kernel(_collection(spark, sf), ["python3", "ir"]).select("row_id", "kernel_name")
)


@checked("resolve_kernel_table", f"""{_FX},
known as (select distinct case when p_partkey % 2 = 0 then 'ir' else 'kernel' || cast(p_partkey as varchar) end as name from part)
select row_id, case when trim(kernel_name) in (select name from known) then trim(kernel_name) else 'python3' end as kernel_name {_SRC}""")
def resolve_kernel_table(spark, sf):
    key = F.col("p_partkey")
    known = X.table(spark, sf, "part").select(
        F.when(key % 2 == 0, F.lit("ir")).otherwise(F.concat(F.lit("kernel"), key.cast("string"))).alias("name")
    )
    return R.resolve_kernel(_collection(spark, sf), known, ["row_id"]).select("row_id", "kernel_name")


# ---- filters ----

checked("filter_parsed_strict", f"{_FX} select row_id {_SRC} where nb_ok_parse = 'True'")(
    lambda spark, sf: filters.filter_parsed_strict(_collection(spark, sf)).select("row_id")
)
checked("filter_comparable", f"{_FX} select row_id {_SRC} where nb_ok_parse = 'True' and lower(language) like 'python%'")(
    lambda spark, sf: filters.filter_comparable(_collection(spark, sf)).select("row_id")
)
checked("filter_language_prefix", f"{_FX} select row_id, language {_SRC} where lower(language) like 'python%'")(
    lambda spark, sf: filters.filter_language_prefix(_collection(spark, sf)).select("row_id", "language")
)


@checked("project_fields", f"""{_FX} select repo_full_name, file_path, try_cast(repo_id as bigint) as repo_id,
  cast(repo_created_at[:10] || ' 12:00:00' as timestamp) as repo_created_at, {_BOOL('out_of_order')} as out_of_order,
  45 as n_columns, null::bigint as n_raw {_SRC}""")
def project_fields(spark, sf):
    typed = _collection(spark, sf).select("repo_full_name", "file_path", "repo_id", "repo_created_at", "out_of_order")
    projected = filters.project_fields(typed)
    assert projected.columns == COLLECTION_FIELDS
    return projected.select(
        "repo_full_name", "file_path", "repo_id", "repo_created_at", "out_of_order",
        F.lit(len(projected.columns)).alias("n_columns"), "n_raw",
    )


# ---- statistics ----

checked("collection_size", f"{_FX} select count(*) as n {_SRC}")(lambda spark, sf: S.collection_size(_collection(spark, sf)))

_RATE = lambda name, condition: (
    f"select '{name}' as metric, count(*) filter ({condition}) as n,"
    f" 100.0::double * count(*) filter ({condition}) / count(*) as pct {_SRC}"
)
FLAG_RATES = " union all ".join([
    _RATE("nb_ok_parse", _BOOL("nb_ok_parse")), _RATE("language_python", "lower(language) like 'python%'"),
    _RATE("deps_any", _BOOL("deps_any")), _RATE("has_unambiguous_order", _BOOL("has_unambiguous_order")),
])
checked("flag_rates", f"{_FX} {FLAG_RATES}")(lambda spark, sf: S.flag_rates(_collection(spark, sf)))

PROFILE = duck_profile("fx_collection", {
    "n_code": f"case when n_code <> '' then {_INT('n_code')} end",
    "n_markdown": f"case when n_markdown <> '' then {_INT('n_markdown')} end",
    "percent_code_executed": "case when percent_code_executed <> '' then coalesce(try_cast(percent_code_executed as double), 0) end",
})
checked("numeric_profile", f"{_FX}, {PROFILE} select * from profile")(
    lambda spark, sf: rounded(S.numeric_profile(_collection(spark, sf)))
)

# The pairs each import list holds, from the formulas behind the lists.
PAIRS = """
kinds as (
  select row_id, case when row_id % 13 = 0 then 'blank' when row_id % 11 = 0 then 'broken' when row_id % 7 = 0 then 'text'
    when row_id % 5 = 0 then 'object' else 'good' end as kind from fx_collection),
pairs as (
  select row_id, 0 as pos, 'pandas' as module, 2 as n from kinds where kind = 'broken'
  union all select row_id, 0, 'numpy', row_id % 4 + 1 from kinds where kind = 'good'
  union all select row_id, 1, 'mod' || cast(row_id % 30 as varchar), 1 from kinds where kind = 'good')
"""
checked("explode_import_counts", f"{_FX}, {PAIRS} select row_id, pos, module, cast(n as bigint) as n from pairs")(
    lambda spark, sf: shred.explode_import_counts(_collection(spark, sf))
)
TOP_IMPORTS = "select module, cast(sum(n) as bigint) as n from pairs group by module order by n desc, min(row_id * 10 + pos) limit 10"
checked("top_imports_overall", f"{_FX}, {PAIRS} {TOP_IMPORTS}")(
    lambda spark, sf: S.top_imports_overall(shred.explode_import_counts(_collection(spark, sf)))
)
