"""Operator inputs derived from the driver tables.

The tables hold no notebooks, so these views make some: rows become cells, runs, file lists and collection rows, whole
texts become documents. Formulas are SQL that Spark and DuckDB read alike. Operators do not know about this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# ---- plain SQL views, the same in both engines ----

# conversation = notebook, turn = cell
FX_CELLS = """
select conv_id as nb_id, turn as cell_idx, cell_type,
  case when cell_type = 'code' and (conv_id * 5 + turn) % 4 <> 0
       then (conv_id * 31 + turn * 17) % 23 + 1 end as execution_count,
  case when cell_type = 'markdown' then
         case (conv_id + turn) % 6 when 0 then 'Drafted with ChatGPT: '
           when 1 then 'as an ai language model, ' when 2 then 'precursors: ' else '' end || text
       when cell_type = 'code' then
         case (conv_id * 3 + turn) % 7 when 0 then 'import numpy as np, os.path'
           when 1 then '%matplotlib inline' when 2 then '/data/raw.csv'
           when 3 then 'p = "C:' || chr(92) || 'tmp"' when 4 then 'from .util import f'
           when 5 then '```python' else 'from unittest import mock' end
       else text end as source,
  case when cell_type = 'code' then
         case (conv_id + turn * 2) % 6 when 0 then 'text/plain' when 1 then 'image/png'
           when 2 then 'text/html' when 3 then 'application/vnd.plotly.v1+json'
           when 4 then 'text/latex' end end as output_mime,
  case when cell_type = 'code' and (conv_id + turn) % 9 = 0 then 'error'
       when cell_type = 'code' then 'display_data' end as output_type
from (select conv_id, turn, text,
        case when role = 'assistant' or (role = 'user' and (conv_id + turn) % 3 = 0) then 'code'
             when role = 'user' then 'markdown' else 'raw' end as cell_type
      from conversations) s
"""

# event = run
FX_RUNS = """
select event_id as row_id,
  'org' || cast(user_id % 10 as varchar(20)) || '/repo' || cast(user_id as varchar(20)) as repo_full_name,
  'nb/' || cast(event_id % 37 as varchar(20)) || '.ipynb' as file_path,
  case when event_type in ('error', 'signup') then 'False' else 'True' end as exec_ok,
  case when event_type = 'error' then case event_id % 4 when 0 then 'ModuleNotFoundError'
         when 1 then 'TimeoutExpired' when 2 then 'FileNotFoundError' else '' end
       when event_type = 'signup' then 'KeyError' else '' end as error,
  case when event_type = 'error' and event_id % 4 = 0
         then 'No module named ''mod' || cast(user_id % 5 as varchar(20)) || ''''
       when event_type = 'signup' then 'HTTP 401' else '' end as exc_msg,
  case when event_id % 50 = 0 then '' else cast(value as varchar(40)) end as elapsed_s,
  case when event_id % 3 = 0 then 'False' else 'True' end as original_found,
  case when event_id % 3 = 0 then ''
       when event_type in ('error', 'signup') or event_id % 5 = 0 then 'False' else 'True' end as outputs_equal,
  case when event_id % 3 = 0 then '' else 'h' || cast(user_id as varchar(20)) end as outputs_hash_orig,
  case when event_type in ('error', 'signup') then ''
       when event_id % 5 = 0 then 'x' || cast(user_id as varchar(20))
       else 'h' || cast(user_id as varchar(20)) end as outputs_hash_exec,
  case when event_id % 3 = 0 then '' else cast(user_id % 9 as varchar(20)) end as n_outputs_orig,
  case when event_type in ('error', 'signup') then '0' else cast(user_id % 9 as varchar(20)) end as n_outputs_exec
from events
"""

# part = tree entry
FX_TREE = """
select 'org' || cast(p_partkey % 20 as varchar(20)) || '/repo' || cast(p_partkey % 200 as varchar(20)) as repo_full_name,
  case when p_partkey % 11 = 0 then 'tree' else 'blob' end as type,
  'd' || cast(p_size as varchar(20)) || '/' || case p_partkey % 9
    when 0 then 'dev-Requirements.txt' when 1 then 'setup.py' when 2 then 'Pipfile'
    when 3 then 'a b.IPYNB' when 4 then 'x.ipynb' when 5 then 'Pipfile.lock'
    when 6 then 'README.md' when 7 then 'setup.cfg' else 'y.ipynb' end as path
from part
"""

# order = collection row, all text as in a CSV
FX_COLLECTION = """
select o_orderkey as row_id,
  'org' || cast(o_custkey % 10 as varchar(20)) || '/repo' || cast(o_custkey as varchar(20)) as repo_full_name,
  cast(o_custkey as varchar(20)) as repo_id,
  case when o_orderkey % 6 = 0 then '' else 'dev' end as repo_default_branch,
  cast(date '2024-12-25' + cast(o_orderkey % 290 as integer) as varchar(20)) || 'T12:00:00Z' as repo_created_at,
  cast(o_orderkey % 12 as varchar(20)) as repo_stars,
  'nb/' || cast(o_orderkey % 37 as varchar(20)) || '.ipynb' as file_path,
  case when o_orderkey % 8 = 0 then '' else 'deadbeef' || cast(o_orderkey as varchar(20)) end as file_sha,
  cast(o_orderkey % 9000 as varchar(20)) as file_size,
  case when o_orderkey % 17 = 0 then 'False' when o_orderkey % 19 = 0 then 'true' else 'True' end as nb_ok_parse,
  case o_orderkey % 4 when 0 then 'python3' when 1 then ' ir ' when 2 then '' else 'conda-env' end as kernel_name,
  case o_orderkey % 5 when 0 then 'R' when 1 then 'Python' when 2 then 'ipython' when 3 then '' else 'python' end
    as language,
  case when o_orderkey % 17 = 0 then '' when o_orderkey % 101 = 0 then 'n/a'
       else cast(o_orderkey % 41 as varchar(20)) end as n_code,
  case when o_orderkey % 17 = 0 then '' else cast(o_orderkey % 23 as varchar(20)) || '.0' end as n_markdown,
  case when o_orderkey % 17 = 0 then ''
       else cast(cast(o_orderkey % 801 as double) / 8 as varchar(20)) end as percent_code_executed,
  case when o_orderkey % 3 = 0 then 'True' else 'False' end as has_unambiguous_order,
  case when o_orderkey % 7 < 3 then 'True' else 'False' end as out_of_order,
  case when o_orderkey % 13 = 0 then ''
       when o_orderkey % 11 = 0 then '[["pandas", 2], "zz", ["numpy", 5]]'
       when o_orderkey % 7 = 0 then 'nope'
       when o_orderkey % 5 = 0 then '{}'
       else '[["numpy", ' || cast(o_orderkey % 4 + 1 as varchar(20)) || '], ["mod'
            || cast(o_orderkey % 30 as varchar(20)) || '", 1]]' end as top_imports_json,
  case o_orderkey % 3 when 0 then 'yes' when 1 then 'False' else '' end as deps_any,
  case when o_orderkey % 29 = 0 then 'True' else 'False' end as has_abs_data_path
from orders
"""

# event = captured output of a run
FX_LOGS = """
select event_id as log_id,
  'org' || cast(user_id % 10 as varchar(20)) || '/repo' || cast(user_id as varchar(20)) as repo_full_name,
  'nb/' || cast(event_id % 37 as varchar(20)) || '.ipynb' as file_path,
  case when event_type in ('error', 'signup') or event_id % 31 = 0 then 1 else 0 end as returncode,
  event_id % 97 = 0 as timed_out,
  case when event_id % 89 = 0 and event_id % 97 <> 0 then 'OSError' end as launch_error,
  'start' || chr(10) || case
    when event_id % 41 = 0 then 'NBEXEC_RESULT:{broken' || chr(10) || 'NBEXEC_RESULT:{"ok": true}'
    when event_id % 43 = 0 then 'no NBEXEC_RESULT:{"ok": true}'
    when event_type = 'error' then 'NBEXEC_RESULT: {"ok": false, "error": "ModuleNotFoundError", "missing_module": "mod'
      || cast(user_id % 5 as varchar(20)) || '"}'
    when event_type = 'signup' then 'NBEXEC_RESULT:{"ok": false, "error": "", "auth_error": true}'
    else 'NBEXEC_RESULT:{"ok": true, "outputs_hash": "h' || cast(user_id as varchar(20)) || '", "n_outputs": '
      || cast(user_id % 9 as varchar(20)) || '}' end || chr(10) || 'NBEXEC_RESULT:{"ok": false}' as stdout,
  'stderr ' || repeat('x', case when event_id % 50 = 0 then 2500 else 3 end) as stderr,
  cast(event_id % 100000 as double) / 16 as elapsed_s
from events
"""

# part = archived original, light form
FX_ORIGINALS = """
select 'org' || cast(p_partkey % 10 as varchar(20)) as owner, 'repo' || cast(p_partkey % 100 as varchar(20)) as repo,
  'ab' || cast(p_partkey % 97 as varchar(20)) || case p_partkey % 5 when 0 then '_x_' when 1 then '_y_z_' else '_' end
    || cast(p_partkey % 37 as varchar(20)) || '.ipynb' as archive_name,
  'h' || cast(p_partkey % 50 as varchar(20)) as outputs_hash_orig
from part
"""

VIEWS = {
    "fx_cells": FX_CELLS, "fx_runs": FX_RUNS, "fx_tree": FX_TREE, "fx_collection": FX_COLLECTION, "fx_logs": FX_LOGS,
    "fx_originals": FX_ORIGINALS,
}
_BASE = {
    "fx_cells": "conversations", "fx_runs": "events", "fx_tree": "part", "fx_collection": "orders", "fx_logs": "events",
    "fx_originals": "part",
}

# ---- document = notebook, line = cell ----
# Formulas over {nb} (document id), {i} (line number from 0) and {line}; they must read alike in both engines.

NL = "chr(10)"
CELL_TYPE = "case when ({nb} * 7 + {i} * 3) % 10 < 6 then 'code' when ({nb} * 7 + {i} * 3) % 10 < 9 then 'markdown' else 'raw' end"
SOURCE = (
    "case when ({nb} * 7 + {i} * 3) % 10 < 6 then case ({nb} * 3 + {i}) % 12"
    " when 0 then 'import numpy as np, os.path'"
    f" when 1 then '%matplotlib inline' || {NL} || 'import sys'"
    " when 2 then '/data/raw.csv'"
    " when 3 then 'p = \"C:' || chr(92) || 'tmp\"'"
    " when 4 then 'from .util import f'"
    " when 5 then '```python'"
    " when 6 then 'from unittest import mock'"
    f" when 7 then 'def f(x):' || {NL} || '    return x'"
    f" when 8 then 'class A:' || {NL} || '    import pandas'"
    f" when 9 then 'for i in range(3):' || {NL} || '    import my_test.x'"
    f" when 10 then 'async def g():' || {NL} || '    pass'"
    " else '# ' || {line} end"
    " when ({nb} * 7 + {i} * 3) % 10 < 9 then case ({nb} + {i}) % 6 when 0 then 'Drafted with ChatGPT: '"
    " when 1 then 'as an ai language model, ' when 2 then 'precursors: ' else '' end || {line}"
    " else {line} end"
)
IS_CODE = "({nb} * 7 + {i} * 3) % 10 < 6"
STAR = "({nb} + {i}) % 40 = 7"
COUNT = "case when ({nb} * 5 + {i}) % 4 <> 0 and not (({nb} + {i}) % 40 = 7) then ({nb} * 31 + {i} * 17) % 97 + 1 end"
OUTPUT = "({nb} + {i} * 2) % 8"
LANGUAGE = "case {nb} % 7 when 0 then 'R' when 1 then 'IPython' else 'python' end"
UNDECODED = "({nb} % 23 = 5 or {nb} % 29 = 3)"
REPO = "'org' || cast({nb} % 20 as varchar(20)) || '/repo' || cast({nb} % 200 as varchar(20))"

_SPARK_NAMES = {"nb": "doc_id", "i": "i", "line": "line"}


def _spark(formula: str) -> str:
    return formula.format(**_SPARK_NAMES)


# JSON text of one document; every third cell stores its source as a list, some counts are the text "*".
def _output(kind: str, data: str = "null", name: str = "null", text: str = "null", ename: str = "null") -> str:
    traceback = "array('a', line)" if ename != "null" else "null"
    return (
        f"array(named_struct('output_type', '{kind}', 'data', cast({data} as map<string,string>), 'name', cast({name} as string),"
        f" 'text', cast({text} as string), 'ename', cast({ename} as string), 'evalue', cast({text} as string),"
        f" 'traceback', cast({traceback} as array<string>), 'metadata', line))"
    )


_OUTPUT_LIST = f"""
case {_spark(OUTPUT)}
  when 0 then {_output('display_data', "map('text/plain', line)")}
  when 1 then {_output('display_data', "map('text/plain', 'fig', 'image/png', md5(line))")}
  when 2 then {_output('execute_result', "map('text/html', concat('<b>', line, '</b>'))")}
  when 3 then {_output('display_data', "map('application/vnd.plotly.v1+json', '{}')")}
  when 4 then {_output('display_data', "map('text/latex', '$x$')")}
  when 5 then {_output('error', ename="'ValueError'")}
  when 6 then {_output('stream', name="'stdout'", text='line')}
  else array() end
"""
_CELL = f"""
named_struct(
  'cell_type', {_spark(CELL_TYPE)},
  'source', element_at(transform(array({_spark(SOURCE)}), s ->
    case when i % 3 = 0 then to_variant_object(array(left(s, 5), substr(s, 6))) else cast(s as variant) end), 1),
  'execution_count', case when not ({_spark(IS_CODE)}) then null when {_spark(STAR)} then cast('*' as variant)
    else cast({_spark(COUNT)} as variant) end,
  'outputs', case when {_spark(IS_CODE)} then {_OUTPUT_LIST} end)
"""
_DOCUMENT = f"""
to_json(named_struct(
  'nbformat', 4,
  'cells', transform(split(text, '\\n'), (line, i) -> {_CELL}),
  'metadata', named_struct('kernelspec', named_struct('name', 'python3'),
    'language_info', named_struct('name', {LANGUAGE.format(nb='doc_id')}, 'version', concat('3.', doc_id % 4 + 8)))))
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for work that is heavy per row, even if the input is one small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the plain SQL views, over the tables of ``sf_dir``."""
    source = _BASE[name]
    return spark.sql(VIEWS[name].replace(f"from {source}", f"from parquet.`{sf_dir}/{source}.parquet`"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_cells`` as a cell table."""
    none = F.array().cast("array<string>")
    kind, mime = F.col("output_type"), F.col("output_mime")
    has_output = mime.isNotNull() | (kind == "error")
    return view(spark, sf_dir, "fx_cells").select(
        "nb_id", "cell_idx", "cell_type", "source", "execution_count",
        F.col("execution_count").isNotNull().alias("execution_count_set"),
        F.when(has_output, F.lit(1)).otherwise(F.lit(0)).alias("n_outputs"),
        F.when(has_output, F.array(kind)).otherwise(none).alias("output_types"),
        F.when(mime.isNotNull(), F.array(mime)).otherwise(none).alias("mime_types"),
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(nb_id, body)``: each document's text as notebook JSON, one cell per line."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("nb_id"), F.expr(_DOCUMENT).alias("body"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched files: most in line as base64, some to be taken from the download body, some unreadable."""
    nb = F.col("nb_id")
    broken = F.when(nb % 23 == 5, F.lit("not json")).when(nb % 29 == 3, F.lit("{}"))
    body = F.coalesce(broken, F.col("body"))
    separate = nb % 10 == 4
    return document_texts(spark, sf_dir).select(
        "nb_id",
        F.expr(REPO.format(nb="nb_id")).alias("repo_full_name"),
        F.expr("'nb/' || cast(nb_id as string) || '.ipynb'").alias("file_path"),
        F.sha1(nb.cast("string").cast("binary")).alias("sha"),
        (nb * 10).alias("size"),
        F.expr("'https://example.org/' || cast(nb_id as string)").alias("html_url"),
        F.when(separate, F.lit("none")).otherwise(F.lit("base64")).alias("encoding"),
        F.when(~separate, F.base64(body.cast("binary"))).alias("content"),
        F.when(separate, body).alias("download_body"),
    )


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of ``contents``, derived from ``part`` so that some notebooks have none and some have no files."""
    keys = table(spark, sf_dir, "part").select((F.col("p_partkey") % 190).alias("k")).distinct()
    return keys.select(
        F.expr("'org' || cast(k % 20 as string) || '/repo' || cast(k as string)").alias("full_name"),
        F.col("k").alias("id"),
        F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(F.lit("dev")).alias("default_branch"),
        F.expr("timestamp '2025-01-01 00:00:00' + make_dt_interval(cast(k as int))").alias("created_at"),
        (F.col("k") % 7).alias("stargazers_count"),
    )


# ---- the same documents as DuckDB CTEs ----

_DUCK_NAMES = {"nb": "nb_id", "i": "cell_idx", "line": "line"}


def _duck(formula: str) -> str:
    return formula.format(**_DUCK_NAMES)


def _mime_json(kind: str, pairs: list[tuple[str, str]]) -> str:
    entries = " || ',' || ".join(
        f"""'{{"mime":"{mime}","value":' || cast(to_json('text:' || {value}) as varchar) || '}}'""" for mime, value in pairs
    )
    return f"""'{{"output_type":"{kind}","data":[' || {entries} || ']}}'"""


_CANON = f"""
case out_kind
  when 0 then {_mime_json('display_data', [('text/plain', 'line')])}
  when 1 then {_mime_json('display_data', [('image/png', 'md5(line)'), ('text/plain', "'fig'")])}
  when 2 then {_mime_json('execute_result', [('text/html', "'<b>' || line || '</b>'")])}
  when 3 then {_mime_json('display_data', [('application/vnd.plotly.v1+json', "'{}'")])}
  when 4 then {_mime_json('display_data', [('text/latex', "'$x$'")])}
  when 5 then '{{"output_type":"error","ename":"ValueError","traceback":' || cast(to_json('a' || chr(10) || line) as varchar) || '}}'
  when 6 then '{{"output_type":"stream","name":"stdout","text":' || cast(to_json(line) as varchar) || '}}' end
"""

DUCK_DOC_CELLS = f"""
doc_lines as (
  select doc_id as nb_id, cast(unnest(range(len(string_split(text, chr(10))))) as integer) as cell_idx,
    unnest(string_split(text, chr(10))) as line
  from documents),
doc_cells_all as (
  select nb_id, cell_idx, line, {_duck(CELL_TYPE)} as cell_type, {_duck(SOURCE)} as source,
    case when {_duck(IS_CODE)} then {_duck(COUNT)} end as execution_count,
    ({_duck(IS_CODE)}) and (({_duck(COUNT)}) is not null or {_duck(STAR)}) as execution_count_set,
    case when {_duck(IS_CODE)} then {_duck(OUTPUT)} else 7 end as out_kind,
    case when {_duck(IS_CODE)} then (nb_id * 3 + cell_idx) % 12 end as code_kind
  from doc_lines),
doc_cells as (
  select *, {_CANON} as canon from doc_cells_all where not {UNDECODED.format(nb="nb_id")}),
mimes(out_kind, mime) as (values
  (0, 'text/plain'), (1, 'image/png'), (1, 'text/plain'), (2, 'text/html'), (3, 'application/vnd.plotly.v1+json'),
  (4, 'text/latex')),
code_imports(code_kind, pos, module) as (values
  (0, 0, 'numpy'), (0, 1, 'os'), (4, 0, 'util'), (6, 0, 'unittest'), (8, 0, 'pandas'), (9, 0, 'my_test')),
imports as (
  select nb_id, cell_idx, pos, module from doc_cells join code_imports using (code_kind)),
ranked_imports as (
  select nb_id, module, n, row_number() over (partition by nb_id order by n desc, first_cell, first_pos) as rank
  from (select nb_id, module, count(*) as n, min(cell_idx) as first_cell, min(cell_idx * 10 + pos) as first_pos
        from imports group by nb_id, module) c),
nb as (select distinct nb_id from doc_cells),
out_of_order as (
  select nb_id, bool_or(execution_count < before) as out_of_order
  from (select nb_id, execution_count, lag(execution_count) over (partition by nb_id order by cell_idx) as before
        from doc_cells where execution_count is not null) s group by nb_id),
gaps as (
  select nb_id, counts[len(counts)] - counts[1] + 1 - len(counts) as n_skips_total,
    case when len(counts) > 1 then counts[len(counts)] - counts[2] + 2 - len(counts) else 0 end as n_skips_middle
  from (select nb_id, list_sort(list(distinct execution_count)) as counts from doc_cells
        where execution_count is not null group by nb_id) s),
import_lists as (
  select nb_id, sum(n) as imports_total,
    '[' || string_agg('["' || module || '", ' || cast(n as varchar) || ']', ', ' order by rank) || ']' as top_imports_json
  from ranked_imports group by nb_id),
doc_metrics as (
  select c.nb_id, count(*) as n_cells_total, count(*) filter (cell_type = 'code') as n_code,
    count(*) filter (cell_type = 'markdown') as n_markdown, count(*) filter (cell_type = 'raw') as n_raw,
    count(execution_count) as n_code_executed,
    case when count(*) filter (cell_type = 'code') > 0
      then cast(count(execution_count) as double) / count(*) filter (cell_type = 'code') * 100 else 0 end
      as percent_code_executed,
    count(execution_count) > 0 and count(execution_count) = count(*) filter (execution_count_set) as has_unambiguous_order,
    coalesce(max(execution_count), 0) as max_execution_count,
    count(*) filter (cell_type = 'code' and out_kind < 7) as n_cells_with_output,
    coalesce(bool_or(out_kind in (0, 1, 2, 4)), false) as outputs_text,
    coalesce(bool_or(out_kind = 1), false) as outputs_image,
    coalesce(bool_or(out_kind = 2), false) as outputs_html_js,
    coalesce(bool_or(out_kind = 5), false) as outputs_error,
    coalesce(bool_or(out_kind = 4), false) as outputs_formatted,
    coalesce(bool_or(out_kind = 3), false) as outputs_ext,
    coalesce(bool_or(code_kind = 4), false) as has_local_imports,
    coalesce(bool_or(code_kind = 7), false) as defines_function,
    coalesce(bool_or(code_kind = 8), false) as defines_class,
    coalesce(bool_or(code_kind = 9), false) as has_control_flow,
    coalesce(bool_or(code_kind in (6, 9)), false) as uses_testing_module,
    bool_or(cell_type = 'markdown' and regexp_matches(source,
      '(?i)\\b(ChatGPT|Copilot|Claude|CodeWhisperer|Cursor)\\b|As an AI language model')) as ai_marker_found,
    bool_or(cell_type = 'code' and contains(source, '```')) as triple_backticks_in_code,
    bool_or(cell_type = 'code' and regexp_matches(source, '(^/[^ \\n\\r]+)|([A-Za-z]:\\\\[^ \\n\\r]+)')) as has_abs_data_path
  from doc_cells c group by c.nb_id),
doc_all as (
  select m.*, coalesce(o.out_of_order, false) as out_of_order, coalesce(g.n_skips_total, 0) as n_skips_total,
    coalesce(g.n_skips_middle, 0) as n_skips_middle, cast(coalesce(i.imports_total, 0) as bigint) as imports_total,
    coalesce(i.top_imports_json, '[]') as top_imports_json,
    {LANGUAGE.format(nb="m.nb_id")} as language, 'python3' as kernel_name,
    '3.' || cast(m.nb_id % 4 + 8 as varchar) as python_version_declared
  from doc_metrics m left join out_of_order o using (nb_id) left join gaps g using (nb_id)
    left join import_lists i using (nb_id)),
fingerprints as (
  select nb_id, sha256('[' || coalesce(string_agg(canon, ',' order by cell_idx), '') || ']') as outputs_hash,
    count(canon) as n_outputs from doc_cells group by nb_id)
"""


def duck_views(*names: str) -> str:
    """Leading CTEs for an oracle query."""
    return ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
