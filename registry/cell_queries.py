"""Per-notebook metrics from the long cell table."""

from __future__ import annotations

from pyspark.sql import functions as F

from nbquarry.operators import cells as C, code as G
from nbquarry.operators.summary import top_imports_by_summaries, top_imports_exact
from registry import fixtures as X
from registry.book import checked

_FX = f"with {X.duck_views('fx_cells')}"
_CODE = "cell_type = 'code'"


def _grouped(columns: str) -> str:
    return f"{_FX} select nb_id, {columns} from fx_cells group by nb_id"


def _operator(name: str, operator, columns: str) -> None:
    checked(name, _grouped(columns))(lambda spark, sf: operator(X.cells(spark, sf)))


_operator(
    "cell_type_counts", C.cell_type_counts,
    f"count(*) as n_cells_total, count(*) filter ({_CODE}) as n_code,"
    " count(*) filter (cell_type = 'markdown') as n_markdown, count(*) filter (cell_type = 'raw') as n_raw",
)
_operator(
    "executed_cells", C.executed_cells,
    f"count(execution_count) as n_code_executed, case when count(*) filter ({_CODE}) > 0 then"
    f" cast(count(execution_count) as double) / count(*) filter ({_CODE}) * 100 else 0 end as percent_code_executed",
)
_operator("unambiguous_order", C.unambiguous_order, "count(execution_count) > 0 as has_unambiguous_order")
_operator("max_execution_count", C.max_execution_count, "coalesce(max(execution_count), 0) as max_execution_count")
_operator(
    "cells_with_output", C.cells_with_output,
    f"count(*) filter ({_CODE} and (output_mime is not null or output_type = 'error')) as n_cells_with_output",
)
_operator("outputs_error", C.outputs_error, "coalesce(bool_or(output_type = 'error'), false) as outputs_error")
for _name, _test in {
    "outputs_text": "starts_with(output_mime, 'text/')",
    "outputs_image": "starts_with(output_mime, 'image/png') or starts_with(output_mime, 'image/jpeg') or starts_with(output_mime, 'image/svg')",
    "outputs_html_js": "output_mime in ('text/html', 'application/javascript')",
    "outputs_formatted": "output_mime in ('text/latex', 'text/markdown')",
    "outputs_ext": "starts_with(output_mime, 'application/vnd.') or starts_with(output_mime, 'application/plotly')",
}.items():
    checked(_name, _grouped(f"coalesce(bool_or({_test}), false) as {_name}"))(
        lambda spark, sf, name=_name: C.output_kind(X.cells(spark, sf), name)
    )
_operator(
    "ai_markers", C.ai_markers,
    "bool_or(cell_type = 'markdown' and regexp_matches(source,"
    r" '(?i)\b(ChatGPT|Copilot|Claude|CodeWhisperer|Cursor)\b|As an AI language model')) as ai_marker_found",
)
_operator("backticks_in_code", C.backticks_in_code,
          f"bool_or({_CODE} and contains(source, '```')) as triple_backticks_in_code")
_operator(
    "abs_path_in_code", C.abs_path_in_code,
    rf"bool_or({_CODE} and regexp_matches(source, '(^/[^ \n\r]+)|([A-Za-z]:\\[^ \n\r]+)')) as has_abs_data_path",
)

_ORDER = """
ordered as (
  select nb_id, bool_or(execution_count < before) as falls
  from (select nb_id, execution_count, lag(execution_count) over (partition by nb_id order by cell_idx) as before
        from fx_cells where execution_count is not null) s group by nb_id),
distinct_counts as (
  select nb_id, list_sort(list(distinct execution_count)) as counts from fx_cells
  where execution_count is not null group by nb_id),
gaps as (
  select nb_id, counts[len(counts)] - counts[1] + 1 - len(counts) as total,
    case when len(counts) > 1 then counts[len(counts)] - counts[2] + 2 - len(counts) else 0 end as middle
  from distinct_counts),
nb as (select distinct nb_id from fx_cells)
"""
checked("out_of_order", f"{_FX}, {_ORDER} select nb_id, coalesce(falls, false) as out_of_order from nb left join ordered using (nb_id)")(
    lambda spark, sf: C.out_of_order(X.cells(spark, sf))
)
checked("skips_total", f"{_FX}, {_ORDER} select nb_id, coalesce(total, 0) as n_skips_total from nb left join gaps using (nb_id)")(
    lambda spark, sf: C.skips_total(X.cells(spark, sf))
)
checked("skips_middle", f"{_FX}, {_ORDER} select nb_id, coalesce(middle, 0) as n_skips_middle from nb left join gaps using (nb_id)")(
    lambda spark, sf: C.skips_middle(X.cells(spark, sf))
)


@checked("execution_profile", f"""{_FX}, {_ORDER},
per_nb as (
  select nb_id, count(*) filter ({_CODE}) as n_code, count(execution_count) as n_executed from fx_cells group by nb_id)
select count(*) as n_notebooks, sum(n_code)::bigint as n_code, sum(n_executed)::bigint as n_code_executed,
  count(*) filter (n_executed > 0) as n_unambiguous, count(*) filter (coalesce(falls, false)) as n_out_of_order,
  count(*) filter (coalesce(total, 0) > 0) as n_with_skips
from per_nb left join ordered using (nb_id) left join gaps using (nb_id)""")
def execution_profile(spark, sf):
    """How a corpus was executed: the flagship summary over all long-form metrics."""
    metrics = C.cell_metrics(X.cells(spark, sf))
    return metrics.agg(
        F.count(F.lit(1)).alias("n_notebooks"),
        F.sum("n_code").alias("n_code"),
        F.sum("n_code_executed").alias("n_code_executed"),
        F.count_if("has_unambiguous_order").alias("n_unambiguous"),
        F.count_if("out_of_order").alias("n_out_of_order"),
        F.count_if(F.col("n_skips_total") > 0).alias("n_with_skips"),
    )


# ---- code features: what the syntax tree of each source holds, written out by hand ----

_CODE_FACTS = """
facts(source, pos, module) as (values
  ('import numpy as np, os.path', 0, 'numpy'), ('import numpy as np, os.path', 1, 'os'),
  ('from .util import f', 0, 'util'), ('from unittest import mock', 0, 'unittest')),
imports as (select nb_id, cell_idx, pos, module from fx_cells join facts using (source) where cell_type = 'code')
"""
_IMPORTS = f"{_FX}, {_CODE_FACTS}"


def _features(spark, sf):
    return G.cell_code_features(X.cells(spark, sf))


def _imports(spark, sf):
    return G.extract_imports(_features(spark, sf))


checked("extract_imports", f"{_IMPORTS} select * from imports")(_imports)
checked("testing_modules", f"{_IMPORTS} select nb_id, bool_or(module = 'unittest') as uses_testing_module from imports group by nb_id")(
    lambda spark, sf: G.testing_modules(_imports(spark, sf))
)
checked("import_totals", f"{_IMPORTS} select nb_id, count(*) as imports_total from imports group by nb_id")(
    lambda spark, sf: G.import_totals(_imports(spark, sf))
)
_RANKED = f"""{_IMPORTS},
counted as (select nb_id, module, count(*) as n, min(cell_idx * 10 + pos) as seen from imports group by nb_id, module),
ranked as (select nb_id, module, n, row_number() over (partition by nb_id order by n desc, seen) as rank from counted)
"""
checked("ranked_imports", f"{_RANKED} select nb_id, rank, module, n from ranked where rank <= 10")(
    lambda spark, sf: G.ranked_imports(_imports(spark, sf))
)


@checked("top_imports", f"""{_RANKED}
select nb_id, '[' || string_agg('["' || module || '", ' || cast(n as varchar) || ']', ', ' order by rank) || ']'
  as top_imports_json from ranked where rank <= 10 group by nb_id""")
def top_imports(spark, sf):
    lists = G.top_imports(_imports(spark, sf))
    return lists.select("nb_id", G.imports_json(F.col("top_imports")).alias("top_imports_json"))


checked("top_imports_exact", f"""{_IMPORTS}
select module, count(*) as n from imports group by module order by n desc, min(nb_id * 1000 + cell_idx * 10 + pos) limit 10""")(
    lambda spark, sf: top_imports_exact(_imports(spark, sf))
)

checked("top_imports_by_summaries", f"""{_IMPORTS}
select module, count(*) as n from imports group by module order by n desc, min(nb_id * 1000 + cell_idx * 10 + pos) limit 10""")(
    lambda spark, sf: top_imports_by_summaries(_imports(spark, sf))
)
