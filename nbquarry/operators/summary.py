"""Descriptive statistics of a collection and of its runs.

Inputs may be typed tables or all-text tables as read from CSV: every flag and number goes through the lenient
conversions. ``row_id`` is any column that orders rows as they came; ties in top lists go to the value seen first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from nbquarry import constants as K
from nbquarry.functions.coerce import blank_to_null, is_filled, pct, to_bool, to_float, to_int
from nbquarry.functions.names import notebook_label
from nbquarry.operators.filters import has_output_columns, language_starts_with_python
from nbquarry.operators.heavy import COUNTERS, top_values
from nbquarry.operators.profile import median_and_mean


def _flag(name: str) -> Column:
    return to_bool(F.col(name))


# A rate is (name, column with the part, column with the whole) over a one-row table of counts.
Rate = tuple[str, str, str]


def rates(counts: DataFrame, entries: list[Rate]) -> DataFrame:
    """``(metric, n, of, pct)``, one row per rate."""
    rows = ", ".join(f"struct('{metric}' as metric, `{part}` as n, `{whole}` as `of`)" for metric, part, whole in entries)
    return counts.selectExpr(f"inline(array({rows}))").withColumn("pct", pct(F.col("n"), F.col("of")))


def _stack(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``(metric, value)`` rows, one per entry and input row; NULLs are dropped right away."""
    entries = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()]
    return df.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())


# ---- collection ----

def collection_conditions() -> dict[str, Column]:
    """What is counted of a collection."""
    return {
        "rows": F.lit(True), "parsed": _flag("nb_ok_parse"), "python": language_starts_with_python(), "deps": _flag("deps_any"),
        "unambiguous": _flag("has_unambiguous_order"),
    }


def _count(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row of counts behind size and rates; what a statistic does not use is pruned from it."""
    return df.agg(*[F.count_if(condition).alias(name) for name, condition in conditions.items()])


def collection_counts(collection: DataFrame) -> DataFrame:
    return _count(collection, collection_conditions())


FLAG_RATES = [
    ("nb_ok_parse", "parsed", "rows"), ("language_python", "python", "rows"),
    ("deps_any", "deps", "rows"), ("has_unambiguous_order", "unambiguous", "rows"),
]


def collection_size(collection: DataFrame) -> DataFrame:
    return collection_counts(collection).select(F.col("rows").alias("n"))


def flag_rates(collection: DataFrame) -> DataFrame:
    """Parsed, Python, with dependency files, unambiguously ordered: count and share of all rows."""
    return rates(collection_counts(collection), FLAG_RATES).drop("of")


def collection_values() -> dict[str, Column]:
    """What is profiled of a collection. Blanks are left out; text that is no number counts as 0."""
    filled = lambda name, value: F.when(is_filled(F.col(name)), value)
    return {
        "n_code": filled("n_code", to_int(F.col("n_code"))),
        "n_markdown": filled("n_markdown", to_int(F.col("n_markdown"))),
        "percent_code_executed": filled("percent_code_executed", to_float(F.col("percent_code_executed"))),
    }


def numeric_profile(collection: DataFrame) -> DataFrame:
    """Median and mean of three columns."""
    return median_and_mean(_stack(collection, collection_values()))


def top_imports_overall(pairs: DataFrame, row_id: str = "row_id", limit: int = K.TOP_IMPORTS) -> DataFrame:
    """Most used modules from ``(row_id, pos, module, n)`` rows of ``explode_import_counts``.

    Those lists hold a notebook's top modules only, so rarely used ones are undercounted;
    :func:`top_imports_exact` counts every import.
    """
    counts = pairs.groupBy("module").agg(
        F.sum("n").alias("n"), F.min(F.struct(F.col(row_id), F.col("pos"))).alias("first_seen")
    )
    return counts.orderBy(F.desc("n"), "first_seen").limit(limit).select("module", "n")


def top_imports_exact(imports: DataFrame, limit: int = K.TOP_IMPORTS) -> DataFrame:
    """Most used modules from the full import table ``(nb_id, cell_idx, pos, module)``."""
    counts = imports.groupBy("module").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("nb_id", "cell_idx", "pos")).alias("first_seen")
    )
    return counts.orderBy(F.desc("n"), "first_seen").limit(limit).select("module", "n")


def top_imports_by_summaries(imports: DataFrame, limit: int = K.TOP_IMPORTS, counters: int = COUNTERS) -> DataFrame:
    """The same from a stored table of very many modules, which is read twice when this is called.

    Summaries of bounded size name what may be among the first, and only that is counted: rare modules never reach the shuffle.
    """
    return top_values(imports, "module", F.struct("nb_id", "cell_idx", "pos"), limit, counters)


# ---- runs ----

def run_conditions(compared: bool) -> dict[str, Column]:
    """What is counted of runs; with ``compared`` also what the columns on outputs say."""
    ok = _flag("exec_ok")
    found = {"rows": F.lit(True), "ok": ok}
    if compared:
        original, equal = _flag("original_found"), _flag("outputs_equal")
        found |= {
            "equal": equal, "ok_equal": ok & equal, "found": original, "found_equal": original & equal, "found_ok": original & ok,
            "found_ok_equal": original & ok & equal,
        }
    return found


def run_counts(runs: DataFrame) -> DataFrame:
    return _count(runs, run_conditions(has_output_columns(runs)))


SUCCESS_RATE = [("success", "ok", "rows")]
FOUND_RATE = [("originals_found", "found", "rows")]
EQUAL_RATES = [("equal_all", "equal", "rows"), ("equal_ok", "ok_equal", "ok")]
KPIS = [("reproduced", "found_equal", "found"), ("reproduced_ok", "found_ok_equal", "found_ok")]


def run_success_rate(runs: DataFrame) -> DataFrame:
    return rates(run_counts(runs), SUCCESS_RATE).select(F.col("of").alias("n_runs"), F.col("n").alias("n_ok"), "pct")


def originals_found_rate(runs: DataFrame) -> DataFrame:
    return rates(run_counts(runs), FOUND_RATE).select("n", "pct")


def outputs_equal_rate(runs: DataFrame) -> DataFrame:
    """Runs with equal outputs: among all runs and among successful ones."""
    return rates(run_counts(runs), EQUAL_RATES).drop("of")


def reproducibility_kpis(runs: DataFrame) -> DataFrame:
    """``(metric, n, of, pct)``: equal among found, and among found and successful; only for a non-zero base."""
    return rates(run_counts(runs), KPIS).where("of > 0")


def failures(runs: DataFrame) -> DataFrame:
    return runs.where(is_failure())


# Failure lists and their lengths.
FAILURE_LISTS = {"error": K.TOP_ERRORS, "repo_full_name": K.TOP_FAILURES, "notebook": K.TOP_FAILURES}


def _failure_key(name: str) -> Column:
    if name == "error":
        return F.coalesce(blank_to_null(F.col("error")), F.lit(K.MISSING_ERROR))
    if name == "notebook":
        return notebook_label(F.col("repo_full_name"), F.col("file_path"))
    return F.col(name)


def _top_failures(runs: DataFrame, name: str, row_id: str, limit: int | None) -> DataFrame:
    counts = failures(runs).groupBy(_failure_key(name).alias(name)).agg(
        F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first_row")
    )
    return counts.orderBy(F.desc("n"), "first_row", name).limit(limit or FAILURE_LISTS[name]).select(name, "n")


def top_errors(runs: DataFrame, row_id: str = "row_id", limit: int | None = None) -> DataFrame:
    return _top_failures(runs, "error", row_id, limit)


def failures_by_repo(runs: DataFrame, row_id: str = "row_id", limit: int | None = None) -> DataFrame:
    return _top_failures(runs, "repo_full_name", row_id, limit)


def failures_by_notebook(runs: DataFrame, row_id: str = "row_id", limit: int | None = None) -> DataFrame:
    return _top_failures(runs, "notebook", row_id, limit)


def failure_keys() -> dict[str, Column]:
    """The key under which a failed run is counted in each failure list."""
    return {name: _failure_key(name) for name in FAILURE_LISTS}


def is_failure() -> Column:
    return ~_flag("exec_ok")


def _elapsed_values() -> dict[str, Column]:
    seconds = F.when(is_filled(F.col("elapsed_s")), to_float(F.col("elapsed_s")))
    ok = _flag("exec_ok")
    return {"elapsed_all": seconds, "elapsed_ok": F.when(ok, seconds), "elapsed_failed": F.when(~ok, seconds)}


def _output_counts() -> dict[str, Column]:
    return {n: F.when(is_filled(F.col(n)), to_int(F.col(n))) for n in ["n_outputs_orig", "n_outputs_exec"]}


def elapsed_profile(runs: DataFrame) -> DataFrame:
    """Median and mean run time of all, successful and failed runs."""
    return median_and_mean(_stack(runs, _elapsed_values()))


def output_count_profile(runs: DataFrame) -> DataFrame:
    """Median and mean number of outputs of originals and of runs; 0 counts, blanks do not."""
    return median_and_mean(_stack(runs, _output_counts()))


def run_values(compared: bool) -> dict[str, Column]:
    """What is profiled of runs."""
    return _elapsed_values() | (_output_counts() if compared else {})


def divergence_examples(runs: DataFrame, row_id: str = "row_id", limit: int = K.DIVERGENCE_EXAMPLES) -> DataFrame:
    """The first runs whose two fingerprints exist and differ."""
    original, run = F.col("outputs_hash_orig"), F.col("outputs_hash_exec")
    differing = runs.where(is_filled(original) & is_filled(run) & (original != run)).orderBy(row_id).limit(limit)
    return differing.select(
        F.col(row_id).alias("row_id"),
        notebook_label(F.col("repo_full_name"), F.col("file_path")).alias("notebook"),
        F.left(original, F.lit(K.SHA_PREFIX_LENGTH)).alias("hash_orig"),
        F.left(run, F.lit(K.SHA_PREFIX_LENGTH)).alias("hash_exec"),
        to_int(F.col("n_outputs_orig")).alias("n_orig"),
        to_int(F.col("n_outputs_exec")).alias("n_exec"),
    )
