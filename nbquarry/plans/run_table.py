"""From run logs and archived originals to the run table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from nbquarry.functions.documents import is_decoded
from nbquarry.functions.names import default_branch
from nbquarry.operators.filters import filter_parsed_strict
from nbquarry.operators.joins import PART_ROWS, left_join_unique
from nbquarry.operators.matching import match_originals
from nbquarry.operators.outputs import compare_outputs, outputs_hash
from nbquarry.operators.runs import normalize_outcome, parse_run_log, resolve_kernel
from nbquarry.schema import RUN_FIELDS

_NOTEBOOK = ["repo_full_name", "file_path"]
_DECLARED = ["repo_default_branch", "kernel_name", "language", "python_version_declared"]


def fingerprinted_originals(originals: DataFrame) -> DataFrame:
    """Light table of originals: name, whether it could be read, fingerprint and number of outputs."""
    hashed = outputs_hash(originals.withColumn("readable", is_decoded(originals)),
                          ["owner", "repo", "archive_name", "readable"])
    return hashed.withColumnsRenamed({"outputs_hash": "outputs_hash_orig", "n_outputs": "n_outputs_orig"})


def with_executed_hash(runs: DataFrame, executed: DataFrame, log_id: str) -> DataFrame:
    """Successful runs with the fingerprint of the executed notebook in place of the logged one, where there is one.

    ``hashed_here`` tells which. Both sides have one row per run, so the join is even.
    """
    hashed = outputs_hash(executed, [log_id]).select(log_id, F.col("outputs_hash").alias("_hash"), F.col("n_outputs").alias("_n"))
    joined = runs.join(hashed, log_id, "left")
    here = F.coalesce("exec_ok", F.lit(False)) & F.col("_hash").isNotNull()
    return joined.withColumns({
        "outputs_hash_exec": F.when(here, F.col("_hash")).otherwise(F.col("outputs_hash_exec")),
        "n_outputs_exec": F.when(here, F.col("_n")).otherwise(F.col("n_outputs_exec")),
        "hashed_here": here,
    }).drop("_hash", "_n")


def runs_by_kernel(declared: DataFrame, logs: DataFrame) -> DataFrame:
    """``(kernel_name, rows)``: how many runs there are of the notebooks that declare a kernel, from a row for each notebook."""
    logged = logs.groupBy(*_NOTEBOOK).agg(F.count(F.lit(1)).alias("rows"))
    return declared.select(*_NOTEBOOK, "kernel_name").join(logged, _NOTEBOOK).groupBy("kernel_name").agg(F.sum("rows").alias("rows"))


def run_table(
    collection: DataFrame, logs: DataFrame, originals: DataFrame | None, known_kernels: Iterable[str] | DataFrame,
    log_id: str = "log_id", executed: DataFrame | None = None, logged_hashes_compare: bool = False, part_rows: int = PART_ROWS,
) -> DataFrame:
    """One run row per log of an eligible notebook, in the 18-column format.

    ``logs`` has one row per run, told apart by ``log_id``; a notebook without a log was skipped and leaves no row.
    ``executed`` has the notebook as each run left it, ``(log_id, doc)``, at most one per run. Originals and executed
    notebooks are fingerprinted by the same operator, so their hashes compare. A hash found in a log was made elsewhere
    and is NULL here, unless ``logged_hashes_compare`` says that originals are hashed the same way there. A run that
    failed has no outputs to equal the original's. Where a run succeeded and no comparable hash is known, and without
    ``originals``, ``outputs_equal`` is NULL.
    """
    eligible = filter_parsed_strict(collection).withColumn(
        "repo_default_branch", default_branch(F.col("repo_default_branch"))
    )
    # A notebook listed more than once is still one notebook.
    declared = eligible.groupBy(*_NOTEBOOK).agg(F.min(F.struct(*_DECLARED)).alias("d")).select(*_NOTEBOOK, "d.*")
    outcomes = normalize_outcome(parse_run_log(logs)).select(
        *_NOTEBOOK, log_id, "exec_ok", "error", "exc_name", "failed_cell_index", "elapsed_s",
        "outputs_hash_exec", "n_outputs_exec",
    )
    runs = left_join_unique(outcomes, declared, _NOTEBOOK, [log_id], how="inner", count_on=logs)
    if executed is not None:
        runs = with_executed_hash(runs, executed, log_id)
    kernels = runs_by_kernel(declared, logs)
    runs = resolve_kernel(runs, known_kernels, [log_id], count_on=kernels, part_rows=part_rows).withColumn("nb_ok_parse", F.lit(True))
    if originals is None:
        none = F.lit(None)
        matched = runs.withColumns({
            "readable": none.cast("boolean"), "outputs_hash_orig": none.cast("string"), "n_outputs_orig": none.cast("bigint"),
        })
    else:
        carry = ["readable", "outputs_hash_orig", "n_outputs_orig"]
        matched = match_originals(runs, fingerprinted_originals(originals), carry, [log_id], count_on=logs)
    found = compare_outputs(matched.withColumn("original_found", F.coalesce("readable", F.lit(False))))
    own = F.lit(logged_hashes_compare) if executed is None else F.col("hashed_here") | F.lit(logged_hashes_compare)
    # A hash of another scheme is no hash here; the empty one of a failed run is.
    hash_exec = F.when(own | (F.col("outputs_hash_exec") == ""), F.col("outputs_hash_exec"))
    comparable = hash_exec.isNotNull() | ~F.coalesce("exec_ok", F.lit(False))
    return found.withColumns({
        "outputs_equal": F.when(comparable, F.col("outputs_equal")), "outputs_hash_exec": hash_exec,
    }).select(*RUN_FIELDS)
