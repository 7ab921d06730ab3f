"""Run logs: results, outcomes, error classes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from nbquarry import constants as K
from nbquarry.functions import documents as D
from nbquarry.functions.coerce import BLANKS, blank_to_null
from nbquarry.functions.names import log_tail, round_elapsed
from nbquarry.operators.joins import PART_ROWS, left_join_unique

# Everything that ends a line of captured output.
_LINE_END = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
_RESULT_LINE = rf"(?:^|[{_LINE_END}]){K.RESULT_PREFIX}([^{_LINE_END}]*)"


def resolve_kernel(
    df: DataFrame, known: Iterable[str] | DataFrame, spread_by: list[str] | None = None, count_on: DataFrame | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Replace ``kernel_name`` by the default kernel unless it is known.

    ``known`` is a list of names, or a table with a ``name`` column of any size. Then ``spread_by`` names the columns that tell rows
    apart, and ``count_on`` may be a cheaper table of kernel names and the number of rows that have them, ``(kernel_name, rows)``.
    """
    asked = F.btrim(F.coalesce(blank_to_null(F.col("kernel_name")), F.lit(K.DEFAULT_KERNEL)), F.lit(BLANKS))
    if not isinstance(known, DataFrame):
        return df.withColumn("kernel_name", F.when(asked.isin(list(known)), asked).otherwise(F.lit(K.DEFAULT_KERNEL)))
    names = known.select(F.col("name").alias("_asked")).distinct().withColumn("_known", F.lit(True))
    counted, weight = (None, None) if count_on is None else (count_on.select(asked.alias("_asked"), "rows"), "rows")
    looked_up = left_join_unique(
        df.withColumn("_asked", asked), names, ["_asked"], spread_by or df.columns, count_on=counted, part_rows=part_rows, weight=weight
    )
    kernel = F.when(F.col("_known"), F.col("_asked")).otherwise(F.lit(K.DEFAULT_KERNEL))
    return looked_up.withColumn("kernel_name", kernel).select(*df.columns)


def parse_run_log(logs: DataFrame) -> DataFrame:
    """Add ``info``, the JSON of the first result line of ``stdout``; NULL if there is none or it is not JSON."""
    line = F.regexp_extract("stdout", _RESULT_LINE, 1)
    return logs.withColumn("info", D.parse_json(blank_to_null(F.trim(line))))


def normalize_outcome(parsed: DataFrame) -> DataFrame:
    """One outcome per log of :func:`parse_run_log`.

    Besides ``info`` a log has ``returncode``, ``timed_out``, ``launch_error`` (name of the exception that kept the
    process from starting, NULL otherwise), ``stdout``, ``stderr`` and ``elapsed_s``. Success takes both a zero return
    code and a reported success.
    """
    reported = lambda name, dtype: F.try_variant_get("info", f"$.{name}", dtype)
    not_finished = F.coalesce(F.col("timed_out"), F.lit(False)) | F.col("launch_error").isNotNull()
    ok = ~not_finished & (F.col("returncode") == 0) & D.is_true(F.try_variant_get("info", "$.ok", "variant"))
    unnamed = F.when(F.col("returncode") != 0, F.lit(K.ERROR_SUBPROCESS)).otherwise(F.lit(K.ERROR_UNKNOWN))
    error = (
        F.when(F.coalesce(F.col("timed_out"), F.lit(False)), F.lit(K.ERROR_TIMEOUT))
        .when(F.col("launch_error").isNotNull(), F.col("launch_error"))
        .when(~ok, F.coalesce(blank_to_null(reported("error", "string")), unnamed))
    )
    has_tail = ~ok & ~not_finished
    return parsed.withColumns({
        "exec_ok": F.coalesce(ok, F.lit(False)),
        "error": error,
        "exc_name": F.lit(None).cast("string"),
        "failed_cell_index": F.lit(None).cast("string"),
        "elapsed_s": round_elapsed(F.col("elapsed_s")),
        "outputs_hash_exec": F.when(not_finished, F.lit("")).otherwise(
            F.coalesce(reported("outputs_hash", "string"), F.lit(""))
        ),
        "n_outputs_exec": F.when(not_finished, F.lit(0)).otherwise(
            F.coalesce(reported("n_outputs", "bigint"), F.lit(0))
        ).cast("bigint"),
        "stdout_tail": F.when(has_tail, log_tail(F.col("stdout"))),
        "stderr_tail": F.when(has_tail, log_tail(F.col("stderr"))),
        "missing_module": F.when(has_tail, reported("missing_module", "string")),
        "auth_error": F.when(has_tail, reported("auth_error", "boolean")),
        "file_missing": F.when(has_tail, reported("file_missing", "boolean")),
    })


def classify_errors(df: DataFrame, name: str = "error", message: str = "exc_msg") -> DataFrame:
    """Add ``missing_module``, ``auth_error`` and ``file_missing``, read off the exception's name and message."""
    empty = F.lit("")
    label, text = F.coalesce(F.col(name), empty), F.coalesce(F.col(message), empty)
    has = lambda c, part: F.contains(c, F.lit(part))
    file_texts = F.lit(False)
    for part in K.FILE_ERROR_TEXTS:
        file_texts = file_texts | has(text, part)
    return df.withColumns({
        "missing_module": blank_to_null(F.regexp_extract(text, K.MISSING_MODULE_PATTERN, 1)),
        "auth_error": has(text, K.AUTH_CODE) | has(label, K.AUTH_ERROR_NAME) | has(F.lower(text), K.AUTH_KEY_TEXT),
        "file_missing": has(label, K.FILE_ERROR_NAME) | file_texts,
    })
