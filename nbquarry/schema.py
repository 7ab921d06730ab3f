"""Table schemas: the 45-column collection, the 18-column runs, and the long cell table."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


# Column names and order are the file format.
COLLECTION_SCHEMA = _struct([
    ("repo_full_name", _S), ("repo_id", _L), ("repo_default_branch", _S), ("repo_created_at", _TS), ("repo_stars", _L),
    ("file_path", _S), ("file_sha", _S), ("file_size", _L), ("html_url", _S), ("nb_ok_parse", _B),
    ("kernel_name", _S), ("language", _S), ("python_version_declared", _S),
    ("n_cells_total", _L), ("n_code", _L), ("n_markdown", _L), ("n_raw", _L),
    ("n_code_executed", _L), ("percent_code_executed", _D), ("has_unambiguous_order", _B), ("out_of_order", _B),
    ("n_skips_total", _L), ("n_skips_middle", _L), ("max_execution_count", _L),
    ("n_cells_with_output", _L), ("outputs_text", _B), ("outputs_image", _B), ("outputs_html_js", _B),
    ("outputs_error", _B), ("outputs_formatted", _B), ("outputs_ext", _B),
    ("imports_total", _L), ("top_imports_json", _S), ("has_local_imports", _B), ("defines_function", _B),
    ("defines_class", _B), ("has_control_flow", _B), ("uses_testing_module", _B),
    ("deps_requirements_txt", _B), ("deps_setup_py", _B), ("deps_pipfile", _B), ("deps_any", _B),
    ("ai_marker_found", _B), ("triple_backticks_in_code", _B), ("has_abs_data_path", _B),
])

RUN_SCHEMA = _struct([
    ("repo_full_name", _S), ("repo_default_branch", _S), ("file_path", _S), ("nb_ok_parse", _B),
    ("kernel_name", _S), ("language", _S), ("python_version_declared", _S),
    ("exec_ok", _B), ("error", _S), ("exc_name", _S), ("failed_cell_index", _S), ("elapsed_s", _D),
    ("original_found", _B), ("outputs_equal", _B), ("outputs_hash_orig", _S), ("outputs_hash_exec", _S),
    ("n_outputs_orig", _L), ("n_outputs_exec", _L),
])

COLLECTION_FIELDS = COLLECTION_SCHEMA.fieldNames()
RUN_FIELDS = RUN_SCHEMA.fieldNames()

# Columns that hold facts about the file rather than metrics of its content.
IDENTITY_FIELDS = COLLECTION_FIELDS[:10]
DEPENDENCY_FIELDS = ["deps_requirements_txt", "deps_setup_py", "deps_pipfile", "deps_any"]

# Long cell table. execution_count is NULL unless the stored value is an integer; execution_count_set tells whether
# anything other than null was stored.
CELL_FIELDS = [
    "nb_id", "cell_idx", "cell_type", "source", "execution_count", "execution_count_set",
    "n_outputs", "output_types", "mime_types",
]

# Run columns that the output-comparison statistics need.
OUTPUT_COMPARISON_FIELDS = [
    "original_found", "outputs_equal", "outputs_hash_orig", "outputs_hash_exec", "n_outputs_orig", "n_outputs_exec",
]


def as_text_schema(schema: T.StructType) -> T.StructType:
    """The same columns, all text: how a CSV is read before it is typed."""
    return T.StructType([T.StructField(f.name, _S) for f in schema.fields])
