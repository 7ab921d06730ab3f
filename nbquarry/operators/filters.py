"""Row filters and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nbquarry.functions import documents as D
from nbquarry.schema import COLLECTION_SCHEMA, OUTPUT_COMPARISON_FIELDS


def is_python_document(notebooks: DataFrame) -> Column:
    """The declared language contains ``python``, in any case; no declared language fails."""
    return F.coalesce(F.contains(F.lower(D.metadata(notebooks)["language"]), F.lit("python")), F.lit(False))


def filter_python(notebooks: DataFrame) -> DataFrame:
    return notebooks.where(is_python_document(notebooks))


def is_executed_state() -> Column:
    numbered = (F.col("percent_code_executed") > 0) | (F.col("max_execution_count") > 0)
    return (F.col("n_cells_with_output") > 0) & numbered


def filter_executed_state(metrics: DataFrame) -> DataFrame:
    """Notebooks with saved output and at least one numbered cell."""
    return metrics.where(is_executed_state())


def filter_parsed_strict(collection: DataFrame) -> DataFrame:
    """Rows whose parse flag is spelled exactly ``True`` (or is a true boolean of which no spelling is known)."""
    if "nb_ok_parse_text" in collection.columns:
        return collection.where(F.col("nb_ok_parse_text") == "True")
    if dict(collection.dtypes)["nb_ok_parse"] == "boolean":
        return collection.where("nb_ok_parse")
    return collection.where(F.col("nb_ok_parse") == "True")


def language_starts_with_python() -> Column:
    return F.startswith(F.lower(F.coalesce(F.col("language"), F.lit(""))), F.lit("python"))


def filter_language_prefix(collection: DataFrame) -> DataFrame:
    return collection.where(language_starts_with_python())


def filter_comparable(collection: DataFrame) -> DataFrame:
    """The subset fit for comparison: parsed, and in Python."""
    return filter_parsed_strict(collection).where(language_starts_with_python())


def project_fields(df: DataFrame) -> DataFrame:
    """The collection columns, in order and typed; absent ones are NULL."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in COLLECTION_SCHEMA.fields
    ])


def has_output_columns(runs: DataFrame) -> bool:
    """Can outputs be compared? Looks at the column names only."""
    return set(OUTPUT_COMPARISON_FIELDS) <= set(runs.columns)
