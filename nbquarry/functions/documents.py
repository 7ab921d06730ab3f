"""Reading values out of notebook documents held as VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# NaN and Infinity are accepted as Python's writer emits them (they become text); quoting stays strict. String length
# is raised above the parser's 20 million default so that large embedded images do not void a document.
_JSON_OPTIONS = {
    "allowNonNumericNumbers": "true",
    "allowSingleQuotes": "false",
    "maxStringLen": "2147483647",
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def computed_once(df: DataFrame, name: str) -> DataFrame:
    """Keep later filters on column ``name`` from being moved below the step that computes it.

    Moving a filter down copies the column's expression into it; for a parsed document that means parsing again for
    every mention. Filters do not cross an explode of the column they look at.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode_outer(F.array(name)).alias(name))


def parse_json(text: Column) -> Column:
    """``text`` as VARIANT, or NULL unless the whole text is one JSON value.

    The parser stops after the first value, so the text is placed inside an object with a closing key: text left over
    after the value then breaks the object or hides the key.
    """
    framed = F.concat(F.lit('{"document":'), text, F.lit('\n,"document end":true}'))
    return let(
        F.from_json(framed, "variant", _JSON_OPTIONS),
        lambda parsed: F.when(
            F.try_variant_get(parsed, "$['document end']", "boolean"), F.try_variant_get(parsed, "$.document", "variant")
        ),
    )


def list_items(v: Column, path: str = "$") -> Column:
    """Items of the JSON list at ``path``, NULL if it is not a list."""
    return F.try_variant_get(v, path, "array<variant>")


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def is_true(v: Column) -> Column:
    """True for JSON ``true`` alone; a cast would also take numbers and text."""
    return F.coalesce(F.to_json(v) == "true", F.lit(False))


def is_absent(v: Column) -> Column:
    """True for a missing value and for JSON null."""
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def string_value(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def as_text(v: Column) -> Column:
    """A JSON string as is, a list as its string items joined, anything else as empty text.

    The type is tested first: casting a list to string yields JSON text, and casting its items turns numbers into text.
    """
    joined = F.array_join(F.transform(F.filter(list_items(v), is_string), string_value), "")
    return F.coalesce(joined, F.when(is_string(v), string_value(v)), F.lit(""))


def integer_value(v: Column) -> Column:
    """The value if it is stored as an integer; 3.0, "3" and true are not."""
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def _of_notebook(notebooks: DataFrame, from_doc: Column, field: str) -> Column:
    """A value read from ``doc``, or where the document is too large for that, the field of ``large`` (see ``functions.large``)."""
    return F.coalesce(from_doc, F.col("large").getField(field)) if "large" in notebooks.columns else from_doc


def is_decoded(notebooks: DataFrame) -> Column:
    doc = F.col("doc").isNotNull()
    return doc | F.col("large").isNotNull() if "large" in notebooks.columns else doc


def metadata(notebooks: DataFrame) -> dict[str, Column]:
    """``kernel_name``, ``language`` and ``python_version_declared`` of the notebooks."""
    readers = {"kernel_name": kernel_name, "language": language, "python_version_declared": language_version}
    return {name: _of_notebook(notebooks, read(F.col("doc")), name).alias(name) for name, read in readers.items()}


def cells_of(notebooks: DataFrame) -> Column:
    """Light columns of every cell of the notebooks, NULL where they are undecoded."""
    return _of_notebook(notebooks, F.when(F.col("doc").isNotNull(), cell_records(F.col("doc"))), "cells")


def kernel_name(doc: Column) -> Column:
    return F.try_variant_get(doc, "$.metadata.kernelspec.name", "string")


def language(doc: Column) -> Column:
    return F.try_variant_get(doc, "$.metadata.language_info.name", "string")


def language_version(doc: Column) -> Column:
    return F.try_variant_get(doc, "$.metadata.language_info.version", "string")


def usable_document(doc: Column) -> Column:
    """``doc`` if it is an object whose ``cells`` is a list or null, else NULL.

    An empty object, a bare value and an object without ``cells`` carry no notebook; one such file must not fail a job,
    so it counts as undecoded.
    """
    cells = F.try_variant_get(doc, "$.cells", "variant")
    # The first test settles nearly all documents and copies one cell; the others see only unusual ones.
    has_cell = F.try_variant_get(doc, "$.cells[0]", "variant").isNotNull()
    is_list = F.startswith(F.schema_of_variant(cells), F.lit("ARRAY"))
    return F.when(has_cell | F.is_variant_null(cells) | is_list, doc)


def mime_keys(output: Column) -> Column:
    data = F.try_variant_get(output, "$.data", "map<string,variant>")
    return F.coalesce(F.map_keys(data), F.array().cast("array<string>"))


def cell_record(cell: Column, position: Column) -> Column:
    """The light columns of one cell (see ``schema.CELL_FIELDS``); output payloads stay behind."""
    cell_type = F.try_variant_get(cell, "$.cell_type", "string")
    is_code = cell_type == "code"
    stored_count = F.try_variant_get(cell, "$.execution_count", "variant")
    light_outputs = F.transform(
        F.when(is_code, list_items(cell, "$.outputs")),
        lambda o: F.struct(
            F.try_variant_get(o, "$.output_type", "string").alias("kind"), mime_keys(o).alias("mimes")
        ),
    )
    none = F.array().cast("array<string>")

    def record(outputs: Column) -> Column:
        return F.struct(
            position.cast("int").alias("cell_idx"),
            cell_type.alias("cell_type"),
            as_text(F.try_variant_get(cell, "$.source", "variant")).alias("source"),
            F.when(is_code, integer_value(stored_count)).alias("execution_count"),
            F.coalesce(is_code & ~is_absent(stored_count), F.lit(False)).alias("execution_count_set"),
            F.coalesce(F.array_size(outputs), F.lit(0)).alias("n_outputs"),
            F.coalesce(outputs.getField("kind"), none).alias("output_types"),
            F.coalesce(F.flatten(outputs.getField("mimes")), none).alias("mime_types"),
        )

    return let(light_outputs, record)


def cell_records(doc: Column) -> Column:
    """Light columns of every cell of a document, in order."""
    cells = F.coalesce(list_items(doc, "$.cells"), F.array().cast("array<variant>"))
    return F.transform(cells, cell_record)
