"""Canonical outputs and their fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nbquarry.functions import documents as D


def _item_text(item: Column) -> Column:
    return F.when(D.is_string(item), D.string_value(item)).otherwise(F.to_json(item))


def _joined(v: Column, separator: str = "") -> Column:
    """A string as is, a list with its items joined as text; NULL for other values."""
    joined = F.array_join(F.transform(D.list_items(v), _item_text), separator)
    return F.coalesce(joined, F.when(D.is_string(v), D.string_value(v)))


def _mime_value(v: Column) -> Column:
    """Text values and lists of text compare as text; other JSON keeps its JSON form. A tag keeps the two apart."""
    return F.coalesce(F.concat(F.lit("text:"), _joined(v)), F.concat(F.lit("json:"), F.to_json(v)))


def canonical_output(output: Column) -> Column:
    """What is compared of one output: no execution count, no metadata, MIME data sorted by type."""
    field = lambda name: F.try_variant_get(output, f"$.{name}", "variant")
    text_field = lambda name: F.try_variant_get(output, f"$.{name}", "string")
    kind = text_field("output_type")
    stream, error = kind == "stream", kind == "error"
    has_data = ~F.coalesce(stream | error, F.lit(False))
    text = field("text")
    data = F.try_variant_get(output, "$.data", "map<string,variant>")
    entries = F.array_sort(F.transform(
        F.map_entries(data), lambda e: F.struct(e.key.alias("mime"), _mime_value(e.value).alias("value"))
    ))
    no_entries = F.array().cast("array<struct<mime:string,value:string>>")
    return F.struct(
        kind.alias("output_type"),
        F.when(stream, text_field("name")).alias("name"),
        F.when(stream, F.when(text.isNull(), F.lit("")).otherwise(_joined(text))).alias("text"),
        F.when(has_data, F.coalesce(entries, no_entries)).alias("data"),
        F.when(error, text_field("ename")).alias("ename"),
        F.when(error, text_field("evalue")).alias("evalue"),
        F.when(error, F.coalesce(_joined(field("traceback"), "\n"), F.lit(""))).alias("traceback"),
    )


def code_outputs(doc: Column) -> Column:
    """All outputs of code cells in order."""
    cells = F.coalesce(D.list_items(doc, "$.cells"), F.array().cast("array<variant>"))
    code = F.filter(cells, lambda c: F.try_variant_get(c, "$.cell_type", "string") == "code")
    none = F.array().cast("array<variant>")
    return F.flatten(F.transform(code, lambda c: F.coalesce(D.list_items(c, "$.outputs"), none)))


def outputs_of(notebooks: DataFrame) -> Column:
    """:func:`code_outputs` of the notebooks, NULL where they are undecoded. Large ones bring each output as JSON text."""
    of_doc = F.when(F.col("doc").isNotNull(), code_outputs(F.col("doc")))
    if "large" not in notebooks.columns:
        return of_doc
    return F.coalesce(of_doc, F.transform("large.outputs", lambda o: D.parse_json(o.json)))


def canonical_outputs(notebooks: DataFrame) -> DataFrame:
    """One row per output of a code cell, in canonical form, with its position in the notebook."""
    outputs = notebooks.select("nb_id", F.posexplode(outputs_of(notebooks)).alias("output_idx", "output"))
    return outputs.select("nb_id", "output_idx", canonical_output(F.col("output")).alias("c")).select(
        "nb_id", "output_idx", "c.*"
    )


def fingerprint(outputs: Column) -> Column:
    """``(outputs_hash, n_outputs)`` of :func:`code_outputs`: equal hashes mean equal canonical outputs in equal order.

    An output that is not an object makes the comparison meaningless: empty hash, count 0.
    """
    # A type is read only where there is an object; the costlier type test runs for the rest.
    broken = F.exists(outputs, lambda o: F.try_variant_get(o, "$.output_type", "string").isNull() & ~D.is_object(o))
    canonical = F.to_json(F.transform(outputs, canonical_output))
    return F.when(broken, F.struct(F.lit("").alias("outputs_hash"), F.lit(0).cast("bigint").alias("n_outputs"))).otherwise(
        F.struct(
            F.sha2(canonical.cast("binary"), 256).alias("outputs_hash"),
            F.array_size(outputs).cast("bigint").alias("n_outputs"),
        )
    )


def outputs_hash(notebooks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fingerprint per notebook, NULL where it is undecoded. Runs inside each row: no shuffle."""
    keep = keep or ["nb_id"]
    found = notebooks.select(*keep, D.let(outputs_of(notebooks), lambda o: F.when(o.isNotNull(), fingerprint(o))).alias("f"))
    return found.select(*keep, "f.outputs_hash", "f.n_outputs")


def outputs_equal(original_found: Column, hash_original: Column, hash_run: Column) -> Column:
    """NULL without a fingerprinted original, else whether the fingerprints agree. A failed run has an empty one."""
    empty = F.lit("")
    comparable = original_found & (F.coalesce(hash_original, empty) != empty)
    return F.when(comparable, F.coalesce(hash_original, empty) == F.coalesce(hash_run, empty))


def compare_outputs(runs: DataFrame) -> DataFrame:
    return runs.withColumn(
        "outputs_equal", outputs_equal(F.col("original_found"), F.col("outputs_hash_orig"), F.col("outputs_hash_exec"))
    )
