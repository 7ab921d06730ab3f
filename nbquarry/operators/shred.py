"""From documents to cell, output, MIME and import tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nbquarry.functions import documents as D
from nbquarry.functions.coerce import to_int
from nbquarry.schema import CELL_FIELDS


def explode_cells(notebooks: DataFrame) -> DataFrame:
    """One row per cell with its 0-based position; undecoded notebooks give none."""
    return notebooks.select("nb_id", F.inline(D.cells_of(notebooks))).select(*CELL_FIELDS)


def explode_outputs(notebooks: DataFrame) -> DataFrame:
    """One row per output of a code cell: ``(nb_id, cell_idx, output_idx, output)``."""
    # One generator for both kinds of documents: a union of two would decode and read every document twice.
    cells = F.transform(
        D.list_items(F.col("doc"), "$.cells"),
        lambda cell, i: F.struct(i.alias("cell_idx"), F.lit(None).cast("int").alias("output_idx"), cell.alias("cell"), F.lit(None).cast("string").alias("json")),
    )
    if "large" in notebooks.columns:
        large = F.transform("large.outputs", lambda o: F.struct(o.cell_idx, o.output_idx, F.lit(None).cast("variant").alias("cell"), o.json))
        cells = F.coalesce(cells, large)
    of_code = F.try_variant_get("cell", "$.cell_type", "string") == "code"
    rows = notebooks.select("nb_id", F.inline(cells)).where(F.col("output_idx").isNotNull() | of_code)
    read = F.array(F.struct("output_idx", D.parse_json(F.col("json")).alias("output")))
    listed = F.transform(D.list_items(F.col("cell"), "$.outputs"), lambda output, i: F.struct(i.alias("output_idx"), output.alias("output")))
    return rows.select("nb_id", "cell_idx", F.inline(F.when(F.col("output_idx").isNotNull(), read).otherwise(listed)))


def explode_mime(outputs: DataFrame) -> DataFrame:
    """One row per MIME type of an output's data."""
    return outputs.select("nb_id", "cell_idx", "output_idx", F.explode(D.mime_keys(F.col("output"))).alias("mime"))


def import_pairs(imports_json: Column) -> Column:
    """Array of ``(pos, module, n)`` from a JSON list of pairs.

    Pairs before the first bad one count, those after it do not; text that is not such a list gives NULL.
    """
    def read(item: Column, pos: Column) -> Column:
        return D.let(D.list_items(item), lambda pair: D.let(F.get(pair, F.lit(1)), lambda count: entry(pos, pair, count)))

    def entry(pos: Column, pair: Column, count: Column) -> Column:
        module = F.get(pair, F.lit(0))
        # A count may be stored as a number, a boolean or integer text.
        as_integer_text = F.when(D.string_value(count).rlike(r"^\s*[+-]?[0-9]+\s*$"), to_int(D.string_value(count)))
        as_number = F.try_variant_get(count, "$", "double").try_cast("bigint")
        n = F.when(D.is_string(count), as_integer_text).otherwise(as_number)
        two_items = F.coalesce(F.array_size(pair) == 2, F.lit(False))
        return F.struct(
            pos.cast("int").alias("pos"),
            F.when(two_items & D.is_string(module), D.string_value(module)).alias("module"),
            F.when(two_items, n).alias("n"),
        )

    def before_first_bad(entries: Column) -> Column:
        bad = F.transform(entries, lambda e: e.module.isNull() | e.n.isNull())
        return D.let(
            F.array_position(bad, F.lit(True)),
            lambda at: F.when(at == 0, entries).when(at > 1, F.slice(entries, 1, (at - 1).cast("int"))),
        )

    return D.let(F.transform(D.list_items(D.parse_json(imports_json)), read), before_first_bad)


def explode_import_counts(collection: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``(row_id, pos, module, n)`` from the ``top_imports_json`` column."""
    # The outer form keeps the optimizer from testing the list for emptiness first, which would parse each text twice.
    pairs = collection.select(row_id, F.inline_outer(import_pairs(F.col("top_imports_json"))))
    return pairs.where(F.col("module").isNotNull())
