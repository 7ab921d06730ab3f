"""Per-notebook metrics from the long cell table (``schema.CELL_FIELDS``).

A notebook's cells may be spread over many partitions, and one notebook may hold a large share of all rows. Counts and
flags are therefore plain aggregates, combined before the shuffle. Order and gaps, which need the sequence, are worked
out on bounded pieces of it first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from nbquarry.functions import marks
from nbquarry.functions.coerce import executed_percent

KEY = "nb_id"
# Cells per piece when the order of execution is checked. Shorter notebooks form a single piece.
PIECE = 4096


def _is(cell_type: str) -> Column:
    return F.col("cell_type") == cell_type


def _executed() -> Column:
    return _is("code") & F.col("execution_count").isNotNull()


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def _type_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_cells_total"),
        F.count_if(_is("code")).alias("n_code"),
        F.count_if(_is("markdown")).alias("n_markdown"),
        F.count_if(_is("raw")).alias("n_raw"),
    ]


def _executed_counts() -> list[Column]:
    executed = F.count_if(_executed())
    return [
        executed.alias("n_code_executed"),
        executed_percent(executed, F.count_if(_is("code"))).alias("percent_code_executed"),
    ]


def _unambiguous() -> list[Column]:
    executed = F.count_if(_executed())
    stored = F.count_if(_is("code") & F.col("execution_count_set"))
    return [((executed > 0) & (executed == stored)).alias("has_unambiguous_order")]


def _max_count() -> list[Column]:
    return [F.coalesce(F.max(F.when(_executed(), F.col("execution_count"))), F.lit(0)).alias("max_execution_count")]


def _with_output() -> list[Column]:
    return [F.count_if(_is("code") & (F.col("n_outputs") > 0)).alias("n_cells_with_output")]


def _output_kind(name: str) -> list[Column]:
    return [_any(_is("code") & marks.OUTPUT_KINDS[name](F.col("mime_types"))).alias(name)]


def _output_error() -> list[Column]:
    return [_any(_is("code") & marks.has_error_output(F.col("output_types"))).alias("outputs_error")]


def _ai() -> list[Column]:
    return [_any(_is("markdown") & marks.mentions_ai(F.col("source"))).alias("ai_marker_found")]


def _fence() -> list[Column]:
    return [_any(_is("code") & marks.has_code_fence(F.col("source"))).alias("triple_backticks_in_code")]


def _absolute_path() -> list[Column]:
    return [_any(_is("code") & marks.has_absolute_path(F.col("source"))).alias("has_abs_data_path")]


def cell_type_counts(cells: DataFrame) -> DataFrame:
    """Cells in total and by type; an unknown type counts only in the total."""
    return cells.groupBy(KEY).agg(*_type_counts())


def executed_cells(cells: DataFrame) -> DataFrame:
    """Code cells with an integer execution count, and their share of code cells in percent."""
    return cells.groupBy(KEY).agg(*_executed_counts())


def unambiguous_order(cells: DataFrame) -> DataFrame:
    """Something ran, and every stored count of a code cell is an integer. Repeated counts are allowed."""
    return cells.groupBy(KEY).agg(*_unambiguous())


def max_execution_count(cells: DataFrame) -> DataFrame:
    return cells.groupBy(KEY).agg(*_max_count())


def cells_with_output(cells: DataFrame) -> DataFrame:
    return cells.groupBy(KEY).agg(*_with_output())


def outputs_error(cells: DataFrame) -> DataFrame:
    return cells.groupBy(KEY).agg(*_output_error())


def output_kind(cells: DataFrame, name: str) -> DataFrame:
    """One of the five MIME flags in ``marks.OUTPUT_KINDS``."""
    return cells.groupBy(KEY).agg(*_output_kind(name))


def ai_markers(cells: DataFrame) -> DataFrame:
    return cells.groupBy(KEY).agg(*_ai())


def backticks_in_code(cells: DataFrame) -> DataFrame:
    return cells.groupBy(KEY).agg(*_fence())


def abs_path_in_code(cells: DataFrame) -> DataFrame:
    return cells.groupBy(KEY).agg(*_absolute_path())


def out_of_order(cells: DataFrame, piece: int = PIECE) -> DataFrame:
    """Some integer count is less than the one before it in document order.

    Neighbours are compared inside pieces of consecutive cells, then the ends of neighbouring pieces. No task sorts more
    than one piece of a long notebook, and the second step sees one row per piece.
    """
    count = F.when(_executed(), F.col("execution_count"))
    light = cells.select(KEY, "cell_idx", F.floor(F.col("cell_idx") / piece).alias("piece"), count.alias("e"))
    in_piece = Window.partitionBy(KEY, "piece").orderBy("cell_idx").rowsBetween(Window.unboundedPreceding, -1)
    steps = light.withColumn("falls", F.col("e") < F.last("e", ignorenulls=True).over(in_piece))
    position = F.when(F.col("e").isNotNull(), F.col("cell_idx"))
    pieces = steps.groupBy(KEY, "piece").agg(
        F.bool_or("falls").alias("falls"), F.min_by("e", position).alias("head"), F.max_by("e", position).alias("tail")
    )
    across = Window.partitionBy(KEY).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    seams = pieces.withColumn("seam_falls", F.col("head") < F.last("tail", ignorenulls=True).over(across))
    return seams.groupBy(KEY).agg((_any(F.col("falls")) | _any(F.col("seam_falls"))).alias("out_of_order"))


def _with_gaps(notebooks: DataFrame, cells: DataFrame) -> DataFrame:
    """Add the two gap metrics to a table with one row per notebook.

    Sorting the counts and adding up gaps equals ``max - min + 1 - distinct``; leaving out gaps that start at the
    minimum equals the same on the counts above the minimum. Counts are made distinct first; the second smallest comes
    from a rank limit that Spark applies before its shuffle.
    """
    counts = cells.where(_executed()).select(KEY, F.col("execution_count").alias("e")).distinct()
    span = counts.groupBy(KEY).agg(F.min("e").alias("lo"), F.max("e").alias("hi"), F.count("e").alias("n"))
    lowest = Window.partitionBy(KEY).orderBy("e")
    second = (
        counts.withColumn("rank", F.row_number().over(lowest)).where("rank <= 2").where("rank = 2")
        .select(KEY, F.col("e").alias("second"))
    )
    joined = notebooks.join(span, KEY, "left").join(second, KEY, "left")
    total = F.col("hi") - F.col("lo") + 1 - F.col("n")
    middle = F.col("hi") - F.col("second") + 1 - (F.col("n") - 1)
    return joined.select(
        *notebooks.columns,
        F.coalesce(total, F.lit(0)).alias("n_skips_total"),
        F.coalesce(middle, F.lit(0)).alias("n_skips_middle"),
    )


def execution_gaps(cells: DataFrame) -> DataFrame:
    """``n_skips_total`` and ``n_skips_middle``."""
    return _with_gaps(cells.select(KEY).distinct(), cells)


def skips_total(cells: DataFrame) -> DataFrame:
    return execution_gaps(cells).select(KEY, "n_skips_total")


def skips_middle(cells: DataFrame) -> DataFrame:
    return execution_gaps(cells).select(KEY, "n_skips_middle")


def cell_metrics(cells: DataFrame) -> DataFrame:
    """Every metric of this module, one row per notebook."""
    plain = reduce(list.__add__, [
        _type_counts(), _executed_counts(), _unambiguous(), _max_count(), _with_output(), _output_error(),
        *[_output_kind(name) for name in marks.OUTPUT_KINDS], _ai(), _fence(), _absolute_path(),
    ])
    return _with_gaps(cells.groupBy(KEY).agg(*plain).join(out_of_order(cells), KEY, "left"), cells)
