"""CSV files with line breaks in quoted fields, read by several tasks each.

Whether a line break ends a record depends on all quotes before it. So lines are read split by split and marked with
what is known inside their split: the quotes before them, and the record they belong to under either answer to the
question whether the split begins inside a quoted field. The splits of a file are then added up in order, which
answers it for each of them. Records on one line, nearly all, are parsed where they are; only the lines of others are
gathered, by record, across splits if need be.

Marked lines are stored once, as a second scan of the files may be split in other places. Quotes inside quoted fields are
doubled, and other fields have none, as CSV writers see to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from nbquarry.session import scratch_path

# So many splits are broadcast as a list; a longer one is joined.
MOST_LISTED = 1 << 18
_MARKS = "file string, start long, seq long, quotes int, odd boolean, record_if_even long, record_if_odd long, line string"


def mark_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_MARKS`` of the lines ``(line, file, start)`` of splits, one after another.

    ``odd`` tells whether the quotes before the line, in its split, are odd in number. ``record_if_even`` and ``record_if_odd`` number
    the records of the split from 1, if it begins outside or inside of a quoted field; 0 is one begun before it.
    """
    at, seq, before, evens, odds = None, 0, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        line, file, start = batch.columns
        counts = pc.fill_null(pc.count_substring(line, '"'), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = start.to_numpy()
        codes = pc.dictionary_encode(file).indices.to_numpy()
        edges = np.flatnonzero(np.r_[True, (starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])])
        parts: list[tuple[np.ndarray, ...]] = []
        for first, last in zip(edges, np.r_[edges[1:], len(starts)]):
            split = (file[int(first)].as_py(), int(starts[first]))
            if split != at:
                at, seq, before, evens, odds = split, 0, 0, 0, 0
            quotes = counts[first:last]
            odd = (before + np.cumsum(quotes) - quotes) % 2 == 1
            if_even, if_odd = evens + np.cumsum(~odd), odds + np.cumsum(odd)
            parts.append((seq + np.arange(last - first), quotes, odd, if_even, if_odd))
            seq, before, evens, odds = seq + last - first, (before + int(quotes.sum())) % 2, int(if_even[-1]), int(if_odd[-1])
        columns = [np.concatenate(c) for c in zip(*parts)]
        yield pa.record_batch(
            [file, start, pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2]), pa.array(columns[3]), pa.array(columns[4]), line],
            ["file", "start", "seq", "quotes", "odd", "record_if_even", "record_if_odd", "line"],
        )


def _splits(lines: DataFrame) -> DataFrame:
    """``(file, start, inside, owner)``: does a split begin inside a quoted field, and which record was begun last before it?"""
    sums = lines.groupBy("file", "start").agg(
        F.sum("quotes").alias("quotes"), F.max("record_if_even").alias("if_even"), F.max("record_if_odd").alias("if_odd")
    )
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    last = F.when(F.col("inside"), F.col("if_odd")).otherwise(F.col("if_even"))
    begun = F.when(last > 0, F.struct("start", last.alias("record")))
    return inside.withColumn("owner", F.last(begun, ignorenulls=True).over(earlier)).select("file", "start", "inside", "owner")


def csv_records(spark: SparkSession, paths: str | list[str], work: str | None = None) -> DataFrame:
    """``(file, start, record, text)``: the records of CSV files, numbered within the split where they begin. Headers are left out."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    work = work or scratch_path(spark, "csv")
    lines.mapInArrow(mark_lines, _MARKS).write.parquet(work)
    stored = spark.read.parquet(work)
    splits = _splits(stored)
    listed = F.broadcast(splits) if stored.select("file", "start").distinct().count() <= MOST_LISTED else splits
    own = F.when(F.col("inside"), F.col("record_if_odd")).otherwise(F.col("record_if_even"))
    placed = stored.join(listed, ["file", "start"]).withColumn("own", own).select(
        "file", "seq", "line", F.struct("start", "seq").alias("place"),
        F.when(F.col("own") > 0, F.struct("start", F.col("own").alias("record"))).otherwise(F.col("owner")).alias("at"),
        (F.col("odd") == F.col("inside")).alias("begins"), ((F.col("odd") == F.col("inside")) == (F.col("quotes") % 2 == 0)).alias("ends"),
    )
    whole = F.col("begins") & F.col("ends")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x.line), "\n")
    gathered = placed.where(~whole).groupBy("file", "at").agg(text.alias("text"))
    records = placed.where(whole).select("file", "at", F.col("line").alias("text")).unionByName(gathered)
    clean = records.withColumn("text", F.regexp_replace("text", "\r$", "")).where((F.col("text") != "") & ~((F.col("at.start") == 0) & (F.col("at.record") == 1)))
    return clean.select("file", "at.start", "at.record", "text")


def read_csv_in_splits(spark: SparkSession, paths: str | list[str], schema: T.StructType, options: dict[str, object], work: str | None = None) -> DataFrame:
    """Text columns of ``schema``, and ``window_file`` and ``row_order`` (the place in the order of files and of records in them)."""
    plain = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k != "header"}
    names = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    parsed = csv_records(spark, paths, work).withColumn("parsed", F.from_csv("text", names.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), plain))
    return parsed.select("parsed.*", F.col("file").alias("window_file"), F.struct("file", "start", F.col("record").alias("seq")).alias("row_order"))
