"""Collection and run tables: CSV for interchange, parquet for work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from nbquarry.functions.coerce import blank_to_null, integer_text, to_bool, to_float, to_int
from nbquarry.schema import COLLECTION_SCHEMA, RUN_SCHEMA, as_text_schema
from nbquarry.sources.split_csv import read_csv_in_splits

ROWS_PER_FILE = 500_000
# Quotes inside a field are doubled and fields may hold line breaks.
_CSV = {"header": True, "escape": '"', "multiLine": True, "encoding": "UTF-8"}


def read_text_table(
    spark: SparkSession, paths: str | list[str], schema: T.StructType, row_order: bool = False, multi_line: bool = True, split: bool = False,
) -> DataFrame:
    """A CSV as text columns named by ``schema``; empty fields are NULL.

    With ``row_order`` a column of that name follows the order of files and of records within them. Fields may hold line
    breaks, so a file is read by one task. Large files are read by several with ``split``, which finds out where records begin
    (see ``split_csv``), or with ``multi_line=False`` if no field holds a line break.
    """
    if split:
        df = read_csv_in_splits(spark, paths, as_text_schema(schema), _CSV)
        return df.drop("window_file") if row_order else df.drop("window_file", "row_order")
    df = spark.read.options(**_CSV | {"multiLine": multi_line}).schema(as_text_schema(schema)).csv(paths)
    if not row_order:
        return df
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
    )
    return df.withColumn("row_order", place)


def _typed(name: str, dtype: T.DataType, is_text: bool = True) -> Column:
    c = F.col(name)
    if isinstance(dtype, T.BooleanType):
        return F.when(blank_to_null(c).isNotNull(), to_bool(c))
    filled = blank_to_null(c).isNotNull()
    if isinstance(dtype, T.LongType):
        return F.when(filled, F.coalesce(integer_text(c) if is_text else c.try_cast("bigint"), to_int(c)))
    if isinstance(dtype, T.DoubleType):
        return F.when(filled, to_float(c))
    if isinstance(dtype, T.TimestampType):
        return c.try_cast("timestamp")
    return blank_to_null(c)


def type_columns(text: DataFrame, schema: T.StructType, keep_spelling: bool = False) -> DataFrame:
    """Typed columns of ``schema``; what is absent or blank is NULL. Other columns are kept.

    A number that cannot be read is zero, as summaries of the text form take it; times that cannot be read are NULL. With
    ``keep_spelling`` the text of the parse flag stays as ``nb_ok_parse_text``: strict filters go by it.
    """
    present = {f.name: isinstance(f.dataType, T.StringType) for f in text.schema.fields}
    typed = [
        (_typed(f.name, f.dataType, present[f.name]) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    others = [c for c in text.columns if c not in schema.fieldNames()]
    spelled = [F.col("nb_ok_parse").alias("nb_ok_parse_text")] if keep_spelling else []
    return text.select(*typed, *others, *spelled)


def read_collection(
    spark: SparkSession, paths: str | list[str], row_order: bool = False, keep_spelling: bool = False, multi_line: bool = True, split: bool = False,
) -> DataFrame:
    return type_columns(read_text_table(spark, paths, COLLECTION_SCHEMA, row_order, multi_line, split), COLLECTION_SCHEMA, keep_spelling)


def read_runs(
    spark: SparkSession, paths: str | list[str], row_order: bool = False, multi_line: bool = True, split: bool = False
) -> DataFrame:
    return type_columns(read_text_table(spark, paths, RUN_SCHEMA, row_order, multi_line, split), RUN_SCHEMA)


def _as_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return c.cast("string")


def _write(df: DataFrame, path: str, schema: T.StructType, fmt: str) -> None:
    """Columns of ``schema`` in order, replacing what is at ``path``."""
    if fmt == "parquet":
        df.select(*schema.fieldNames()).write.mode("overwrite").parquet(path)
        return
    types = {name: df.schema[name].dataType for name in schema.fieldNames()}
    text = df.select(*[_as_text(F.col(name), dtype).alias(name) for name, dtype in types.items()])
    # A CSV file is read back by one task, so files stay small. White space at the ends of a text is part of it.
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    text.write.mode("overwrite").options(header=True, escape='"', emptyValue="", maxRecordsPerFile=ROWS_PER_FILE, **kept).csv(path)


def write_collection(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(df, path, COLLECTION_SCHEMA, fmt)


def write_collection_by_date(df: DataFrame, path: str) -> None:
    """Parquet in one folder per creation date, so that date filters read only the days they need.

    Rows are regrouped by date before writing; adaptive execution splits dates that are too large for one task and joins
    small ones, so neither a busy day nor many quiet ones make bad files.
    """
    dated = df.select(*COLLECTION_SCHEMA.fieldNames()).withColumn("created_date", F.to_date("repo_created_at"))
    dated.hint("rebalance", F.col("created_date")).write.mode("overwrite").partitionBy("created_date").parquet(path)


def write_runs(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(df, path, RUN_SCHEMA, fmt)


def consolidate_windows(spark: SparkSession, paths: str | list[str], multi_line: bool = True, split: bool = False) -> DataFrame:
    """Many window files as one table, with the file each row came from."""
    if split:
        text = read_csv_in_splits(spark, paths, as_text_schema(COLLECTION_SCHEMA), _CSV).drop("row_order")
    else:
        text = read_text_table(spark, paths, COLLECTION_SCHEMA, multi_line=multi_line).withColumn("window_file", F.col("_metadata.file_path"))
    return type_columns(text, COLLECTION_SCHEMA)
