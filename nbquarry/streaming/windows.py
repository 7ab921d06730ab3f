"""Window files picked up as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from nbquarry.schema import COLLECTION_SCHEMA, as_text_schema
from nbquarry.sources.tables import type_columns


def read_window_stream(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """New window CSV files under ``path`` as a typed stream, with the file each row came from.

    A file is read by one task; by several with ``multi_line=False``, if no field holds a line break.
    """
    text = (
        spark.readStream.schema(as_text_schema(COLLECTION_SCHEMA))
        .options(header=True, escape='"', multiLine=multi_line, encoding="UTF-8").csv(path)
        .withColumn("window_file", F.col("_metadata.file_path"))
    )
    return type_columns(text, COLLECTION_SCHEMA)


def incremental_windows(spark: SparkSession, path: str, target: str, checkpoint: str, multi_line: bool = True) -> StreamingQuery:
    """Append the rows of files not yet seen to the parquet table ``target``, then stop.

    Rows are appended as they are, so no state and no watermark; the checkpoint remembers which files are done, and a
    restarted job neither repeats nor loses one.
    """
    return (
        read_window_stream(spark, path, multi_line).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    )
