"""Tables stored by notebook, which join without being shuffled.

A table is written in buckets of its key, one sorted file each, so two such tables with the same number of buckets meet file
by file. A bucket is one task, and cannot be split; rows of keys with too many of them are therefore kept apart, and
joined by dealing them to several tasks (``operators.joins``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nbquarry.operators.joins import PART_ROWS, heavy_buckets, key_bucket, left_join_unique

NOTEBOOK = ["repo_full_name", "file_path"]


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, keys: list[str] = NOTEBOOK, part_rows: int | None = PART_ROWS) -> None:
    """``df`` as the table ``table`` with its files under ``path``; rows of keys with more than ``part_rows`` rows go to ``table_hot``.

    Without ``part_rows`` nothing is kept apart: for tables with one row per key.
    """
    spread = df
    if part_rows is not None:
        heavy = F.broadcast(heavy_buckets(df, keys, part_rows).select("_bucket"))
        placed = df.withColumn("_bucket", key_bucket(keys))
        hot = placed.join(heavy, "_bucket", "left_semi").drop("_bucket")
        hot.write.mode("overwrite").option("path", f"{path}/hot").saveAsTable(f"{table}_hot")
        spread = placed.join(heavy, "_bucket", "left_anti").drop("_bucket")
    spread.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").option("path", f"{path}/cold").saveAsTable(table)


def join_bucketed(spark: SparkSession, left: str, right: str, spread_by: list[str], keys: list[str] = NOTEBOOK, part_rows: int = PART_ROWS) -> DataFrame:
    """Each row of the table ``left`` (with ``left_hot``) with the columns of ``right``, which has one row per key, NULL where there is none."""
    cold = spark.table(left).join(spark.table(right).hint("merge"), keys, "left")
    hot = left_join_unique(spark.table(f"{left}_hot"), spark.table(right), keys, spread_by, part_rows=part_rows)
    return cold.unionByName(hot)
