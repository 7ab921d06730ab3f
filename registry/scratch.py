"""Where checked queries put the files they write and read back."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import SparkSession

from nbquarry.session import scratch_path as in_folder


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="registry-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; on one machine without that setting, in a temporary one."""
    local = spark.sparkContext.master.startswith("local[") and not spark.conf.get("spark.checkpoint.dir", None)
    return in_folder(spark, name, _local_folder() if local else None)
