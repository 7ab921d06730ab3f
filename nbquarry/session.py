"""Session settings the operators rely on, and paths in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# allowDuplicateKeys: a repeated JSON key keeps its last value instead of voiding the document.
# maxRecordsPerBatch: sources may be long, so the one Arrow hop uses small batches.
# hugeMethodLimit: the JVM compiles no method above 8,000 bytes; wide projections (a collection has 45 columns) are then
# better not fused into one.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Can only be set when a session is built. Without call-site capture, building a plan of many expressions takes a
# fraction of the time.
BUILD_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to an existing session, and see that its Python workers can import this package."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_nbquarry_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="nbquarry-")) / "nbquarry.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._nbquarry_shipped = True


def scratch_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path under ``folder``, by default the shared folder named by ``spark.checkpoint.dir``.

    Driver and executors must both see that folder, so there is no local one to fall back to.
    """
    base = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share, or name a folder")
    return f"{base.rstrip('/')}/nbquarry/{name}-{uuid.uuid4().hex}"
