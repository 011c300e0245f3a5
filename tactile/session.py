"""Session helpers: where lineage is cut, and settings the operators like."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings for sessions this repository starts itself (tests, bench). Operators never change
# the settings of a session they are given.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Frames are wide rows: few per Arrow batch keeps Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``. Only a single machine (a local master, as in
    tests) gets a temporary one where it is unset: executors elsewhere would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root is None:
        root = context.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for tables a query writes on its way. They are read
    lazily, so they stay until the folder is cleared, as checkpoints do."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage, so that lost executors cannot change it."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run. Once per context."""
    context = spark.sparkContext
    if getattr(context, "_tactile_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tactile")
    context.addPyFile(
        shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))
    )
    context._tactile_shipped = True
