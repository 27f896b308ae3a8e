"""Session settings and the shared work area."""

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

SETTINGS = {
    # ISO strings with a zone are shown and cut into dates the same way everywhere.
    "spark.sql.session.timeZone": "UTC",
    # Splits a hot partition when files are written and when tables are joined.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library relies on; all can be set on a live session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_area(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables and stream checkpoints.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``, which every executor
    reaches. Only a local session, which has a single machine, may fall back to a folder of
    its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _local_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="logtarn-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
