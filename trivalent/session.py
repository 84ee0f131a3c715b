"""Session settings that the library's plans are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on one machine, for tests and the benchmark."""
    builder = SparkSession.builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", memory)
    return builder.config(map=SETTINGS).config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below `spark.checkpoint.dir`, which driver and executors share; Hadoop deletes it when the driver's JVM ends.

    Where the setting is unset, the folder is a temporary one on one machine (as in tests), and an error on a cluster.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='trivalent-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if ":/" not in path:
        path = f"file://{path}"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path
