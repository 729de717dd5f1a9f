"""Session settings, shared scratch folders and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on.  Nothing here fixes a parallelism: AQE
# sizes the shuffle partitions, so the same job runs on 8 threads or 1000 executors.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; idempotent."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def share_code(spark: SparkSession) -> SparkSession:
    """Python workers started from another folder find the package too; a cluster gets it with --py-files."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where the session runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidegate-")
        spark.sparkContext.setCheckpointDir(root)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    The result has a plan of one scan and survives the loss of any executor; unlike a
    checkpoint, which runs its job twice, the frame is computed once.
    """
    path = scratch(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """Like ``stage_table``, in buckets by a key: a join on it shuffles the other side only."""
    path = scratch(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table, format="parquet")
    return df.sparkSession.table(table)


def one_row(spark: SparkSession) -> DataFrame:
    """A frame of one row in one partition, to select literals from."""
    return spark.range(0, 1, 1, 1)
