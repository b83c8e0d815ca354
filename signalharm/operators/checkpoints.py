"""Reliable checkpoints in the folder the cluster names."""

import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; pick a folder only where it is unset."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
