"""Checkpoints in the folder that the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with a checkpoint folder. Its own setting stands; only in local mode, where it may be unset, a folder of this machine is named."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="frameloom-")
        atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return spark


def kept(df: DataFrame) -> DataFrame:
    """The rows written out, so that what uses them several times does not compute them again."""
    prepared(df.sparkSession)
    return df.checkpoint()
