"""Cutting lineage on storage that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    It is what ``spark.checkpoint.dir`` names. A session in local mode without one, as in tests, gets
    a temporary folder; on a cluster that would be another one on each machine, so it raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and return it with its lineage cut.

    The rows go to the reliable checkpoint folder, so a lost executor costs no more than a
    reread. Spark removes them with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and return it read back from compressed columns in the checkpoint folder.

    For rows with texts: they take a fraction of a checkpoint's room, and what is read later is the columns used.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
