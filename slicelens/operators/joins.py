"""Materialising and joining tables without assuming that a side is small."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        # local[n] is one machine; local-cluster stands for several.
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = os.path.join(tempfile.gettempdir(), "slicelens-checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own part of the shared folder, which goes when it ends."""
    context = spark.sparkContext
    own = f"{shared_folder(spark).rstrip('/')}/slicelens/{context.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        store.mkdirs(path)
        store.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read back.

    For tables that later steps read more than once, a few columns each, or
    whose size the planner should know.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a one-row-per-key table to a large table whose keys may be skewed.

    The key table is staged, so the planner knows its bytes: under
    ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast and the large side
    is not shuffled; beyond, skewed partitions are split while the query runs.
    """
    return df.join(stage(dim, "keys"), keys, how)
