"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpointed rows in partitions of the advisory size, since iterative fits read them often."""
    checkpoint_folder(df.sparkSession)
    return df.hint("rebalance").checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Checkpointed rows in the partitions they are in."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *folders: str) -> DataFrame:
    """Rows written once as a table below the checkpoint folder, with a folder for each value of ``folders``: who reads some of these skips the others."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.hint("rebalance", *map(F.col, folders)).write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
