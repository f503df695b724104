"""Cuts of lineage that survive lost executors."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one of spark.checkpoint.dir, which driver and executors share; in one local
    process without that setting, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
    return f"{found.rstrip('/')}/{uuid4().hex}"


def plain_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of two frames with the same partitioning for partitioned so too, and fails if
    adaptive plans have given them different numbers of partitions ("Can't zip RDDs"). This turns that off."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder of spark.checkpoint.dir; in one local process without that
    setting, in a new temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(found)
    return df.checkpoint()


def packed(df: DataFrame) -> DataFrame:
    """df written as a compressed table in the shared folder and read back, for rows of words that a checkpoint
    would write uncompressed."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
