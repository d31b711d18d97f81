"""Durable hand-over between stages.

A stage is a parquet table in the shared folder of ``spark.checkpoint.dir``.  It
survives lost executors, cuts the lineage, and unlike a cached plan it can be read
back with only the columns the next step needs.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stages; a private one only in local mode without a setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="twinweave-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/twinweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_small(df: DataFrame, by: str) -> DataFrame:
    """Use every core for a scan that has fewer splits than there are cores.

    A large scan is returned as it is, so this never shuffles more than a split's
    worth of data per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, by) if df.rdd.getNumPartitions() < cores else df
