"""Session settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "twinweave", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; size the rest to the cluster.

    Give ``shuffle_partitions`` about the shuffled bytes divided by 128 MB: adaptive
    execution merges small partitions but never splits the planned number.  On a
    cluster set ``spark.checkpoint.dir`` to a shared folder, which holds the stages.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
