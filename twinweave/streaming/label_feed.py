"""Continuous labelling: every batch of answers updates the labels and the model.

Answers arrive as ``(source, target, is_match, ord)`` files or topic rows; of several
answers for a pair in one batch the one with the largest ``ord`` counts.  The label table
is a log: a micro-batch appends its own label rows as version ``v`` and a reader takes the
newest version of each pair, so what a batch writes grows with its answers and not with the
table.  The model, a row per model, is written whole.  A batch that is run again after a
failure starts from the same previous version and writes the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinweave.operators.labels import check_labels, corrections
from twinweave.operators.learn import ftrl_update
from twinweave.schema import LABELS, MODEL, PAIR
from twinweave.sources.log import VERSION, VersionLog


def label_log(spark: SparkSession, root: str) -> VersionLog:
    return VersionLog(spark, f"{root}/labels", LABELS)


def append_labels(log: VersionLog, new: DataFrame, version: int) -> None:
    """Label rows that replace those of their pairs from ``version`` on."""
    log.append(check_labels(new).dropDuplicates(), version)


def merged_labels(log: VersionLog, version: int) -> DataFrame:
    """The label table at ``version``: of each pair the rows of its newest version.

    Only what came after the last compaction is ranked; the base loses the pairs that came up
    again by an anti join, whose other side is no larger than these answers.
    """
    base, deltas = log.parts(version)
    of_pair = Window.partitionBy(*PAIR)
    newest = deltas.withColumn("_newest", F.max(VERSION).over(of_pair)).where(F.col("_newest") == F.col(VERSION))
    kept = base.join(deltas.select(*PAIR).distinct(), PAIR, "left_anti")
    return kept.unionByName(newest.select(LABELS.fieldNames()))


def compact_labels(log: VersionLog, version: int) -> None:
    """Write the merged table of ``version``, which later reads start from."""
    log.compact(merged_labels(log, version), version)


def _model_path(root: str, version: int) -> str:
    return f"{root}/model/{VERSION}={version}"


def read_version(spark: SparkSession, root: str, kind: str, version: int) -> DataFrame:
    if kind == "labels":
        return merged_labels(label_log(spark, root), version)
    return spark.read.schema(MODEL).parquet(_model_path(root, version))


def seed_versions(labels: DataFrame, model: DataFrame, root: str) -> None:
    """Write version 0, which the first batch starts from."""
    label_log(labels.sparkSession, root).seed(labels)
    model.select(MODEL.fieldNames()).write.mode("overwrite").parquet(_model_path(root, 0))


def follow_labels(answers: DataFrame, scores: DataFrame, root: str, checkpoint: str, dim: int,
                  neg_rate: float = 1.0, seed: int = 0) -> StreamingQuery:
    """Start the feed over streaming ``answers`` and process what is available."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        log = label_log(batch.sparkSession, root)
        last = batch.groupBy(*PAIR).agg(F.max_by("is_match", "ord").alias("is_match"))
        append_labels(log, corrections(last, scores), batch_id + 1)
        model = read_version(batch.sparkSession, root, "model", batch_id)
        ftrl_update(model, log.delta(batch_id + 1), dim, neg_rate, seed).write.mode("overwrite").parquet(
            _model_path(root, batch_id + 1)
        )

    return (
        answers.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
