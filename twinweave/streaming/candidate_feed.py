"""A stream of instances: every micro-batch meets what came before and gives only new pairs.

An instance arrives as one row ``(sub, db, values)``, ``db`` being ``source`` or ``target``
and ``values`` a list of texts per level.  Its keys are appended to a log of standing keys, and
the pairs in which it is the newer half to a log of pairs.  All batches together give the pairs
of one blocking run over all instances, however they were cut: the ranks of words come from
a frequency table that does not change, and a word that is not in it counts as never seen.

What arrives again under an id that already stands is left out: an instance is what it was when
it first came.  Rows of one id within a batch are taken together.  Rows without an id or
of another side take no part.

A batch reads the standing keys once and shuffles only those that it shares; it writes in
proportion to its own instances and pairs.  A batch that is run again starts from the same
versions and replaces what it wrote, so a feed may break off anywhere.  ``root`` and the
checkpoint of the query belong together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from twinweave.config import ASCII_TOKENS, MISSING_POLICIES
from twinweave.operators.blocking import BlockKeys, met_pairs, pattern_rows, valued
from twinweave.operators.words import rare_word_keys, word_frequency
from twinweave.schema import PAIR, PAIRS, SOURCE, TARGET
from twinweave.sources.log import VersionLog
from twinweave.sources.stage import materialise

_KEY = ["path", "new_key"]
ARRIVING = "sub string, db string, values array<array<string>>"


@dataclass(frozen=True)
class FeedLevel:
    """How texts of a level become keys.

    ``frequency (word, cnt)`` gives the ranks of rare words and should be a stored table;
    without it the level keys on whole lower-cased values.
    """

    frequency: DataFrame | None = None
    max_len: int = 1
    pattern: str = ASCII_TOKENS


def key_log(spark: SparkSession, root: str, n_levels: int) -> VersionLog:
    """The standing keys: a row per combination of an instance's values."""
    fields = [T.StructField("sub", T.StringType()), T.StructField("db", T.StringType()),
              T.StructField("path", T.ArrayType(T.StringType())), T.StructField("mask", T.IntegerType())]
    values = [T.StructField(f"v{i}", T.StringType()) for i in range(n_levels)]
    return VersionLog(spark, f"{root}/keys", T.StructType(fields + values))


def pair_log(spark: SparkSession, root: str) -> VersionLog:
    """The pairs found so far; each stands in the version of its newer half."""
    return VersionLog(spark, f"{root}/pairs", PAIRS)


def seed_feed(spark: SparkSession, root: str, n_levels: int) -> None:
    """Write version 0, without instances and pairs."""
    key_log(spark, root, n_levels).seed()
    pair_log(spark, root).seed()


def compact_feed(spark: SparkSession, root: str, n_levels: int, version: int) -> None:
    """Put the versions up to ``version`` together, so that later batches open fewer files."""
    for log in (key_log(spark, root, n_levels), pair_log(spark, root)):
        log.compact(log.read(version), version)


def _level_values(arrived: DataFrame, i: int, level: FeedLevel) -> DataFrame:
    """``(sub, db, new_key)``, distinct, of the instances of a batch."""
    texts: Column = F.get("values", F.lit(i))
    kv = arrived.select("sub", "db", F.explode(texts).alias("obj")).where(F.col("obj").isNotNull())
    if level.frequency is None:
        return kv.select("sub", "db", F.lower("obj").alias("new_key")).distinct()
    here = word_frequency((kv, level.pattern)).select("word")
    known = here.join(level.frequency, "word", "left").select("word", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    return rare_word_keys(
        kv, materialise(known, "batch-words"), level.max_len, level.pattern, ("db",)
    ).withColumnRenamed("key", "new_key")


def batch_keys(batch: DataFrame, standing: DataFrame, levels: list[FeedLevel], missing: str) -> DataFrame:
    """Rows of the key log for the instances of ``batch`` that are not standing yet."""
    usable = batch.where(F.col("sub").isNotNull() & F.col("db").isin(*PAIR))
    # Only names meet the standing ones; texts need not travel while few instances come again.
    again = materialise(
        standing.select("sub", "db").join(usable.select("sub", "db"), ["sub", "db"], "left_semi").distinct(),
        "standing-instances")
    arrived = materialise(usable.join(again, ["sub", "db"], "left_anti"), "arrived")
    start = arrived.select("sub", "db", F.array().cast("array<string>").alias("path")).distinct()
    values = tuple(materialise(_level_values(arrived, i, level), "level-values")
                   for i, level in enumerate(levels))
    return valued(BlockKeys(start, values, missing))


def new_pairs(fresh: DataFrame, standing: DataFrame, n_levels: int, missing: str = "wildcard",
              n_workers: int | None = None) -> DataFrame:
    """Distinct pairs with at least one instance of ``fresh``, by missing pattern.

    Standing rows are cut to the keys of ``fresh`` before they are shuffled.  New sources meet
    all targets and new targets the standing sources, so no pair comes from both.
    """
    both = fresh.withColumn("fresh", F.lit(True)).unionByName(standing.withColumn("fresh", F.lit(False)))
    known, _ = pattern_rows(both, n_levels, missing, ("fresh",))
    asked = materialise(known.where("fresh").select(*_KEY).distinct(), "batch-keys")
    near = materialise(known.join(asked, _KEY, "left_semi"), "near-keys")
    is_source = F.col("db") == SOURCE
    newer_source = near.where(~is_source | F.col("fresh"))
    newer_target = near.where(F.when(is_source, ~F.col("fresh")).otherwise(F.col("fresh")))
    first, second = (met_pairs(rows.drop("fresh"), n_workers) for rows in (newer_source, newer_target))
    return first.unionByName(second).select(SOURCE, TARGET).distinct()


def follow_instances(arriving: DataFrame, levels: list[FeedLevel], root: str, checkpoint: str,
                     missing: str = "wildcard", n_workers: int | None = None) -> StreamingQuery:
    """Start the feed over streaming ``arriving`` and process what is available.

    Batch ``b`` writes version ``b + 1`` of both logs; ``pair_log(...).read`` gives the pairs.
    """
    if missing not in MISSING_POLICIES:
        raise ValueError(f"missing must be one of {MISSING_POLICIES}")
    if not levels:
        raise ValueError("at least one level is needed")

    def apply(batch: DataFrame, batch_id: int) -> None:
        keys = key_log(batch.sparkSession, root, len(levels))
        standing = keys.read(batch_id)
        keys.append(batch_keys(batch, standing, levels, missing), batch_id + 1)
        found = new_pairs(keys.delta(batch_id + 1), standing, len(levels), missing, n_workers)
        pair_log(batch.sparkSession, root).append(found, batch_id + 1)

    return (
        arriving.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
