"""The corpus pipeline: documents in, packed sequences out.

Each stage gets the documents its predecessor kept and is written as Parquet before the
next one reads it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.llm.common import materialise
from twinweave.llm.language import UNDECIDED, fit_language, identify_language
from twinweave.llm.mixing import mixed_documents
from twinweave.llm.packing import pack_documents
from twinweave.llm.simhash import one_per_group
from twinweave.llm.toxicity import fit_toxicity, score_toxicity

TOXIC_FROM = 0.3
LANGUAGE_FROM = 0.3


KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _guarded(docs: DataFrame, step) -> DataFrame:
    """``step`` of ``docs``, whose other columns travel under names that nothing clashes with."""
    held = {c: f"_held{i}" for i, c in enumerate(docs.columns) if c not in KNOWN}
    named = docs.select(*[F.col(f"`{c}`").alias(held[c]) if c in held else F.col(c) for c in docs.columns])
    return step(named).select(*[F.col(held[c]).alias(c) if c in held else F.col(c) for c in docs.columns])


def _judged(docs: DataFrame, judge, keep) -> DataFrame:
    """Rows of ``docs`` that ``keep`` holds of what ``judge`` says of their texts."""
    kept = tuple(c for c in docs.columns if c != "text")
    return judge(docs, keep=kept, carry_text="_text").where(keep).select(
        *[F.col("_text").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter; a text in a foreign language mostly stays.

    The network learns from the documents' own labels and knows no other language.  With
    four of them the best mean probability is never below 0.25, so ``LANGUAGE_FROM`` is
    hardly above the floor and drops few texts that have a letter, if any.
    """
    langs, net = fit_language(docs, F.lit(True))
    known = (F.col("lang_pred") != UNDECIDED) & (F.col("score") >= LANGUAGE_FROM)
    judge = partial(identify_language, langs=langs, net=net)
    return _guarded(docs, lambda named: _judged(named, judge, known))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose passages make a toxic label as likely as ``TOXIC_FROM``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, F.lit(True))
    judge = partial(score_toxicity, model=model)
    return _guarded(docs, lambda named: _judged(named, judge, F.col("score") < TOXIC_FROM))


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Documents without an id stand back for those with one, but are not lost when their
    group has no other.
    """
    return _guarded(docs, one_per_group)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix of the sources takes them."""
    return _guarded(docs, mixed_documents)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every word of the mixed documents in a training sequence."""
    return pack_documents(docs.select(*[c for c in docs.columns if c in KNOWN]))


STAGES = [
    ("language", keep_known_language),
    ("toxicity", drop_toxic),
    ("near-duplicates", keep_one_per_group),
    ("mixing", mix_to_targets),
    ("packing", pack),
]

# Network, fitted scores and fingerprints are beyond SQL; tests hold stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
