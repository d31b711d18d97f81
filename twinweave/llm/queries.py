"""Registered queries of the operators: each over its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.llm.bytepairs import decode_ids, encode_texts, load_vocabulary
from twinweave.llm.chat import chat_digest
from twinweave.llm.collocations import collocations
from twinweave.llm.common import shares_of
from twinweave.llm.language import fit_language, identify_language
from twinweave.llm.mixing import mix_sources, words_taken
from twinweave.llm.neighbours import nearest
from twinweave.llm.packing import pack_documents
from twinweave.llm.search import top_k
from twinweave.llm.sharding import shard_documents
from twinweave.llm.simhash import simhash_groups
from twinweave.llm.toxicity import fit_toxicity, score_toxicity
from twinweave.llm.urlrules import filter_urls
from twinweave.llm.whitening import whitened_components

Query = Callable[[SparkSession, str], DataFrame]
TOXIC_FROM = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document in a sequence of 512 to 4,096 words."""
    return pack_documents(_table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op4_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an id divisible by 50 as queries against all documents."""
    docs = _table(spark, sf_dir, "documents")
    queries = docs.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return top_k(docs, queries).withColumn("score", F.round("score", 6))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_taken(mix_sources(_table(spark, sf_dir, "documents")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = shares_of(F.col("doc_id"), 5, 0)
    langs, net = fit_language(docs, ~held)
    return identify_language(docs, langs, net).select(
        "doc_id", shares_of(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold the template's own strings."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat_digest(turns.unionByName(hard))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, ~shares_of(F.col("doc_id"), 4, 2))
    return score_toxicity(docs, model).select(
        "doc_id", shares_of(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitened_components(_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("bigint"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every whole text encoded and decoded; the vocabulary's path is a parameter."""
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    loaded = load_vocabulary(vocabulary)
    encoded = encode_texts(_table(spark, sf_dir, "documents"), loaded)
    counted = encoded.withColumns({
        "n_tokens": (F.octet_length("ids") / 4).cast("bigint"), "ids_sha256": F.sha2("ids", 256)})
    named = ("doc_id", "n_tokens", "ids_sha256")
    return decode_ids(counted, loaded, named).select(
        *named, F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_best_fit_packing, op2_simhash_dedup, op3_url_filter, op4_exact_search,
        op5_nearest_vectors, op6_source_mix, op7_sharding, op8_language, op9_chat_format,
        op10_toxicity, op11_collocations, op12_whitening, op13_byte_pairs,
    )
}
