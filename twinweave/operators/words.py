"""Rare-word keys: the least frequent words of a value name the blocks it joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinweave.config import ASCII_TOKENS
from twinweave.functions.text import count_words, low_ranks, tokens, value_id, word_bytes
from twinweave.operators.skew import balanced_join, default_tasks, lookup_join
from twinweave.schema import WORD_SEPARATOR
from twinweave.sources.stage import materialise

# Words whose counts every task is told, in some 10 MB, before it hands on any.
KNOWN_WORDS = 500_000


def tokenize(kv: DataFrame, pattern: str = ASCII_TOKENS) -> DataFrame:
    """``(sub, value, word)``, one row per occurrence; ``value`` identifies the text."""
    return kv.select(
        "sub", value_id(F.lower("obj")).alias("value"),
        F.explode_outer(tokens(F.col("obj"), pattern)).alias("word"),
    ).where(F.col("word").isNotNull())


def word_frequency(*sides: tuple[DataFrame, str] | DataFrame) -> DataFrame:
    """``(word, cnt)``: occurrences over all given predicates together."""
    words = []
    for side in sides:
        kv, pattern = side if isinstance(side, tuple) else (side, ASCII_TOKENS)
        held = word_bytes(pattern)
        if held is not None:
            texts = kv.where(F.col("obj").isNotNull()).select(F.lower("obj").alias("text"))
            words.append(texts.mapInArrow(count_words(held), "word string, cnt bigint"))
        else:
            words.append(kv.select(
                F.explode(tokens(F.col("obj"), pattern)).alias("word"), F.lit(1).cast("bigint").alias("cnt")))
    return reduce(DataFrame.unionByName, words).groupBy("word").agg(F.sum("cnt").alias("cnt"))


def commonest(frequency: DataFrame, n: int) -> tuple[pa.Array, np.ndarray]:
    """At most ``n`` of the commonest words, and their counts; what a task is told beforehand."""
    step = F.floor(F.log2("cnt") * 16)
    least, total = None, 0
    for r in sorted(frequency.where(F.col("cnt") > 0).groupBy(step.alias("step")).count().collect(), reverse=True):
        total += r["count"]
        if total > n:
            break
        least = r["step"]
    found = frequency.where(F.lit(False) if least is None else (F.col("cnt") > 0) & (step >= least)).select(
        "word", F.col("cnt").cast("bigint").alias("cnt")).toArrow()
    # A given table may hold a word twice; these are at most n rows.
    found = found.group_by("word", use_threads=False).aggregate([("cnt", "min")])
    return found.column("word").combine_chunks().cast(pa.string()), found.column("cnt_min").to_numpy()


def rare_words(kv: DataFrame, frequency: DataFrame, max_len: int = 1,
               pattern: str = ASCII_TOKENS, keep: tuple[str, ...] = (),
               known_words: int = KNOWN_WORDS, counted: bool = False) -> DataFrame:
    """``(keep..., sub, value, word, cnt)``: the words of the ``max_len`` rarest ranks.

    Words of equal frequency share a rank.  ``frequency`` should be a stage: it is read
    several times.  ``counted`` states that it has every word of ``kv``, once.

    Two measures keep frequent words from dominating the shuffle.  Of the commonest words,
    ``known_words`` at most, every task knows the counts, and of a value's it hands on only
    the ``max_len`` lowest ranks, one less beside rarer words if these are sure to be ``counted``;
    the others are ranked after a join.  Words that still hold
    more than a task's share are spread over tasks.
    """
    if max_len < 1:
        raise ValueError("max_len must be at least 1")
    held = word_bytes(pattern)
    found = F.array_distinct(tokens(F.col("obj"), pattern)) if held is None else F.lower("obj")
    values = kv.where(F.col("obj").isNotNull()).select(
        *keep, "sub", value_id(F.lower("obj")).alias("value"), found.alias("found"))
    words, counts = commonest(frequency, known_words)
    fields = [*values.schema.fields[:-1], T.StructField("word", T.StringType())]
    handed = values.mapInArrow(low_ranks(words, counts, max_len, held, counted), T.StructType(fields))
    joined = lookup_join(
        handed, frequency, ["word"], ["sub", "value"],
        counts=frequency.select("word", F.col("cnt").alias("n")),
        n_tasks=default_tasks(kv.sparkSession),
    )
    # A window holds the words of one value, i.e. of one input cell.
    of_value = Window.partitionBy(*keep, "sub", "value")
    if max_len == 1:
        ranked = joined.withColumn("_first", F.min("cnt").over(of_value))
        kept = ranked.where(F.col("cnt") == F.col("_first"))
    else:
        ranked = joined.withColumn("_rank", F.dense_rank().over(of_value.orderBy("cnt")))
        kept = ranked.where(F.col("_rank") <= max_len)
    return kept.select(*keep, "sub", "value", "word", "cnt")


def rare_word_keys(kv: DataFrame, frequency: DataFrame, max_len: int = 1,
                   pattern: str = ASCII_TOKENS, keep: tuple[str, ...] = (),
                   counted: bool = False) -> DataFrame:
    """``(keep..., sub, key)``, distinct.  A ``sub`` without any token has no row."""
    words = rare_words(kv, frequency, max_len, pattern, keep, counted=counted)
    if max_len == 1:
        return words.select(*keep, "sub", F.col("word").alias("key")).distinct()
    # Words of several ranks pair as rows; a value of very many words is cut by hash.
    of_value = Window.partitionBy(*keep, "sub", "value")
    ranked = materialise(words.withColumns({
        "_low": F.min("cnt").over(of_value), "_high": F.max("cnt").over(of_value)}), "rare-words")
    single = ranked.where(F.col("_low") == F.col("_high")).select(*keep, "sub", F.col("word").alias("key"))
    several = ranked.where(F.col("_low") < F.col("_high"))
    here = [*keep, "sub", "value"]
    first = several.where(F.col("cnt") < F.col("_high")).select(
        *here, F.col("word").alias("_one"), F.col("cnt").alias("_n_one"))
    second = several.where(F.col("cnt") > F.col("_low")).select(
        *here, F.col("word").alias("_two"), F.col("cnt").alias("_n_two"))
    paired = balanced_join(first, second, here, ["_one"], ["_two"]).where(
        F.col("_n_one") < F.col("_n_two"))
    return single.unionByName(paired.select(
        *keep, "sub", F.concat("_one", F.lit(WORD_SEPARATOR), "_two").alias("key"))).distinct()
