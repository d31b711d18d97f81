"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.sources.stage import materialise

WORD = r"[^\x20\x09-\x0D]+"
SEED = 42


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def crc(doc_id: Column) -> Column:
    """CRC-32 of an id's decimal digits; null for a null id."""
    return F.crc32(doc_id.cast("string"))


def shares_of(held: Column, rest: int, is_rest: int) -> Column:
    """True when the id falls on the held-out remainder; a null id does not."""
    return F.coalesce(crc(held) % rest == is_rest, F.lit(False))


def running(df: DataFrame, keys: list[str], order: list[str], out: str,
            value: str | None = None, spread: str = "_hash", per_chunk: int = 5_000) -> DataFrame:
    """Sum of ``value`` (1 each without it) over the rows before each row of its key.

    Without ``value`` these are gapless positions from 0.  A key of any size is cut into
    chunks by the hash column ``spread``, at most about ``per_chunk`` rows each: chunks are
    summed by themselves and shifted by the chunks before, so no task sorts a whole key.
    Null is a key like any other.  ``df`` is read more than once: pass a stage.
    """
    chunks = max(1, -(-df.count() // per_chunk))
    pieces = df.withColumn("_chunk", F.pmod(F.col(spread), F.lit(chunks)).cast("bigint")).withColumn(
        "_value", F.col(value) if value else F.lit(1).cast("bigint")
    )
    sums = pieces.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return null_safe_join(pieces, starts, [*keys, "_chunk"]).withColumn(
        out, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0))
    ).drop("_chunk", "_start", "_value")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the keys come from ``left``."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k)
                             for k in right.columns])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def smallest_by_hash(df: DataFrame, by: str, hash_col: str, n: int) -> DataFrame:
    """``(by, limit)``: per value of ``by`` the hash that the ``n`` smallest do not exceed.

    One small row per value.  Rows are counted per 16-bit prefix of the hash first; only
    those of the one prefix in which the ``n``-th lies are ranked, so neither many rows of
    a value nor many tasks bring more than a 65,536th of them to one place.
    """
    rows = df.select(by, hash_col).withColumn("_prefix", F.shiftright(hash_col, 48))
    prefixes = rows.groupBy(by, "_prefix").agg(
        F.count(F.lit(1)).alias("_n"), F.max(hash_col).alias("_top"))
    upto = Window.partitionBy(by).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    sums = prefixes.withColumn("_sum", F.sum("_n").over(upto))
    whole = sums.where(F.col("_sum") <= n).groupBy(by).agg(F.max("_top").alias("limit"))
    edge = sums.where((F.col("_sum") > n) & (F.col("_sum") - F.col("_n") < n)).select(
        by, "_prefix", (n - F.col("_sum") + F.col("_n")).alias("_room"))
    ranked = rows.join(F.broadcast(edge), [by, "_prefix"]).withColumn(
        "_r", F.row_number().over(Window.partitionBy(by).orderBy(hash_col)))
    inside = ranked.where(F.col("_r") <= F.col("_room")).groupBy(by).agg(
        F.max(hash_col).alias("limit"))
    return whole.unionByName(inside).groupBy(by).agg(F.max("limit").alias("limit"))


__all__ = [
    "SEED", "WORD", "crc", "materialise", "null_safe_join", "running", "shares_of",
    "smallest_by_hash", "word_count",
]
