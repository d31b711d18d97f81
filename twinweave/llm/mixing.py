"""Mix sources to target weights in fixed-length blocks of words.

The texts of a source lie end to end and are cut into blocks of ``block`` words.  A source
gets as many slots as its target needs; every slot draws its output shard, so the counts of
a source over the shards are multinomial given its total.  The slots are unfolded from these
counts, shard after shard, and mapped through pseudorandom permutations of the source's block
indexes, one per pass over the source; block contents are joined to the slots by index.
All of it is DataFrame work on sizes and positions; texts stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.llm.common import SEED, materialise, null_safe_join, running, word_count

# Primes near 2**31, so that a multiplier has no divisor in common with a
# smaller number of blocks.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549,
          2147483543, 2147483497)


@dataclass(frozen=True)
class MixParams:
    """``share`` of all words is mixed; no source gives more than ``limit`` times its own."""

    block: int = 128
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    limit: int = 2
    slots_per_shard: int = 4_096
    seed: int = SEED


@dataclass(frozen=True)
class Mix:
    """``sources``: one row per source with size, weight, target, blocks and slots.
    ``counts``: ``(sid, shard, n, first)``, how many slots of a source a shard drew and the
    number of the first.  ``slots``: ``(shard, sid, slot, block)`` of the mix.  ``parts``:
    ``(row_id, doc_id, size, sid, start, block, begin, words)``, which words of which row a
    block holds.
    """

    rows: DataFrame
    sources: DataFrame
    counts: DataFrame
    slots: DataFrame
    parts: DataFrame


def number_of(text: Column) -> Column:
    """32 bits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Targets of ``sizes (source, source_size)``, one row per source.

    Sources in code-point order, null last, take the weights in turn.  ``share`` of all
    words goes by weight; what exceeds ``limit`` times a source is shared again by weight
    among the others until none is above.  With sources in the order in which they reach
    their limit this is one pass: the level is set by the first that stays below.
    """
    rank = Window.orderBy(F.asc_nulls_last("source"))
    weigh = F.element_at(F.array(*[F.lit(w) for w in p.weights]),
                         (F.col("sid") % len(p.weights) + 1).cast("int"))
    rows = sizes.withColumn("sid", F.row_number().over(rank).cast("bigint") - 1).withColumn(
        "weight", weigh
    ).withColumn("most", F.col("source_size") * p.limit)
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(p.share)
             - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("at", F.row_number().over(by_level)).withColumn("level", level)
    below = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("at", "level"))
    return rows.withColumn("first", F.min(below).over(every)).withColumn(
        "target",
        F.least(F.col("most").cast("double"),
                F.coalesce(F.col("first.level"), F.lit(0.0)) * F.col("weight")),
    ).drop("at", "level", "first", "most")


def _with_blocks(targets: DataFrame, p: MixParams) -> DataFrame:
    """Blocks, slots and the permutation of each pass for every source."""
    n = F.ceil(F.col("source_size") / p.block).cast("bigint")
    slots = F.when(F.col("source_size") > 0, F.least(
        n * p.limit, F.round(F.col("target") * n / F.col("source_size")).cast("bigint")
    )).otherwise(F.lit(0).cast("bigint"))
    few = F.when(n < PRIMES[-1], n).otherwise(
        F.raise_error(F.lit("a source has too many blocks: use longer ones")).cast("bigint"))
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    draw = lambda what, e: number_of(F.concat_ws("|", name, F.lit(f"{what}{e}|{p.seed}")))
    prime = F.array(*[F.lit(x).cast("bigint") for x in PRIMES])
    base = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return targets.withColumn("blocks", few).withColumn("slots", slots).withColumn(
        "base", F.coalesce(F.sum("blocks").over(base), F.lit(0))
    ).withColumn("steps", F.array(*[
        F.element_at(prime, (draw("step", e) % len(PRIMES) + 1).cast("int"))
        for e in range(p.limit)
    ])).withColumn("shifts", F.array(*[draw("shift", e) for e in range(p.limit)]))


def _shard_counts(sources: DataFrame, p: MixParams) -> DataFrame:
    """Multinomial counts of each source over the shards; slots draw in runs of bounded length."""
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // p.slots_per_shard))
    run = p.slots_per_shard
    draws = sources.where(F.col("slots") > 0).select(
        "sid", "slots",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / run))).alias("run"),
    ).repartition("sid", "run").select("sid", F.explode(F.sequence(
        F.col("run") * run, F.least(F.col("run") * run + run, "slots") - 1)).alias("draw"))
    shard = F.pmod(F.xxhash64("sid", "draw", F.lit(p.seed)), F.lit(shards)).alias("shard")
    drawn = draws.select("sid", shard).groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(drawn.withColumn("_hash", F.xxhash64("sid", "shard")), "mix-draws")
    return materialise(running(counts, ["sid"], ["shard"], "first", value="n").drop("_hash"), "mix-counts")


def _slots(sources: DataFrame, counts: DataFrame, p: MixParams) -> DataFrame:
    """One row per slot: the slots of a source in a shard follow on each other.

    A shard draws about ``slots_per_shard`` slots over all sources, so no array grows.
    """
    slot = F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot")
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("int")
    index = (F.col("slot") % F.col("blocks") * F.get("steps", turn)
             + F.get("shifts", turn)) % F.col("blocks")
    how = sources.select("sid", "base", "blocks", "steps", "shifts")
    return counts.repartition("sid", "shard").join(how, "sid").select(
        "shard", "sid", "base", "blocks", "steps", "shifts", slot
    ).select("shard", "sid", "slot", (F.col("base") + index).alias("block"))


def mix_sources(docs: DataFrame, p: MixParams = MixParams(), id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source",
                row_id: str | None = None) -> Mix:
    """Plan the mix of all ``docs``; every row belongs to the source it names.

    A null source is a source.  Null and wordless texts have no words and are never
    taken.  Repeated rows are rows of their own.  ``row_id`` names a unique key if the
    caller has one; otherwise rows are told apart by source and position alone.
    """
    key = F.col(row_id) if row_id else F.lit(None).cast("bigint")
    rows = materialise(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), key.alias("row_id"),
    ).withColumn("_hash", number_of(F.concat_ws(
        "|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", F.lit(p.seed)))),
        "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialise(_with_blocks(source_targets(sizes, p), p), "mix-sources")
    counts = _shard_counts(sources, p)
    placed = running(rows, ["source"], ["_hash", "doc_id", "size"], "start", value="size")
    known = null_safe_join(
        placed.where(F.col("size") > 0), sources.select("source", "sid", "base"), ["source"]
    )
    at, end = F.col("start"), F.col("start") + F.col("size")
    cut = known.withColumn("index", F.explode(F.sequence(
        F.floor(at / p.block), F.floor((end - 1) / p.block))))
    low = F.greatest(at, F.col("index") * p.block)
    high = F.least(end, (F.col("index") + 1) * p.block)
    parts = cut.select(
        "row_id", "doc_id", "size", "sid", "start", (F.col("base") + F.col("index")).alias("block"),
        (low - at).alias("begin"), (high - low).alias("words"),
    )
    return Mix(rows, sources, counts, _slots(sources, counts, p), parts)


def mixed_blocks(mix: Mix) -> DataFrame:
    """``(shard, sid, slot, block, row_id, doc_id, size, begin, words)``: what the shards hold.

    Parts are joined to the slots by block index, which no more than ``limit`` slots name.
    """
    # Spark judges the slots by the few sources they unfold from and would broadcast them.
    return mix.slots.select("shard", "slot", "block").hint("merge").join(mix.parts, "block").select(
        "shard", "sid", "slot", "block", "row_id", "doc_id", "size", "begin", "words")


def words_taken(mix: Mix) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row per row of the input."""
    placed = mix.parts.join(mix.slots.select("block", "slot").hint("merge"), "block", "left")
    taken = placed.groupBy("sid", "start", "doc_id", "size").agg(
        F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)).alias("taken")
    )
    info = mix.sources.select("sid", "source", "source_size", "target")
    some = taken.join(info, "sid")
    none = null_safe_join(mix.rows.where(F.col("size") == 0), info, ["source"]).withColumn(
        "taken", F.lit(0).cast("bigint"))
    names = ["doc_id", "size", "source_size", "target", "taken"]
    return some.select(*names).unionByName(none.select(*names))


def mixed_documents(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row per document and pass taken.

    A pass that takes every word keeps the text as it is; otherwise the text is the taken
    words in order with the white space that follows them, and ``n_chars`` is its length.
    """
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-docs")
    mix = mix_sources(numbered, p, row_id="_row")
    taken = mixed_blocks(mix).groupBy("row_id", "size", "begin", "words").agg(
        F.count(F.lit(1)).alias("times"))
    plans = taken.groupBy("row_id", "size").agg(
        F.array_sort(F.collect_list(F.struct("begin", "words", "times"))).alias("pieces")
    )
    turns = plans.withColumn("turn", F.explode(F.sequence(
        F.lit(1), F.array_max(F.transform("pieces", lambda x: x["times"])).cast("int")
    ))).withColumn("pieces", F.filter("pieces", lambda x: x["times"] >= F.col("turn")))
    whole = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda a, x: a + x["words"]) == F.col("size")
    turns = turns.select(F.col("row_id").alias("_row"), F.when(~whole, F.col("pieces")).alias("_pieces"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    some = F.array_join(F.flatten(F.transform(
        "_pieces", lambda x: F.slice(F.col("_words"), (x["begin"] + 1).cast("int"),
                                     x["words"].cast("int")))), "")
    joined = numbered.join(turns, "_row")
    full = joined.where(F.col("_pieces").isNull()).select(*docs.columns)
    part = joined.where(F.col("_pieces").isNotNull()).withColumn("_words", words).withColumn(
        "text", some)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        part = part.withColumn("n_chars", F.char_length("text").cast(kind))
    return full.unionByName(part.select(*docs.columns))
