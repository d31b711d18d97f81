"""Block keys over several levels, unique blocks, and the pairs they give.

Two instances become a pair when at every level their values agree or at least one
of them has no value there (policy ``wildcard``).

Pairs over several levels come from a join by missing pattern: an instance has a bit mask
of the levels it has a value for, and two masks meet by an equi-join on the levels known on
both sides.  No instance is written once per key of the other side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.config import ASCII_TOKENS, MISSING_POLICIES
from twinweave.functions.text import render_key
from twinweave.operators.skew import TASK_PAIRS, balanced_join, load_parts, default_tasks, lookup_join
from twinweave.operators.words import rare_word_keys, word_frequency
from twinweave.schema import MISSING_LEVEL, PAIR, SOURCE, TARGET
from twinweave.sources.stage import materialise

_KEY = ["path", "new_key"]


@dataclass(frozen=True)
class Level:
    """Predicates of both sides for one level; ``max_len=None`` keys on whole values."""

    source: DataFrame
    target: DataFrame
    max_len: int | None = 1
    pattern: str = ASCII_TOKENS
    target_max_len: int | None = None
    target_pattern: str | None = None


@dataclass(frozen=True)
class BlockKeys:
    """Outcome of the levels: ``start (sub, db, path)`` and per level ``(sub, db, new_key)``.

    Both are stages.  Pairs are made from them directly.  What follows is worked out level
    by level, with wildcards written out as keys, when it is first asked for: ``known (sub,
    db, path, new_key)`` and ``missing (sub, db, path)`` of the last level before wildcards,
    and ``unique (source, target, path)``, the one-to-one blocks of all levels.
    """

    start: DataFrame
    values: tuple[DataFrame, ...]
    policy: str

    @cached_property
    def _levels(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        full, unique = self.start, []
        for i, values in enumerate(self.values):
            if i:
                full = materialise(_expand(known, lacking, self.policy), "level-paths")
            known = materialise(
                lookup_join(values, full, ["sub", "db"], ["new_key"]).select(
                    "sub", "db", "path", "new_key"
                ),
                "known",
            )
            lacking = materialise(
                full.join(values.select("sub", "db").distinct(), ["sub", "db"], "left_anti"), "missing"
            )
            unique.append(unique_blocks(known))
        return known, lacking, reduce(DataFrame.unionByName, unique)

    @property
    def known(self) -> DataFrame:
        return self._levels[0]

    @property
    def missing(self) -> DataFrame:
        return self._levels[1]

    @property
    def unique(self) -> DataFrame:
        return self._levels[2]

    @property
    def candidate(self) -> DataFrame:
        """``(sub, db, path)`` with wildcards expanded, as the key table."""
        return _expand(self.known, self.missing, self.policy)

    @property
    def unique_rows(self) -> DataFrame:
        """``(sub, db, key)`` rows of the unique blocks."""
        rows = F.explode(F.array(
            F.struct(F.col(SOURCE).alias("sub"), F.lit(SOURCE).alias("db")),
            F.struct(F.col(TARGET).alias("sub"), F.lit(TARGET).alias("db")),
        ))
        return self.unique.select(rows.alias("row"), "path").select(
            "row.sub", "row.db", render_key(F.col("path")).alias("key")
        )


def key_table(paths: DataFrame) -> DataFrame:
    """``(sub, key, db)`` with rendered keys."""
    return paths.select("sub", render_key(F.col("path")).alias("key"), "db")


def level_values(level: Level) -> DataFrame:
    """``(sub, db, new_key)``, distinct, for both sides of a level."""
    if level.max_len is None:
        sides = [
            kv.select("sub", F.lit(db).alias("db"), F.lower("obj").alias("new_key"))
            for kv, db in ((level.source, SOURCE), (level.target, TARGET))
        ]
        return sides[0].unionByName(sides[1]).where(F.col("new_key").isNotNull()).distinct()
    target_pattern = level.target_pattern or level.pattern
    target_max_len = level.target_max_len or level.max_len
    frequency = materialise(
        word_frequency((level.source, level.pattern), (level.target, target_pattern)),
        "word-frequency",
    )
    source = level.source.withColumn("db", F.lit(SOURCE))
    target = level.target.withColumn("db", F.lit(TARGET))
    if (target_pattern, target_max_len) == (level.pattern, level.max_len):
        keys = rare_word_keys(
            source.unionByName(target), frequency, level.max_len, level.pattern, ("db",), counted=True
        )
    else:
        keys = rare_word_keys(
            source, frequency, level.max_len, level.pattern, ("db",), counted=True
        ).unionByName(rare_word_keys(
            target, frequency, target_max_len, target_pattern, ("db",), counted=True))
    return keys.withColumnRenamed("key", "new_key")


def unique_blocks(known: DataFrame) -> DataFrame:
    """``(source, target, path)`` of keys with exactly one instance on either side."""
    side = {db: F.when(F.col("db") == db, F.col("sub")) for db in PAIR}
    bounds = [f(side[db]).alias(f"{name}_{db}")
              for db in PAIR for name, f in (("lo", F.min), ("hi", F.max))]
    return (
        known.groupBy(*_KEY).agg(*bounds)
        .where((F.col("lo_source") == F.col("hi_source"))
               & (F.col("lo_target") == F.col("hi_target")))
        .select(
            F.col("lo_source").alias(SOURCE), F.col("lo_target").alias(TARGET), _extended()
        )
    )


def _extended() -> Column:
    return F.array_append("path", F.col("new_key")).alias("path")


def _expand(known: DataFrame, missing: DataFrame, policy: str) -> DataFrame:
    parts = [known]
    if policy != "drop":
        parts.append(missing.withColumn("new_key", F.lit(MISSING_LEVEL)))
    if policy == "wildcard":
        facing = F.when(F.col("db") == SOURCE, F.lit(TARGET)).otherwise(F.lit(SOURCE))
        offered = known.select("path", facing.alias("db"), "new_key").distinct()
        parts.append(balanced_join(missing, offered, ["path", "db"], ["sub"], ["new_key"]))
    return reduce(DataFrame.unionByName, parts).select("sub", "db", _extended())


def instances(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(sub, db, path)`` with an empty path: where the level loop starts."""
    sides = [df.select("sub").distinct().withColumn("db", F.lit(db))
             for df, db in ((source, SOURCE), (target, TARGET))]
    return sides[0].unionByName(sides[1]).withColumn("path", F.array().cast("array<string>"))


def block_keys(source: DataFrame, target: DataFrame, levels: list[Level],
               missing: str = "wildcard", prefix: DataFrame | None = None) -> BlockKeys:
    """Run the levels over the instance lists, or over ``prefix (sub, db, path)``."""
    if missing not in MISSING_POLICIES:
        raise ValueError(f"missing must be one of {MISSING_POLICIES}")
    if not levels:
        raise ValueError("at least one level is needed")
    start = instances(source, target) if prefix is None else (
        prefix.select("sub", "db", "path").distinct())
    values = tuple(materialise(level_values(level), "level-values") for level in levels)
    return BlockKeys(materialise(start, "instances"), values, missing)


def partition_keys(source: DataFrame, target: DataFrame, levels: list[Level],
                   missing: str = "wildcard") -> BlockKeys:
    """Coarse keys on whole lower-cased values; use ``candidate`` as a later ``prefix``."""
    whole = [Level(level.source, level.target, None) for level in levels]
    return block_keys(source, target, whole, missing)


def unique_pairs(keys: BlockKeys) -> DataFrame:
    return keys.unique.select(*PAIR).distinct()


def _two_sided(known: DataFrame) -> DataFrame:
    """``(path, new_key, nl, nr)``: one key per distinct set of pairs.

    Keys that hold the same instances on both sides give the same pairs, so one of
    them is enough: a group of copies meets once, not once per rare word.  Sets are
    compared by size and by two sums of 64-bit hashes over both sides, which no repetition cancels.
    """
    hashes = {
        "h1": F.xxhash64("db", "sub"),
        "h2": F.xxhash64(F.lit("again"), "db", "sub"),
    }
    aggregates = [
        F.count(F.when(F.col("db") == db, 1)).alias(n) for db, n in ((SOURCE, "nl"), (TARGET, "nr"))
    ] + [F.sum(h.cast("decimal(38,0)")).alias(name) for name, h in hashes.items()]
    identity = ["nl", "nr", "h1", "h2"]
    return (
        known.groupBy(*_KEY).agg(*aggregates)
        .where((F.col("nl") > 0) & (F.col("nr") > 0))
        .groupBy(*identity).agg(F.min(F.struct(*_KEY)).alias("key"))
        .select("key.path", "key.new_key", "nl", "nr")
    )


def _side(df: DataFrame, db: str) -> DataFrame:
    return df.where(F.col("db") == db).withColumnRenamed("sub", db).drop("db")


def valued(keys: BlockKeys) -> DataFrame:
    """``(sub, db, path, mask, v0..)``: a row per combination of an instance's values.

    ``v<i>`` is null and bit ``i`` of ``mask`` unset where the instance has no value at level i.
    """
    rows = keys.start
    for i, values in enumerate(keys.values):
        named = values.withColumnRenamed("new_key", f"v{i}")
        held = materialise(values.groupBy("sub", "db").agg(F.count(F.lit(1)).alias("n")), "valued-instances")
        n = rows.groupBy("sub", "db").agg(F.count(F.lit(1)).alias("n"))
        known = lookup_join(named, rows, ["sub", "db"], [f"v{i}"], counts=held if i == 0 else n)
        lacking = rows.join(held.select("sub", "db"), ["sub", "db"], "left_anti")
        rows = known.unionByName(lacking.withColumn(f"v{i}", F.lit(None).cast("string")))
        if i + 1 < len(keys.values):
            rows = materialise(rows, "valued")
    bits = [F.when(F.col(f"v{i}").isNotNull(), 1 << i).otherwise(0) for i in range(len(keys.values))]
    return materialise(rows.withColumn("mask", reduce(Column.__add__, bits)), "valued")


def pattern_rows(rows: DataFrame, n: int, policy: str,
                 keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``(sub, db, keep..., path, new_key)`` for the join by missing pattern, and its patterns.

    ``rows`` are those of ``valued`` over ``n`` levels.  A pattern is a source mask and the
    set of levels known on both sides.  Under it a source of that mask meets the targets that
    share just these levels with it; every pair of masks has one pattern, so a pair meets
    under one.  An instance takes part in at most ``2 ** levels`` patterns, however many keys
    the other side has.
    """
    # At most two rows per mask.
    masks = {db: set() for db in PAIR}
    for r in rows.select("db", "mask").distinct().collect():
        masks[r.db].add(r["mask"])
    every = (1 << n) - 1

    def meets(s: int, t: int) -> bool:
        return {"wildcard": True, "null_block": s == t, "drop": s == t == every}[policy]

    patterns: dict[tuple[int, int], set[int]] = {}
    for s in masks[SOURCE]:
        for t in masks[TARGET]:
            if meets(s, t):
                patterns.setdefault((s, s & t), set()).add(t)
    parts = []
    for number, ((s, common), targets) in enumerate(sorted(patterns.items())):
        shared = [F.col(f"v{i}") for i in range(n) if common >> i & 1]
        path = F.concat("path", F.array(F.lit(f"{number}"), *shared[:-1]))
        new_key = shared[-1] if shared else F.lit("")
        for db, held in ((SOURCE, {s}), (TARGET, targets)):
            here = rows.where((F.col("db") == db) & F.col("mask").isin(*held))
            part = here.select("sub", "db", *keep, path.alias("path"), new_key.alias("new_key"))
            # Values of levels that are not shared fall away, and with them repeated rows.
            parts.append(part if held == {common} else part.distinct())
    if not parts:
        return rows.where("false").select("sub", "db", *keep, "path", F.lit("").alias("new_key")), []
    return reduce(DataFrame.unionByName, parts), sorted(patterns)


def _pattern_rows(keys: BlockKeys) -> tuple[DataFrame, list[tuple[int, int]]]:
    return pattern_rows(valued(keys), len(keys.values), keys.policy)


def met_pairs(known: DataFrame, n_workers: int | None) -> DataFrame:
    """Pairs of instances under one key; keys that hold the same instances meet once."""
    counts = materialise(_two_sided(known), "two-sided")
    met = materialise(
        lookup_join(
            known, counts.select(*_KEY), _KEY, ["sub"], "left_semi",
            counts=counts.select(*_KEY, (F.col("nl") + F.col("nr")).alias("n")),
        ),
        "met",
    )
    # As many tasks as the pairs ask for, which can be many more than the rows do.
    total = counts.agg(F.sum(F.col("nl").cast("double") * F.col("nr"))).first()[0] or 0.0
    n_workers = max(n_workers or default_tasks(known.sparkSession), math.ceil(total / TASK_PAIRS))
    pairs = balanced_join(
        _side(met, SOURCE), _side(met, TARGET), _KEY, [SOURCE], [TARGET], n_workers, counts=counts, total=total
    ).select(*PAIR)
    crowded = total > default_tasks(known.sparkSession) * TASK_PAIRS
    return pairs.repartition(n_workers, *PAIR) if crowded else pairs


def candidate_pairs(keys: BlockKeys, n_workers: int | None = None) -> DataFrame:
    """Distinct ``(source, target)`` of all levels, wildcards included, by missing pattern."""
    rows, patterns = _pattern_rows(keys)
    if len(patterns) > 1 or len(keys.values) > 1:
        rows = materialise(rows, "pattern-rows")
    return met_pairs(rows, n_workers).distinct()


def pair_load(keys: BlockKeys, n_workers: int | None = None) -> DataFrame:
    """``(key, nl, nr, load, n_part)`` of the expanded key table, without making pairs.

    Read it before ``candidate_pairs``: wildcards on a large share of the instances
    can ask for more pairs than anyone wants to compare.
    """
    n_workers = n_workers or default_tasks(keys.known.sparkSession)
    at = {db: F.count(F.when(F.col("db") == db, 1)) for db in PAIR}
    counts = keys.known.groupBy(*_KEY).agg(at[SOURCE].alias("nl"), at[TARGET].alias("nr"))
    if keys.policy != "drop":
        lacking = keys.missing.groupBy("path").agg(at[SOURCE].alias("_ms"), at[TARGET].alias("_mt"))
        null_key = lacking.select(
            "path", F.lit(MISSING_LEVEL).alias("new_key"), F.col("_ms").alias("nl"), F.col("_mt").alias("nr"))
        if keys.policy == "wildcard":
            # A key that one side knows is met by the other side's instances without a value.
            counts = counts.join(lacking, "path", "left").select(
                *_KEY,
                (F.col("nl") + F.when(F.col("nr") > 0, F.coalesce("_ms", F.lit(0))).otherwise(0)).alias("nl"),
                (F.col("nr") + F.when(F.col("nl") > 0, F.coalesce("_mt", F.lit(0))).otherwise(0)).alias("nr"))
        counts = counts.unionByName(null_key)
    met = counts.where((F.col("nl") > 0) & (F.col("nr") > 0))
    return load_parts(met, n_workers).select(
        render_key(_extended()).alias("key"), "nl", "nr", "load", "n_part"
    )
