"""Similarity vectors of pairs.

All features of a side are gathered into one profile per instance, so a pair needs
two joins however many features there are.  Pairs carry only a number per profile;
each distinct pair of profiles is scored once, which is what keeps a large
group of copies from being compared copy by copy.

A profile is one row.  Instances with too many values for that are compared row by
row instead, with the same result, see ``compare_rows``.  Fuzzy value sets are always
compared as rows, see ``fuzzy_matches``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.config import METRICS
from twinweave.functions.similarity import (
    at_most_shared, class_counts, exact_jaccard, first_free, levenshtein_similarity, ratio_grid,
    reaches,
)
from twinweave.functions.text import clean, value_id
from twinweave.operators.skew import TASK_PAIRS, balanced_join, default_tasks, lookup_join
from twinweave.schema import PAIR, SOURCE, TARGET
from twinweave.sources.stage import materialise


@dataclass(frozen=True)
class Attribute:
    """Values compared one by one; ``default`` where a side has none."""

    source: DataFrame
    target: DataFrame
    default: float = 0.0
    ignore: str = ""
    metric: str = "ratio"

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")


@dataclass(frozen=True)
class Relation:
    """Value sets compared by soft Jaccard; ``threshold=1`` is the exact Jaccard."""

    source: DataFrame
    target: DataFrame
    default: float = 0.0
    threshold: float = 0.8


Feature = Attribute | Relation

# Values over all features that a profile row may hold.
PROFILE_VALUES = 2_000
# Rows for the string matcher from which one more task is worth its start.
TASK_MATCHES = 100


def _values(features: list[Feature]) -> DataFrame:
    """``(db, sub, f, val)`` of all features; ``val`` may be NULL for attributes only."""
    parts = []
    for i, feature in enumerate(features):
        for side in PAIR:
            kv = getattr(feature, side)
            if isinstance(feature, Attribute):
                val = clean(F.col("obj"), feature.ignore)
            else:
                kv = kv.where(F.col("obj").isNotNull())
                val = F.lower("obj")
            parts.append(
                kv.select(F.lit(side).alias("db"), "sub", F.lit(i).alias("f"), val.alias("val"))
            )
    return reduce(DataFrame.unionByName, parts)


def _instances_of(pairs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        pairs.select(F.lit(side).alias("db"), F.col(side).alias("sub")).distinct() for side in PAIR])


def _of_paired(values: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values of the instances that stand in a pair, and ``(db, sub, n, h1, h2)`` of them.

    ``n`` and two sums of 64-bit hashes tell values apart, each as often as it occurs.
    """
    paired = materialise(_instances_of(pairs), "paired-instances")
    held = [F.lit("value"), F.col("f"), F.col("val").isNull(), F.col("val")]
    sums = [F.sum(F.xxhash64(*h).cast("decimal(38,0)")) for h in (held, [F.lit("again"), *held])]
    sizes = materialise(
        values.groupBy("db", "sub").agg(
            F.count(F.lit(1)).alias("n"), *[h.alias(f"h{i}") for i, h in enumerate(sums, 1)]
        ).join(paired, ["db", "sub"], "left_semi"), "sizes")
    return lookup_join(values, paired, ["db", "sub"], ["f", "val"], "left_semi", counts=sizes), sizes


def _profiles(values: DataFrame, features: list[Feature]) -> DataFrame:
    """``(db, sub, pid, f0..)`` with one sorted array per feature, NULL when empty."""
    columns = []
    for i, feature in enumerate(features):
        here = F.col("f") == i
        if isinstance(feature, Attribute):
            # Wrapped, because collecting would drop the NULL values.
            held = F.sort_array(F.collect_list(F.when(here, F.struct("val"))))
            held = F.transform(held, lambda v: v["val"])
        else:
            held = F.sort_array(F.collect_set(F.when(here, F.col("val"))))
        columns.append(held.alias(f"f{i}"))
    names = [f"f{i}" for i in range(len(features))]
    return values.groupBy("db", "sub").agg(*columns).select(
        "db", "sub", *[F.when(F.size(n) > 0, F.col(n)).alias(n) for n in names]
    ).withColumn("pid", F.unhex(F.md5(F.to_json(F.struct(*names)))))


def _grid(feature: Attribute, s: Column, t: Column) -> Column:
    """``array<double>``: one similarity per combination of values."""
    default = F.lit(float(feature.default))
    if feature.metric == "ratio":
        same = (F.size(s) == 1) & (F.size(t) == 1) & (s[0] == t[0])
        open_ = s.isNotNull() & t.isNotNull() & ~F.coalesce(same, F.lit(False))
        scored = ratio_grid(F.when(open_, s), F.when(open_, t))
        grid = F.when(F.coalesce(same, F.lit(False)), F.array(F.lit(1.0))).otherwise(scored)
    else:
        one = levenshtein_similarity
        if feature.metric == "equal":
            def one(x, y):
                return (x == y).cast("double")
        grid = F.flatten(F.transform(s, lambda x: F.transform(t, lambda y: one(x, y))))
    filled = F.transform(grid, lambda g: F.coalesce(g, default))
    # A value without a counterpart still counts as a combination.
    n = F.coalesce(F.when(s.isNotNull(), F.size(s)), F.when(t.isNotNull(), F.size(t)), F.lit(1))
    alone = F.array_repeat(default, n)
    return F.when(s.isNull() | t.isNull(), alone).otherwise(filled)


def _overlap(feature: Relation, s: Column, t: Column, matched: Column | None) -> Column:
    """Jaccard of two sets; ``matched`` counts the fuzzy matches of sets that differ."""
    default = F.lit(float(feature.default))
    if matched is None:
        scored = exact_jaccard(s, t)
    else:
        d = F.when(s == t, F.size(s)).otherwise(F.coalesce(matched, F.lit(0)))
        scored = d / (F.size(s) + F.size(t) - d)
    return F.when(s.isNull() | t.isNull(), default).otherwise(scored)


def _dealt_to_match(rows: DataFrame, n: int, by: list[str]) -> DataFrame:
    """``rows``, ``n`` of them, dealt out for the string matcher.

    Their bytes, by which adaptive execution puts tasks together, say little of its work.  Dealt
    by a hash of their own, because the planner drops a repartition that a join has made before.
    """
    most = max(default_tasks(rows.sparkSession), math.ceil(n / TASK_PAIRS))
    tasks = min(most, math.ceil(n / TASK_MATCHES))
    return rows.repartition(tasks, F.xxhash64(*by)) if tasks > 1 else rows


def _is_fuzzy(feature: Feature) -> bool:
    return isinstance(feature, Relation) and feature.threshold < 1.0


def _score_profiles(combos: DataFrame, n: int, features: list[Feature], multi: str) -> DataFrame:
    """``(s_pid, t_pid, f0..)`` from ``n`` rows that hold both profiles.

    An attribute's column is its best combination, or with ``fanout`` all of them in an array.
    """
    names = [f"f{i}" for i in range(len(features))]
    pid = ["s_pid", "t_pid"]
    if any(map(_is_fuzzy, features)):
        combos = materialise(combos, "profile-pairs")
    met = combos
    for i, feature in enumerate(features):
        if not _is_fuzzy(feature):
            continue
        s, t = F.col(f"s{i}"), F.col(f"t{i}")
        open_ = combos.where(s.isNotNull() & t.isNotNull() & (s != t))
        ids = [F.col("s_pid").alias(SOURCE), F.col("t_pid").alias(TARGET)]
        d = fuzzy_matches(
            open_.select(*ids, F.explode(s).alias("x")), open_.select(*ids, F.explode(t).alias("y")),
            feature.threshold,
        ).toDF(*pid, f"d{i}")
        met = met.join(d, pid, "left")
    if any(isinstance(f, Attribute) and f.metric == "ratio" for f in features):
        met = _dealt_to_match(met, n, pid)
    scored = met.select(*pid, *[
        (_grid(f, F.col(f"s{i}"), F.col(f"t{i}")) if isinstance(f, Attribute) else _overlap(
            f, F.col(f"s{i}"), F.col(f"t{i}"), F.col(f"d{i}") if _is_fuzzy(f) else None)).alias(n)
        for i, (f, n) in enumerate(zip(features, names))
    ])
    if multi == "max":
        scored = scored.withColumns({
            n: F.array_max(n) for f, n in zip(features, names) if isinstance(f, Attribute)})
    return scored


def fuzzy_matches(xs: DataFrame, ys: DataFrame, threshold: float) -> DataFrame:
    """``(source, target, d)``: greedy matches of values with a ratio from ``threshold`` on.

    ``xs (source, target, x)`` and ``ys (source, target, y)`` hold distinct values of each
    pair; values are taken in byte order, each ``x`` by its first free ``y``.  Pairs without
    a match are absent.

    A similarity join in a fixed number of stages.  Values meet within a pair by bands of
    length, as 128-bit identities with their length and character counts; both bound the ratio
    from above, so no match is lost.  Of what is left every distinct pair of texts is
    compared once, wherever it occurs.  The greedy choice is one pass over the edges of a
    pair in order, which spills and holds nothing but the taken values.
    """
    # Of two similar texts the longer has at most (2 - threshold) / threshold times the length.
    width = math.log((2.0 - threshold) / threshold) * (1 + 1e-9)
    texts = materialise(
        xs.select(F.col("x").alias("v")).unionByName(ys.select(F.col("y").alias("v"))).distinct()
        .orderBy("v").select(
            value_id(F.col("v")).alias("id"), "v", F.monotonically_increasing_id().alias("at")),
        "texts")

    def narrow(df: DataFrame, name: str) -> DataFrame:
        n = F.length(name)
        band = F.when(n == 0, F.lit(-1)).otherwise(F.floor(F.log(n) / F.lit(width))).cast("int")
        return df.select(
            *PAIR, value_id(F.col(name)).alias(name), n.alias(f"n{name}"),
            class_counts(F.col(name)).alias(f"c{name}"), band.alias("band"))

    here = narrow(xs, "x")
    there = narrow(ys, "y").withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    needed = F.lit(threshold / 2) * (F.col("nx") + F.col("ny")) - F.lit(1e-6)
    near = materialise(
        balanced_join(here, there, [*PAIR, "band"], ["x"], ["y"])
        .where((F.least("nx", "ny") >= needed) & (at_most_shared(F.col("cx"), F.col("cy")) >= needed))
        .select(*PAIR, "x", "y"), "near")
    met = materialise(_counted(near, "x", "y"), "near-texts")
    both = met.select("x", "y")
    for name, other in (("x", "y"), ("y", "x")):
        both = lookup_join(
            both, texts.select(F.col("id").alias(name), F.col("v").alias(f"v{name}"),
                               F.col("at").alias(f"{name}_at")),
            [name], [other], counts=_counted(met, name))
    alike = _dealt_to_match(both, met.count(), ["x", "y"]).where(
        (F.col("x") == F.col("y")) | reaches("vx", "vy", F.lit(float(threshold)))
    ).select("x", "y", "x_at", "y_at")
    edges = lookup_join(near, alike, ["x", "y"], PAIR, counts=met).select(
        *PAIR, F.col("x_at").alias("x"), F.col("y_at").alias("y"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema.fields[:2])
    return edges.repartition(*PAIR).sortWithinPartitions(*PAIR, "x", "y").mapInArrow(
        first_free, f"{types}, d bigint")


def compare(pairs: DataFrame, features: list[Feature], multi: str = "fanout",
            profile_values: int = PROFILE_VALUES) -> DataFrame:
    """``(source, target, sim_v)`` with one element per feature, in the given order.

    Attributes with several values give one row per combination (``fanout``) or the
    best combination per attribute (``max``).
    """
    if multi not in ("fanout", "max"):
        raise ValueError("multi must be 'fanout' or 'max'")
    if not features:
        raise ValueError("at least one feature is needed")
    pairs = materialise(pairs.select(*PAIR), "pairs")
    every = _values(features)
    values, sizes = _of_paired(every, pairs)
    large = sizes.where(F.col("n") > profile_values)
    if large.isEmpty():
        return _compare_profiles(pairs, values, features, multi)

    large = materialise(large.select("db", "sub"), "large-instances")
    tagged = pairs.select(*PAIR)
    for side, other in ((SOURCE, TARGET), (TARGET, SOURCE)):
        found = large.where(F.col("db") == side).select(
            F.col("sub").alias(side), F.lit(1).alias(f"_{side}")
        )
        tagged = lookup_join(
            tagged, found, [side], [other], "left", counts=_counted(pairs, side)
        )
    is_large = F.col("_source").isNotNull() | F.col("_target").isNotNull()
    tagged = materialise(tagged.select(*PAIR, is_large.alias("large")), "tagged-pairs")
    small = lookup_join(values, large, ["db", "sub"], ["f", "val"], "left_anti", counts=sizes)
    return _compare_profiles(
        tagged.where(~F.col("large")).select(*PAIR), small, features, multi
    ).unionByName(
        compare_rows(tagged.where("large").select(*PAIR), every, sizes, features, multi)
    )


def _compare_profiles(pairs: DataFrame, values: DataFrame, features: list[Feature],
                      multi: str) -> DataFrame:
    none = F.lit(-1).cast("bigint")
    profiles = materialise(_profiles(values, features), "profiles")
    names = [f"f{i}" for i in range(len(features))]
    # Pairs of profiles travel as pairs of numbers: their hashes would be most of what is shuffled.
    contents = materialise(
        profiles.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), *[F.any_value(n).alias(n) for n in names])
        .withColumn("no", F.monotonically_increasing_id()), "contents")
    numbered = materialise(lookup_join(
        profiles.select("db", "sub", "pid"), contents.select("pid", "no"), ["pid"], ["db", "sub"],
        counts=contents.select("pid", "n")).select("db", "sub", "no"), "numbered")
    links = pairs.select(*PAIR)
    for side, other, pid in ((SOURCE, TARGET, "s_pid"), (TARGET, SOURCE, "t_pid")):
        ids = numbered.where(F.col("db") == side).select(
            F.col("sub").alias(side), F.col("no").alias(pid)
        )
        links = lookup_join(
            links, ids, [side], [other], "left", counts=_counted(pairs, side)
        ).withColumn(pid, F.coalesce(pid, none))
    links = materialise(links, "links")
    combos = materialise(_counted(links, "s_pid", "t_pid"), "combos")
    both = combos.drop("n")
    for pid, other, prefix in (("s_pid", "t_pid", "s"), ("t_pid", "s_pid", "t")):
        side = contents.select(
            F.col("no").alias(pid), *[F.col(n).alias(prefix + n[1:]) for n in names]
        )
        both = lookup_join(both, side, [pid], [other], "left", counts=_counted(combos, pid))
    scored = materialise(_score_profiles(both, combos.count(), features, multi), "scored").hint("merge")
    vectors = lookup_join(links, scored, ["s_pid", "t_pid"], PAIR, counts=combos).select(*PAIR, *names)
    if multi == "fanout":
        for feature, name in zip(features, names):
            if isinstance(feature, Attribute):
                vectors = vectors.withColumn(name, F.explode(F.col(name)))
    return vectors.select(*PAIR, F.array(*names).alias("sim_v"))


def _counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def compare_rows(pairs: DataFrame, values: DataFrame, sizes: DataFrame, features: list[Feature],
                 multi: str = "fanout") -> DataFrame:
    """``compare`` without gathering the values of an instance anywhere.

    ``sizes`` are those of ``_of_paired``.  Instances of the same values stand for each other,
    so a group of copies costs one comparison here too.
    """
    pairs = materialise(pairs, "row-pairs")
    same = ["db", "size", "h1", "h2"]
    held = materialise(
        _instances_of(pairs).join(sizes.withColumnRenamed("n", "size"), ["db", "sub"], "left")
        .fillna(0, same[1:]), "row-instances")
    firsts = materialise(
        held.groupBy(*same).agg(F.min("sub").alias("first"), F.count(F.lit(1)).alias("n")), "row-firsts")
    named = materialise(lookup_join(
        held, firsts.select(*same, "first"), same, ["sub"], counts=firsts.select(*same, "n")
    ).select("db", "sub", "first"), "row-names")
    linked = pairs
    for side, other in ((SOURCE, TARGET), (TARGET, SOURCE)):
        found = named.where(F.col("db") == side).select(
            F.col("sub").alias(side), F.col("first").alias(f"_{side}"))
        linked = lookup_join(linked, found, [side], [other], counts=_counted(pairs, side))
    linked = materialise(linked.select(*PAIR, *[f"_{side}" for side in PAIR]), "row-links")
    on = [f"_{side}" for side in PAIR]
    combos = materialise(_counted(linked, *on), "row-combos")
    asked = firsts.select("db", F.col("first").alias("sub"))
    scored = materialise(_score_rows(
        combos.select(*[F.col(f"_{side}").alias(side) for side in PAIR]),
        lookup_join(values, asked, ["db", "sub"], ["f", "val"], "left_semi", counts=sizes), features, multi
    ).withColumnsRenamed(dict(zip(PAIR, on))), "row-scored").hint("merge")
    counts = combos.withColumnRenamed("n", "nl").join(
        _counted(scored, *on).withColumnRenamed("n", "nr"), on)
    return balanced_join(linked, scored, on, PAIR, ["sim_v"], counts=counts).select(*PAIR, "sim_v")


def _score_rows(pairs: DataFrame, values: DataFrame, features: list[Feature], multi: str) -> DataFrame:
    """``(source, target, sim_v)`` of distinct ``pairs``, a stage."""
    out = pairs
    for i, feature in enumerate(features):
        name = f"f{i}"
        here = values.where(F.col("f") == i).select("db", "sub", "val")
        if isinstance(feature, Relation):
            out = out.join(_row_overlap(pairs, materialise(here.distinct(), "values"), feature, name), PAIR)
            continue
        held = materialise(here, "values")
        rows = _attach(_attach(pairs, held, SOURCE, "_s"), held, TARGET, "_t").select(
            *PAIR, _grid(feature, F.array("_s"), F.array("_t"))[0].alias(name)
        )
        if multi == "max":
            rows = rows.groupBy(*PAIR).agg(F.max(name).alias(name))
        out = balanced_join(out, rows, PAIR, [*out.columns[2:]] or PAIR, [name])
    names = [f"f{i}" for i in range(len(features))]
    return out.select(*PAIR, F.array(*names).alias("sim_v"))


def _attach(rows: DataFrame, held: DataFrame, side: str, name: str) -> DataFrame:
    """Left join of the values of one side; both sides of a key may be large."""
    values = held.where(F.col("db") == side).select(
        F.col("sub").alias(side), F.col("val").alias(name)
    )
    other = [c for c in rows.columns if c != side]
    met = balanced_join(rows, values, [side], other, [name])
    alone = rows.join(values.select(side).distinct(), side, "left_anti")
    return met.unionByName(alone.withColumn(name, F.lit(None).cast("string")))


def _row_overlap(pairs: DataFrame, held: DataFrame, feature: Relation, name: str) -> DataFrame:
    """``(source, target, name)``: soft Jaccard from matching value pairs only."""
    sizes = {
        side: held.where(F.col("db") == side).groupBy(F.col("sub").alias(side)).agg(
            F.count(F.lit(1)).alias(f"n_{side}"))
        for side in PAIR
    }
    xs = balanced_join(
        pairs, held.where(F.col("db") == SOURCE).select(
            F.col("sub").alias(SOURCE), F.col("val").alias("x")), [SOURCE], [TARGET], ["x"])
    ys = held.where(F.col("db") == TARGET).select(F.col("sub").alias(TARGET), F.col("val").alias("y"))
    if feature.threshold >= 1.0:
        matched = xs.join(ys.withColumnRenamed("y", "x"), [TARGET, "x"], "left_semi")
        found = matched.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("d"))
    else:
        met = balanced_join(pairs, ys, [TARGET], [SOURCE], ["y"])
        found = fuzzy_matches(xs, met.select(*PAIR, "y"), feature.threshold)
    sized = pairs.join(found, PAIR, "left")
    for side, other in ((SOURCE, TARGET), (TARGET, SOURCE)):
        sized = lookup_join(
            sized, sizes[side], [side], [other], "left", counts=_counted(pairs, side)
        )
    d = F.coalesce("d", F.lit(0))
    sim = d / (F.col("n_source") + F.col("n_target") - d)
    return sized.select(*PAIR, F.coalesce(sim, F.lit(float(feature.default))).alias(name))


def attribute_similarity(pairs: DataFrame, source: DataFrame, target: DataFrame,
                         default: float = 0.0, ignore: str = "", metric: str = "ratio",
                         multi: str = "fanout",
                         profile_values: int = PROFILE_VALUES) -> DataFrame:
    """``(source, target, sim)`` for one attribute."""
    feature = Attribute(source, target, default, ignore, metric)
    return compare(pairs, [feature], multi, profile_values).select(*PAIR, F.col("sim_v")[0].alias("sim"))


def relation_similarity(pairs: DataFrame, source: DataFrame, target: DataFrame,
                        default: float = 0.0, threshold: float = 0.8,
                        profile_values: int = PROFILE_VALUES) -> DataFrame:
    """``(source, target, sim)`` for one relation."""
    feature = Relation(source, target, default, threshold)
    return compare(pairs, [feature], profile_values=profile_values).select(*PAIR, F.col("sim_v")[0].alias("sim"))
