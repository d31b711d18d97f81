"""Balanced label propagation over linked documents.

Documents with equal texts are linked.  Shards start out even; in each round documents
move towards the shard that holds most of their neighbours.  How many may go from which
shard to which is settled for all shards at once, so that those who leave make room for
those who come and full shards swap.  Neighbourhoods are counted per group and shard, never
per pair, and rounds work on these counts alone.  Groups that no swap unites are laid end to
end into the places left, documents without a link after them; counts end at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import SEED, materialise, running
from twinweave.operators.skew import lookup_join


def _filled(counts: DataFrame, n_shards: int, value: str = "n") -> dict[int, int]:
    found = counts.groupBy("shard").agg(F.sum(value).alias("n")).collect()  # at most n_shards rows
    return {s: 0 for s in range(n_shards)} | {r.shard: r["n"] for r in found}


def _by_number(values: list[int], at):
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), at + 1)


def allowed_moves(wanted: dict[tuple, int], room: dict[int, int]) -> dict[tuple, int]:
    """How many of ``wanted[from, to, large]`` rows may move so that no shard overflows.

    A shard takes as many as it has room and as leave it.  Most rows move, those of large
    groups first: the largest circulation through the shards and one node outside (room is
    a way out, a place that nobody takes a way in), found by cancelling cycles that gain.
    """
    out, n = len(room), len(room) + 1
    total = sum(wanted.values())
    edges = [[s, t, n if large else 1, c, (s, t, large)] for (s, t, large), c in sorted(wanted.items())]
    edges += [[s, out, 0, c, None] for s, c in room.items()] + [[out, s, 0, total, None] for s in room]
    flow = [0] * len(edges)
    while True:
        gain, via, last = [0] * n, [None] * n, None
        for _ in range(n):
            last = None
            for e, (s, t, w, c, _key) in enumerate(edges):
                if flow[e] < c and gain[s] + w > gain[t]:
                    gain[t], via[t], last = gain[s] + w, (e, 1, s), t
                if flow[e] > 0 and gain[t] - w > gain[s]:
                    gain[s], via[s], last = gain[t] - w, (e, -1, t), s
            if last is None:
                break
        if last is None:
            return {e[4]: f for e, f in zip(edges, flow) if e[4] and f}
        for _ in range(n):
            last = via[last][2]
        cycle, at = [], last
        while not cycle or at != last:
            cycle.append(via[at][:2])
            at = via[at][2]
        step = min(edges[e][3] - flow[e] if way > 0 else flow[e] for e, way in cycle)
        for e, way in cycle:
            flow[e] += way * step


def _standing(now: DataFrame, least: int, seed: int) -> DataFrame:
    """Per group its size, ``spans`` (shards it needs) and its shards, the fullest first."""
    return now.groupBy("grp").agg(
        F.sum("n").alias("size"),
        F.sort_array(F.collect_list(F.struct(  # at most n_shards entries
            "n", F.xxhash64("grp", "shard", F.lit(seed)).alias("tie"), "shard")), asc=False).alias("held"),
    ).withColumn("spans", F.ceil(F.col("size") / max(1, least)).cast("int"))


def _wants(now: DataFrame, least: int, turn: int, seed: int) -> DataFrame:
    """``(grp, shard, n, want, large, _hash)``: counts outside their group's fullest shards."""
    rest = _standing(now, least, seed + turn).where(F.size("held") > F.col("spans"))
    each = rest.select("grp", "size", "spans", "held", F.posexplode("held").alias("i", "own"))
    target = F.element_at("held", ((F.col("i") + turn) % F.col("spans") + 1).cast("int"))
    return each.where(F.col("i") >= F.col("spans")).select(
        "grp", "own.shard", "own.n", target["shard"].alias("want"),
        (F.col("size") * 8 > least).alias("large"),
        F.xxhash64("grp", F.lit(seed)).alias("_hash"))


def _settle(now: DataFrame, capacity: dict[int, int], seed: int) -> DataFrame:
    """Groups in more shards than they need, laid end to end into the places of all of them."""
    least = min(capacity.values())
    cut = materialise(_standing(now, least, seed).where(F.size("held") > F.col("spans")).select(
        "grp", "size", F.lit(0).alias("_all"), F.xxhash64("grp", F.lit(seed)).alias("_hash")), "cut-groups")
    if cut.isEmpty():
        return now
    whole = materialise(now.join(cut.select("grp"), "grp", "left_anti"), "whole-groups")
    filled = _filled(whole, len(capacity))
    starts, ends = _ends(capacity, filled)
    begin, end = F.col("_at"), F.col("_at") + F.col("size")
    laid = running(cut, ["_all"], ["_hash", "grp"], "_at", value="size").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(len(capacity) - 1)))).withColumn(
        "n", F.least(end, _by_number(ends, F.col("shard")))
        - F.greatest(begin, _by_number(starts, F.col("shard")))).where(F.col("n") > 0)
    return materialise(whole.unionByName(laid.select("grp", "shard", "n")), "settled-groups")


def _ends(capacity: dict[int, int], filled: dict[int, int]) -> tuple[list[int], list[int]]:
    """Where the open places of each shard begin and end when all are numbered in turn."""
    starts, ends, total = [], [], 0
    for s in sorted(capacity):
        starts.append(total)
        total += capacity[s] - filled[s]
        ends.append(total)
    return starts, ends


def propagate(linked: DataFrame, capacity: dict[int, int], rounds: int = 8,
              seed: int = SEED) -> DataFrame:
    """New ``shard`` for ``linked (_row, grp, _hash, shard)`` under ``capacity`` rows a shard.

    A group's rows leave their shards for its fullest one (ties by a hash that changes with
    the round), those of a group larger than a shard for as many of its fullest as it
    needs.  ``allowed_moves`` says how many go; the first groups in hash order do.  A move
    never leaves a group more scattered.  Rounds end when less than a hundredth of the rows
    may move, or with ``rounds``; what is scattered then is laid end to end, which cuts at
    most a group per border of two shards.  Rows of a group are alike: those first in hash
    order take its first shard.
    """
    n_shards, least = len(capacity), min(capacity.values())
    now = materialise(linked.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n")), "shards")
    filled = _filled(now, n_shards)
    for turn in range(rounds):
        wants = materialise(_wants(now, least, turn, seed), "wants")
        wanted = {(r.shard, r.want, r.large): r["n"] for r in wants.groupBy("shard", "want", "large")
                  .agg(F.sum("n").alias("n")).collect()}  # at most 2 n_shards ** 2 rows
        allowed = allowed_moves(wanted, {s: capacity[s] - filled[s] for s in capacity})
        if sum(allowed.values()) * 100 < max(1, sum(filled.values())):
            break
        for (s, t, _), n in allowed.items():  # every quota is used up to its last row
            filled[s] -= n
            filled[t] += n
        quota = _by_number([allowed.get((s, t, large), 0) for s in range(n_shards)
                            for t in range(n_shards) for large in (False, True)],
                           (F.col("shard") * n_shards + F.col("want")) * 2 + F.col("large").cast("int"))
        moves = materialise(
            running(wants, ["shard", "want", "large"], ["_hash", "grp"], "_at", value="n")
            .withColumn("n", F.least(F.col("n"), quota - F.col("_at"))).where(F.col("n") > 0)
            .select("grp", "shard", "want", "n"), "moves")
        now = materialise(
            now.unionByName(moves.select("grp", "shard", (-F.col("n")).alias("n")))
            .unionByName(moves.select("grp", F.col("want").alias("shard"), "n"))
            .groupBy("grp", "shard").agg(F.sum("n").alias("n")).where(F.col("n") > 0), "shards")
    now = _settle(now, capacity, seed)
    held = now.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("held"))
    placed = running(linked.select("_row", "grp", "_hash"), ["grp"], ["_hash", "_row"], "_place")
    # ``_place`` runs through the group's shards: the first whose end lies beyond it.
    passed = F.aggregate("held", F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(-1).alias("shard")),
                         lambda a, x: F.struct(
                             (a["end"] + x["n"]).alias("end"),
                             F.when(F.col("_place") >= a["end"], x["shard"]).otherwise(a["shard"]).alias("shard")))
    return materialise(
        lookup_join(placed, held, ["grp"], ["_row"], min_rows=5_000)
        .select("_row", "grp", "_hash", passed["shard"].alias("shard")), "shards")


def shard_documents(docs: DataFrame, n_shards: int = 8, rounds: int = 8,
                    id_col: str = "doc_id", text_col: str = "text",
                    seed: int = SEED) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, a row per row.

    Law ``rows``: counts of the shards are at most one apart.  ``size`` is the text's
    bytes plus 1 (null: 1), ``text_crc32`` that of its UTF-8 bytes (null: that of none).
    ``slot`` numbers a shard's rows from 0.  Null texts are linked to nothing, empty ones
    to each other.  Repeated rows are copies of each other.
    """
    text = F.col(text_col)
    rows = materialise(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0).cast("bigint")).alias("text_crc32"),
        F.xxhash64(F.when(text.isNotNull(), text), F.octet_length(text)).alias("grp"),
        text.isNull().alias("alone"),
        F.monotonically_increasing_id().alias("_row"),
        F.lit(0).alias("_all"),
    ).withColumn("_hash", F.xxhash64("doc_id", "text_crc32", "_row", F.lit(seed))), "shard-rows")
    n = rows.count()
    capacity = {s: n // n_shards + (s < n % n_shards) for s in range(n_shards)}
    groups = rows.where(~F.col("alone")).groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > 1)
    placed = running(rows, ["_all"], ["_hash", "_row"], "_place")
    linked = placed.where(~F.col("alone")).join(groups, "grp", "left_semi").select(
        "_row", "grp", "_hash", (F.col("_place") % n_shards).cast("int").alias("shard"))
    settled = propagate(linked, capacity, rounds, seed)
    filled = _filled(settled.withColumn("n", F.lit(1)), n_shards)
    free = materialise(rows.join(settled.select("_row"), "_row", "left_anti"), "free")
    # Free rows fill the shards one after the other.
    fill = F.lit(0)
    for end in _ends(capacity, filled)[1][:-1]:
        fill = fill + (F.col("_place") >= end).cast("int")
    names = ["doc_id", "size", "text_crc32", "_row", "_hash", "shard"]
    filler = running(free, ["_all"], ["_hash", "_row"], "_place").withColumn(
        "shard", fill.cast("int"))
    done = materialise(
        rows.join(settled.select("_row", "shard"), "_row").select(*names)
        .unionByName(filler.select(*names)), "sharded")
    return running(done, ["shard"], ["_hash", "_row"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def cut_links(sharded: DataFrame, group: str = "text_crc32") -> DataFrame:
    """One row: rows of groups, and those outside their group's fullest shard."""
    each = sharded.groupBy(group, "shard").agg(F.count(F.lit(1)).alias("n"))
    per = each.groupBy(group).agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1")
    return per.agg(F.sum("n").alias("linked"), F.sum(F.col("n") - F.col("most")).alias("away"))


__all__ = ["allowed_moves", "cut_links", "propagate", "shard_documents"]
