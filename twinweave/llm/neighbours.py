"""Approximate nearest neighbours by multiprobe p-stable hashing.

Directions of vectors are projected on Gaussian lines and cut into intervals; ``hashes``
intervals name a bucket of one of ``tables`` tables.  A query visits its own bucket and
those reached by stepping over interval borders, in the order of their estimated chance of
success, which falls with the summed squared distance to the borders crossed.  Buckets
are met by an equi-join; each meeting hands on its best few by exact cosine, and the
tables' candidates are merged.  Equal vectors are one entry with their smallest ids, so a
group of copies costs one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinweave.llm.common import SEED, materialise


@dataclass(frozen=True)
class LshParams:
    """``fit_rows`` and ``fit_queries`` bound the sample on which probes are chosen."""

    k: int = 5
    tables: int = 8
    hashes: int = 6
    width: float = 2.0
    recall: float = 0.96
    fit_rows: int = 4_096
    fit_queries: int = 128
    fit_least: int = 256
    index_cell: int = 8_192
    query_cell: int = 1_024
    seed: int = SEED


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest part, so nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Hasher:
    """Intervals and probes for vectors of one length."""

    def __init__(self, dim: int, p: LshParams):
        rng = np.random.default_rng([p.seed, dim])
        self.p, self.dim = p, dim
        self.lines = rng.normal(size=(dim, p.tables * p.hashes))
        self.shift = rng.uniform(0, p.width, p.tables * p.hashes)
        self.mix = rng.integers(1, 2**63 - 1, p.hashes, np.int64).view(np.uint64) | np.uint64(1)
        self.steps = np.array(list(product((0, -1, 1), repeat=p.hashes)))

    def places(self, x: np.ndarray) -> np.ndarray:
        at = (unit(x) @ self.lines + self.shift) / self.p.width
        return at.reshape(len(x), self.p.tables, self.p.hashes)

    def names(self, cells: np.ndarray, table: np.ndarray) -> np.ndarray:
        """64-bit bucket names; a collision only merges two buckets."""
        with np.errstate(over="ignore"):
            h = (cells.astype(np.int64).view(np.uint64) * self.mix).sum(axis=-1, dtype=np.uint64)
            h += table.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.dim)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return h.view(np.int64)

    def own(self, x: np.ndarray) -> np.ndarray:
        cells = np.floor(self.places(x)).astype(np.int64)
        return self.names(cells, np.broadcast_to(np.arange(self.p.tables), cells.shape[:2]))

    def order(self, places: np.ndarray) -> np.ndarray:
        """Per place the steps by falling estimated success: (rows, tables, steps)."""
        inside = places - np.floor(places)
        down, up = inside**2, (1 - inside) ** 2
        cost = down @ (self.steps == -1).T + up @ (self.steps == 1).T
        return np.argsort(cost, axis=-1, kind="stable")

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        places = self.places(x)
        steps = self.steps[self.order(places)[..., :n]]
        cells = np.floor(places).astype(np.int64)[:, :, None] + steps
        return self.names(cells, np.broadcast_to(
            np.arange(self.p.tables)[None, :, None], cells.shape[:3]))


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long float lists as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def choose_probes(x: np.ndarray, p: LshParams) -> int:
    """Fewest probes that find the sample's own neighbours at the recall asked for."""
    x = unit(x)
    if len(x) < 2:
        return 1
    h = Hasher(x.shape[1], p)
    q = x[:p.fit_queries]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -2
    top = np.argsort(-near, axis=1)[:, :min(p.k, len(x) - 1)]
    places, cells = h.places(q), np.floor(h.places(x)).astype(np.int64)
    order = h.order(places)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[-1])[None, None], axis=-1)
    code = {tuple(s): i for i, s in enumerate(h.steps)}
    first = []
    for i, hits in enumerate(top):
        for j in hits:
            apart = cells[j] - np.floor(places[i]).astype(np.int64)
            first.append(min((rank[i, t, code[tuple(a)]] for t, a in enumerate(apart)
                              if np.abs(a).max() <= 1), default=len(h.steps)))
    need = int(np.quantile(np.array(first), p.recall, method="higher")) + 1
    return max(1, min(need, len(h.steps)))


def _buckets(p: LshParams, probes: dict[int, int] | int | None):
    """Rows of ``(id, vec)`` once per bucket: own buckets, or the probed ones.

    ``probes`` may differ by length; lengths it does not name get all probes.
    """
    def some(dim: int) -> int:
        return probes.get(dim, 3 ** p.hashes) if isinstance(probes, dict) else probes

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(lengths):
                    part = pa.Table.from_batches([batch]).filter(pa.array(lengths == dim))
                    part = part.combine_chunks().to_batches()[0]
                    h = hashers.setdefault(int(dim), Hasher(int(dim), p))
                    x = matrix(part.column(1))
                    names = (h.own(x) if probes is None else h.probes(x, some(int(dim)))).reshape(len(x), -1)
                    take = pa.array(np.repeat(np.arange(len(x)), names.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names.ravel()), part.column(0).take(take),
                         part.column(1).take(take)], names=["bucket", "id", "vec"])

    return emit


def best_pairs(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, index rows and exact cosines of each query's best ``k``, ties included."""
    qs, xs, scores = [], [], []
    ux = unit(x)
    for a in range(0, len(q), 128):
        uq = unit(q[a:a + 128])
        near = uq @ ux.T
        least = np.full(len(uq), -2.0) if near.shape[1] <= k else np.partition(
            near, -k, axis=1)[:, -k]
        i, j = np.nonzero(near >= least[:, None] - 1e-9)
        qs.append(i + a)
        xs.append(j)
        scores.append((uq[i] * ux[j]).sum(axis=1))
    return np.concatenate(qs), np.concatenate(xs), np.concatenate(scores)


def _meet(k: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            ask = rows.column("asks").to_numpy()
            if ask.all() or not ask.any():
                return
            q, x = rows.filter(pa.array(ask)), rows.filter(pa.array(~ask))
            one = lambda t: t.column("vec").combine_chunks()
            i, j, s = best_pairs(matrix(one(q)), matrix(one(x)), k)
            yield pa.RecordBatch.from_arrays(
                [q.column("id").combine_chunks().take(pa.array(i)),
                 x.column("id").combine_chunks().take(pa.array(j)), pa.array(s)],
                names=["qid", "cid", "score"])

        held, last = [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
            cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                if a == b:
                    continue
                if held and not np.array_equal(key[a], last):
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                last = key[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return meet


def _met(index: DataFrame, probe: DataFrame, p: LshParams) -> DataFrame:
    """``(qid, cid, score)``: the best of every bucket that a query visits.

    Both sides are ``(bucket, id, vec)``; large buckets are cut into a grid of cells.
    """
    cells = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("nx")).join(
        probe.groupBy("bucket").agg(F.count(F.lit(1)).alias("nq")), "bucket").select(
        "bucket", F.ceil(F.col("nx") / p.index_cell).cast("int").alias("a"),
        F.ceil(F.col("nq") / p.query_cell).cast("int").alias("b"))
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["bucket", "i", "j", "asks", "id", "vec"]
    left = index.join(cells, "bucket").withColumn("i", F.pmod(F.xxhash64("id"), F.col("a")).cast("int")) \
        .withColumn("j", steps("b")).withColumn("asks", F.lit(False)).select(*names)
    right = probe.join(cells, "bucket").withColumn("j", F.pmod(F.xxhash64("id"), F.col("b")).cast("int")) \
        .withColumn("i", steps("a")).withColumn("asks", F.lit(True)).select(*names)
    met = left.unionByName(right).repartition("bucket", "i", "j").sortWithinPartitions(
        "bucket", "i", "j").mapInArrow(_meet(p.k + 1), "qid bigint, cid bigint, score double")
    return met.groupBy("qid", "cid").agg(F.max("score").alias("score"))


def _ranked(who: DataFrame, pairs: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """``(query_id, qid, rank, vec_id, score)``: the first ``k`` of each query, not itself."""
    by_id = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = pairs.join(entries.select(F.col("id").alias("cid"), F.explode("ids").alias("vec_id")), "cid") \
        .groupBy("qid", "vec_id").agg(F.max("score").alias("score")) \
        .withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= k + 1)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return who.join(found.drop("_r"), "qid").where(F.col("query_id") != F.col("vec_id")).withColumn(
        "rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query, p: LshParams = LshParams(), id_col: str = "vec_id",
            vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest found, by cosine.

    ``is_query`` is a condition on ``vec_id``.  Ties go to the smaller id; a query is never
    its own neighbour.  Null ids and vectors that are null, empty, zero or hold a null or
    non-finite part take no part; vectors meet only those of their own length.  Repeated
    rows count once.  Without candidates a query has no row; one for which the buckets hold
    fewer than it could have meets all vectors of its length, in blocks.
    """
    vec = F.col(vector_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = materialise(vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
    ).where(F.forall("vec", fine) & F.exists("vec", lambda x: x != 0)), "vectors")
    # The smallest k + 1 ids of a vector are all of its ids that can be among the nearest.
    order = Window.partitionBy("vec").orderBy("vec_id")
    entries = materialise(
        valid.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= p.k + 1)
        .groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
        .withColumn("id", F.monotonically_increasing_id()), "vector-entries")
    asked = valid.where(is_query(F.col("vec_id"))).distinct()
    queries = materialise(asked.groupBy("vec").count().select(
        "vec", F.monotonically_increasing_id().alias("id")), "vector-queries")
    if probes is None:
        sample = entries.select("vec").orderBy(F.xxhash64("vec", F.lit(p.seed))).limit(p.fit_rows)
        rows = [r.vec for r in sample.collect()]
        by_length: dict[int, list] = {}
        for r in rows:
            by_length.setdefault(len(r), []).append(r)
        # Lengths of too few sampled vectors get all probes.
        probes = {dim: choose_probes(np.array(held), p) for dim, held in by_length.items()
                  if len(held) >= p.fit_least}
    kind = "bucket bigint, id bigint, vec array<double>"
    index = entries.select("id", "vec").mapInArrow(_buckets(p, None), kind)
    probe = queries.select("id", "vec").mapInArrow(_buckets(p, probes), kind)
    index, probe = materialise(index, "lsh-index"), materialise(probe, "lsh-probes")
    who = materialise(asked.join(queries.withColumnRenamed("id", "qid"), "vec").select(
        F.col("vec_id").alias("query_id"), "qid", F.size("vec").alias("dim")), "vector-asked")
    pairs = materialise(_met(index, probe, p), "vector-pairs")
    found = _ranked(who, pairs, entries, p.k)
    # Queries with fewer neighbours than candidates allow meet all vectors of their length.
    held = valid.groupBy(F.size("vec").alias("dim")).agg(F.countDistinct("vec_id").alias("_held"))
    short = materialise(
        who.join(found.groupBy("query_id", "qid").agg(F.count(F.lit(1)).alias("_n")), ["query_id", "qid"], "left")
        .join(held, "dim").where(F.coalesce("_n", F.lit(0)) < F.least(F.lit(p.k), F.col("_held") - 1))
        .select("qid").distinct(), "vector-short")
    if not short.isEmpty():
        whole = F.size("vec").cast("bigint").alias("bucket")
        asks = queries.join(short.withColumnRenamed("qid", "id"), "id", "left_semi")
        exact = _met(entries.select(whole, "id", "vec"), asks.select(whole, "id", "vec"), p)
        pairs = pairs.join(short, "qid", "left_anti").unionByName(exact)
        found = _ranked(who, pairs, entries, p.k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
