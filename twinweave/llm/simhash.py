"""SimHash near-duplicates: 64-bit fingerprints and exact linking within a radius.

Fingerprints are made inside Arrow batches.  Only distinct fingerprints are compared, so
a group of copies costs one.  Two fingerprints at most ``radius`` bits apart agree in one
of ``radius + 1`` equal bands; distinct fingerprints are therefore dealt by band value, and
the rows that share one are compared tile by tile: exclusive-or and bit counts over the
whole tile pair, leaving out pairs whose population counts differ by more than the
radius.  A band value with many fingerprints is cut into tiles of one population count
each, and every pair of tiles that may hold a link becomes a task group of its own; none
is left out.  A group hands on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import SEED, materialise
from twinweave.llm.components import connected_components

SHINGLE = 3
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CHUNK = 1 << 15
TILE = 512


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the 3-word shingles, repeats included.

    A-Z are lower-cased and words are runs without ASCII white space.  A text of fewer
    words is one shingle; a null text or one without a word has fingerprint zero.
    """
    words = text.encode("utf-8", "replace").translate(LOWER).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        return int(np.uint64(xxhash.xxh64_intdigest(line, SEED)).astype(np.int64))
    lengths = [len(w) for w in words]
    starts = list(accumulate((x + 1 for x in lengths), initial=0))
    ends = [s + x for s, x in zip(starts[SHINGLE - 1:], lengths[SHINGLE - 1:])]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        m = min(CHUNK, n - i)
        h = np.fromiter(
            (digest(line[a:b], SEED) for a, b in zip(starts[i:i + m], ends[i:i + m])), "<u8", m
        )
        bits = np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(prints, pa.int64())],
            names=["doc_id", "row_key", "fp"],
        )


def forest(values: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Root index of every value: a spanning forest of the links of one group.

    ``side`` tells tiles apart when a group is a pair of tiles (values other than its
    first one); a group of one kind is compared with itself.
    """
    order = np.lexsort((values, np.bitwise_count(values)))
    v, s = values[order], side[order]
    two = s.min() != s.max()
    count = np.bitwise_count(v).astype(np.int16)
    root = np.arange(len(v))
    for i in range(0, len(v), TILE):
        a = v[i:i + TILE]
        for j in range(i, len(v), TILE):
            if count[j] - count[min(i + TILE, len(v)) - 1] > radius:
                break
            near = np.bitwise_count(a[:, None] ^ v[None, j:j + TILE]) <= radius
            if two:
                near &= s[i:i + TILE, None] != s[None, j:j + TILE]
            x, y = np.nonzero(np.triu(near, 1) if i == j else near)
            x, y = x + i, y + j
            while len(x):
                p, q = root[x], root[y]
                open_ = p != q
                x, y, p, q = x[open_], y[open_], p[open_], q[open_]
                if not len(x):
                    break
                np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
                while not np.array_equal(up := root[root], root):
                    root = up
    back = np.empty(len(v), np.int64)
    back[order] = order[root]
    return back


def _linker(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
            bounds = np.concatenate([[0], cuts, [len(rows)]])
            us, vs = [], []
            for b in np.flatnonzero(np.diff(bounds) > 1):
                part = rows[bounds[b]:bounds[b + 1]]
                fps = np.ascontiguousarray(part[:, 3])
                root = forest(fps.view(np.uint64), part[:, 2], radius)
                moved = np.flatnonzero(root != np.arange(len(root)))
                us.append(fps[moved])
                vs.append(fps[root[moved]])
            cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(cat(us)), pa.array(cat(vs))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            held.append(rows)
            last = rows[-1, :2]
            same = np.flatnonzero(np.any(rows[:, :2] != last, axis=1))
            cut = same[-1] + 1 if len(same) else 0  # the batch's last group may go on
            if cut:
                done = np.concatenate([*held[:-1], rows[:cut]])
                held = [rows[cut:]]
                yield edges(done)
        if held:
            yield edges(np.concatenate(held))

    return link


def links(distinct: DataFrame, radius: int = 3, most: int = 4_096) -> DataFrame:
    """``(u, v)``: edges that connect exactly the values of ``fp`` within ``radius`` bits.

    ``fp`` must hold distinct values.  ``most`` bounds a tile, not the work: band values
    with more rows are met as pairs of tiles.
    """
    bands = radius + 1
    width = 64 // bands
    mask = F.lit((1 << width) - 1).cast("bigint")
    band = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("b"),
                 F.shiftrightunsigned("fp", i * width).bitwiseAND(mask).alias("value"))
        for i in range(bands)
    ])
    rows = distinct.select(
        "fp", F.bit_count("fp").cast("int").alias("pop"), F.inline(band)
    ).withColumn("cell", F.col("b") * (1 << width) + F.col("value")).drop("b", "value")
    pops = rows.groupBy("cell", "pop").agg(F.count(F.lit(1)).alias("n"))
    cells = pops.groupBy("cell").agg(
        F.sum("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct(
            "pop", F.ceil(F.col("n") / most).cast("int")))).alias("tiles"),
    ).where(F.col("n") > 1).select(
        "cell", F.when(F.col("n") > most, F.col("tiles")).alias("tiles")
    )
    # Tile (p, i) meets tile (q, j) when p and q differ by at most the radius.
    tile = (F.col("pop") * F.lit(1 << 20)
            + F.pmod(F.xxhash64("fp"), F.element_at("tiles", F.col("pop")))).cast("bigint")
    partners = F.flatten(F.transform(
        F.filter(F.map_keys("tiles"), lambda q: F.abs(q - F.col("pop")) <= radius),
        lambda q: F.transform(
            F.sequence(F.lit(0), F.element_at("tiles", q) - 1),
            lambda j: (q * F.lit(1 << 20) + j).cast("bigint"),
        ),
    ))
    dealt = rows.join(cells, "cell").withColumn(
        "tile", F.when(F.col("tiles").isNull(), F.lit(0).cast("bigint")).otherwise(tile)
    ).withColumn(
        "other", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0).cast("bigint")))
                           .otherwise(partners))
    ).select(
        "cell",
        (F.least("tile", "other") * F.lit(1 << 31) + F.greatest("tile", "other")).alias("meet"),
        "tile", "fp",
    )
    found = (
        dealt.repartition("cell", "meet").sortWithinPartitions("cell", "meet")
        .mapInArrow(_linker(radius), "u bigint, v bigint")
    )
    return found.distinct()


def row_key(id_col: str, text_col: str) -> Column:
    """Hash of a row's id and text, whole; a null text differs from an empty one."""
    return F.xxhash64(id_col, text_col, F.col(text_col).isNull())


def simhash_groups(docs: DataFrame, radius: int = 3, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id, group, row_key)``, one row per row of ``docs``.

    ``fingerprint`` is 16 hex digits, ``group`` the smallest fingerprint (as a signed
    number) of the component and ``row_key`` the hash of id and text by ``row_key``.  ``component_id`` is the smallest id that links of
    at most ``radius`` differing bits reach, the row's own included.  Null and empty texts
    have fingerprint zero and are linked like any other; repeated rows come back as often
    as they came; a null id counts for a component only when it has no other.
    """
    prints = materialise(
        docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"),
                    F.col(text_col).alias("text"))
        .mapInArrow(_fingerprints, "doc_id bigint, row_key bigint, fp bigint"), "simhash",
    )
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    star = connected_components(links(distinct.select("fp"), radius))
    members = star.select(F.col("node").alias("fp"), "root").unionByName(
        star.select(F.col("root").alias("fp"), "root").distinct()
    )
    firsts = members.join(distinct, "fp")
    roots = firsts.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = members.join(roots, "root").select("fp", "component_id", "root")
    lookup = distinct.join(known, "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id"),
        F.coalesce("root", "fp").alias("group"),
    )
    return prints.join(lookup, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        "group", "row_key",
    )


def one_per_group(docs: DataFrame, radius: int = 3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stand for their near-duplicates, all columns kept.

    Of each group the row with the smallest id stays, null ids last; of rows that share
    that id the one with the smallest ``row_key``; of repeated rows one.  A group without
    any id keeps a row as well, and an id that occurs in two groups stays in both.
    """
    # Grouping finds the smallest row per task first, so a large group costs one row each.
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    first = simhash_groups(docs, radius, id_col, text_col).groupBy("group").agg(
        F.min(row).getField("row_key").alias("_key"))
    first = materialise(first.select("_key").distinct(), "kept-rows")
    # Key and id together: a row is never taken for another one's repeat by a hash alone.
    return docs.withColumn("_key", row_key(id_col, text_col)).join(
        first, "_key", "left_semi").dropDuplicates(["_key", id_col]).select(*docs.columns)
