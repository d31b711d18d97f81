"""Best-fit packing of token runs into sequences of several permitted lengths.

A document longer than the largest length is cut into full pieces and a remainder.  Pieces
are dealt into shards of bounded size; each shard is packed with all lengths at once:
longest piece first, into the open sequence that it fills best; when it fits none, a
sequence of the size that costs least per token the rest can fill is opened.  Every
ladder of sizes that may be opened is tried, sequences are cut down to the smallest
length that holds them, and the cheapest packing of the shard stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import SEED, materialise, word_count


@dataclass(frozen=True)
class PackParams:
    """Cost of a sequence of n tokens: ``n + n * n / quadratic`` (attention)."""

    lengths: tuple[int, ...] = (512, 1024, 2048, 4096)
    quadratic: float = 16_384.0
    pieces_per_shard: int = 4_000
    seed: int = SEED

    def __post_init__(self):
        if not self.lengths or min(self.lengths) < 1 or list(self.lengths) != sorted(set(self.lengths)):
            raise ValueError("lengths must be positive and ascending")

    def cost(self, n: int) -> float:
        return n + n * n / self.quadratic


def best_fit(sizes: list[int], ladder: tuple[int, ...], p: PackParams) -> tuple[list[int], list[int]]:
    """Bin of every piece (given longest first) and the opened size of every bin.

    ``room`` has a bit for every free space that an open bin offers, so the tightest bin is
    the lowest bit from the piece's size on.
    """
    bins, opened = [], []
    free: dict[int, list[int]] = {}
    room, left = 0, sum(sizes)
    for size in sizes:
        fits = room >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                room &= ~(1 << space)
        else:
            space = min((n for n in ladder if n >= size),
                        key=lambda n: (p.cost(n) / min(n, left), n))
            b = len(opened)
            opened.append(space)
        rest = space - size
        bins.append(b)
        if rest:
            free.setdefault(rest, []).append(b)
            room |= 1 << rest
        left -= size
    return bins, opened


def pack_shard(sizes: list[int], p: PackParams) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every piece (longest first), and the final size of every bin."""
    best = None
    for low in range(len(p.lengths)):
        bins, opened = best_fit(sizes, p.lengths[low:], p)
        filled = [0] * len(opened)
        offsets = []
        for b, size in zip(bins, sizes):
            offsets.append(filled[b])
            filled[b] += size
        final = [next(n for n in p.lengths if n >= f) for f in filled]
        cost = sum(map(p.cost, final))
        if best is None or cost < best[0]:
            best = (cost, bins, offsets, final)
    return best[1:] if best else ([], [], [])


def _packer(p: PackParams):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "doc_id", "piece", "start", "length", "bin", "bin_size", "bin_offset"]

        def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            bins, offsets, final = pack_shard(table.column("length").to_pylist(), p)
            table = table.append_column("bin", pa.array(bins, pa.int64()))
            table = table.append_column("bin_size", pa.array([final[b] for b in bins], pa.int64()))
            table = table.append_column("bin_offset", pa.array(offsets, pa.int64()))
            yield from table.select(names).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and shard[a] != current:
                    yield from packed(pa.Table.from_batches(held))
                    held = []
                current = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from packed(pa.Table.from_batches(held))

    return pack


def pack_sequences(rows: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """Place every token of ``rows (doc_id, tokens)``: one row per piece.

    ``(doc_id, piece, start, length, shard, bin, bin_size, bin_offset)``: tokens ``start``
    to ``start + length`` of the document stand at ``bin_offset`` of sequence
    ``(shard, bin)``, which is ``bin_size`` long.  A document without tokens is one row of
    length 0 in no bin.  A full piece is a sequence of its own and has null ``shard`` and
    ``bin``.  Repeated rows are packed as often as they come.
    """
    top = p.lengths[-1]
    rows = materialise(rows.select(
        "doc_id", F.col("tokens").cast("bigint").alias("tokens"),
        F.xxhash64("doc_id", "tokens", F.monotonically_increasing_id(), F.lit(p.seed)).alias("_hash"),
    ), "pack-rows")
    whole = F.floor(F.col("tokens") / top).cast("bigint")
    rest = F.col("tokens") % top
    none = F.lit(None).cast("bigint")
    full = rows.where(F.col("tokens") >= top).select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece")
    ).select(
        "doc_id", "piece", (F.col("piece") * top).alias("start"), F.lit(top).cast("bigint").alias("length"),
        none.alias("shard"), none.alias("bin"), F.lit(top).cast("bigint").alias("bin_size"),
        F.lit(0).cast("bigint").alias("bin_offset"))
    empty = rows.where(F.col("tokens") == 0).select(
        "doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start"),
        F.lit(0).cast("bigint").alias("length"), none.alias("shard"), none.alias("bin"),
        none.alias("bin_size"), none.alias("bin_offset"))
    loose = rows.where(rest > 0)
    shards = max(1, -(-loose.count() // p.pieces_per_shard))
    dealt = loose.select(
        F.pmod("_hash", F.lit(shards)).alias("shard"), "doc_id", whole.alias("piece"),
        (whole * top).alias("start"), rest.alias("length"))
    placed = dealt.repartition("shard").sortWithinPartitions(
        "shard", F.desc("length"), "doc_id", "piece"
    ).mapInArrow(_packer(p), "shard bigint, doc_id bigint, piece bigint, start bigint, "
                 "length bigint, bin bigint, bin_size bigint, bin_offset bigint")
    names = full.columns
    return placed.select(*names).unionByName(full).unionByName(empty)


def pack_documents(docs: DataFrame, p: PackParams = PackParams(), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``pack_sequences`` over the words of every text (null: none)."""
    return pack_sequences(docs.select(
        F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("tokens")), p)
