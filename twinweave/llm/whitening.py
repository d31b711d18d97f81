"""Whitened embeddings: projections on the leading components, scaled to unit variance.

Sums, covariances and projections are made inside Arrow batches and added up by Spark; the
driver sees the sums and the covariance, whose size is the square of a vector's length, and
sends the components back.  Vectors become whole numbers first, so sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinweave.llm.common import materialise
from twinweave.llm.eigen import EPS, leading_eigenpairs

# How an entry becomes a whole number.
STEP, SHIFT = 1024.0, 100_000
ROWS = 4_096
_LONG = 2.0 ** 63


@dataclass(frozen=True)
class Whitening:
    """What was fitted: count, exact sums, and per component eigenvalue and direction."""

    n: int
    sums: tuple[int, ...]
    values: tuple[float, ...]
    directions: np.ndarray
    trace: float


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(lengths, valid, flat)``: lengths of all vectors, which of them are whole, and the
    entries of the whole ones one after the other, as whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    present = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.slice(column.offsets[0].as_py(), int(lengths.sum()))
    entries = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    entries = np.where(flat.is_valid().to_numpy(zero_copy_only=False), entries, np.nan)
    row = np.repeat(np.arange(len(lengths)), lengths)
    broken = np.bincount(row[~np.isfinite(entries)], minlength=len(lengths)) > 0
    valid = present & ~broken
    x = np.floor(STEP * entries[valid[row]]) + SHIFT
    if len(x) and not np.abs(x).max() < _LONG:
        raise OverflowError("an entry times 1024 lies beyond 64 bits")
    return lengths, valid, x.astype(np.int64)


def _blocks(batch: pa.RecordBatch, at: int, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, x)``: the whole vectors of length ``dim``, a few thousand at a time."""
    for start in range(0, batch.num_rows, ROWS):
        lengths, valid, x = _whole(batch.column(at).slice(start, ROWS))
        fits = lengths[valid] == dim
        rows = start + np.flatnonzero(valid)[fits]
        if len(rows):
            yield rows, x[np.repeat(fits, lengths[valid])].reshape(len(rows), dim)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            lengths, valid, x = _whole(batch.column(0).slice(start, ROWS))
            held = lengths[valid]
            for dim in np.unique(held[held > 0]):
                mine = x[np.repeat(held == dim, held)].reshape(-1, dim)
                n, s = found.get(int(dim), (0, np.zeros(dim, np.int64)))
                found[int(dim)] = n + len(mine), s + mine.sum(axis=0)
    for dim, (n, s) in found.items():
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array([dim] * (dim + 1), pa.int32()),
            "i": pa.array(range(-1, dim), pa.int32()),
            "v": pa.array([n, *s.tolist()], pa.int64()),
        })


def _exact_squares(d: np.ndarray) -> list[int]:
    """Sum of squares of every row, without overflow."""
    top = float(np.abs(d).max()) if d.size else 0.0
    if top * top * d.shape[1] < _LONG / 2:
        return (d * d).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in d.tolist()]


def fit_whitening(vectors: DataFrame, column: str = "embedding", k: int = 8) -> Whitening | None:
    """Means and leading components of all whole vectors; None when there are none.

    Vectors that are null, empty, or hold a null or non-finite entry take no part.  Of
    several lengths the commonest counts, the longer of equals.  Components without
    variance (as far as rounding tells) cannot be scaled and are left out.
    """
    only = vectors.select(column)
    sums = only.mapInArrow(_count, "dim int, i int, v bigint").groupBy("dim", "i").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    sums = materialise(sums, "vector-sums")
    common = sums.where("i < 0 and dim > 0").orderBy(F.desc("v"), F.desc("dim")).first()
    if common is None:
        return None
    dim, n = common["dim"], int(common["v"])
    total = [int(r["v"]) for r in sums.where((F.col("dim") == dim) & (F.col("i") >= 0)).orderBy("i").collect()]
    mean = np.array([s // n + (s % n) / n for s in total])
    upper = np.triu_indices(dim)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((dim, dim))
        for batch in batches:
            for _, x in _blocks(batch, 0, dim):
                d = x - mean
                held += d.T @ d
        for i in range(dim):
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(np.full(dim - i, i), pa.int32()),
                "j": pa.array(np.arange(i, dim), pa.int32()), "v": pa.array(held[i, i:]),
            })

    cells = only.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(
        F.sum("v").alias("v")).orderBy("i", "j").collect()
    covariance = np.zeros((dim, dim))
    covariance[upper] = [c["v"] / n for c in cells]
    covariance = covariance + np.triu(covariance, 1).T
    values, directions = leading_eigenpairs(covariance, k)
    trace = float(np.trace(covariance))
    real = values > dim * EPS * trace
    return Whitening(n, tuple(total), tuple(values[real].tolist()), directions[:, real], trace)


def whiten(vectors: DataFrame, fitted: Whitening | None, keep: tuple[str, ...] = ("vec_id",),
           column: str = "embedding") -> DataFrame:
    """``keep..., deviation decimal(38,0), whitened array<double>``, one row per whole vector.

    ``deviation`` is the sum over dimensions of ``(n*x - S)**2``, exact.  Rows are carried as
    they are: repeated ids stay repeated, a null id stays null.
    """
    rows = vectors.select(*keep, column)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("deviation", T.DecimalType(38, 0)),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    dim, n, k = len(fitted.sums), fitted.n, len(fitted.values)
    whole = [s // n for s in fitted.sums]
    base, rest = np.array(whole, np.int64), [s - n * w for s, w in zip(fitted.sums, whole)]
    part = np.array([r / n for r in rest])
    scaled = fitted.directions / np.sqrt(np.array(fitted.values))
    at = len(keep)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, x in _blocks(batch, at, dim):
                d = x - base
                w = (d - part) @ scaled
                if float(np.abs(d).max() + 1) * n < _LONG / 4:
                    squares = _exact_squares(n * d - np.array(rest, np.int64))
                else:
                    squares = [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in d.tolist()]
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(i).take(pa.array(rows_)) for i in range(at)],
                    pa.array(squares, pa.decimal128(38, 0)) if max(squares) >= _LONG
                    else pa.array(squares, pa.int64()).cast(pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(w.ravel())),
                ], names=[*keep, "deviation", "whitened"])

    return rows.mapInArrow(project, schema)


def identity_error(whitened: DataFrame, fitted: Whitening | None) -> float:
    """Largest distance of the whitened vectors' covariance from the identity matrix."""
    k = len(fitted.values) if fitted else 0
    if not k:
        return 0.0
    w = [F.col("whitened")[i] for i in range(k)]
    mean = whitened.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]).first()
    centred = [c - F.lit(m) for c, m in zip(w, mean)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = whitened.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (1.0 if i == j else 0.0)) for (i, j), c in zip(pairs, cov))


def whitened_components(vectors: DataFrame, key: str = "vec_id", column: str = "embedding",
                        k: int = 8) -> DataFrame:
    """One row per whole vector and component, with the fit's figures on every row."""
    fitted = fit_whitening(vectors, column, k)
    rows = materialise(whiten(vectors, fitted, (key,), column), "whitened")
    explained = [v / fitted.trace for v in fitted.values] if fitted else []
    each = F.posexplode("whitened").alias("_at", "_value")
    known = F.array(*map(F.lit, explained)).cast("array<double>")
    return rows.select(F.col(key).alias("_key"), "deviation", each).select(
        F.col("_key").alias(key), (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(fitted.n if fitted else 0).cast("bigint").alias("n"), "deviation",
        F.col("_value").alias("whitened"), known[F.col("_at")].alias("explained"),
        F.lit(identity_error(rows, fitted)).cast("double").alias("identity_error"),
    )
