"""String similarities: native where Spark has them, Arrow batches for the rest."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinweave.schema import SOURCE, TARGET

# Send these small functions with the tasks, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _ratio(x: str, y: str, at_least: float = 0.0) -> float:
    """Matching-block ratio; 0.0 once a cheap upper bound falls below ``at_least``."""
    if x == y:
        return 1.0
    bound = 2.0 * min(len(x), len(y)) / (len(x) + len(y))
    if bound < at_least:
        return 0.0
    matcher = SequenceMatcher(None, x, y)
    if at_least > 0.0 and matcher.quick_ratio() < at_least:
        return 0.0
    return matcher.ratio()


# ``SequenceMatcher`` passes over common characters only in texts from this length on.
_SHORT = 200


def _columns(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, beyond: int) -> np.ndarray:
    """Ranges of ``codes`` as columns of equal length, filled up with ``beyond``."""
    at = lo + np.arange((hi - lo).max())[:, None]
    return np.where(at < hi, codes[np.minimum(at, len(codes) - 1)], np.uint32(beyond))


def short_ratios(xs: list[str], ys: list[str], together: int = 512) -> np.ndarray:
    """``SequenceMatcher`` ratios of pairs of unequal texts shorter than ``_SHORT``.

    The longest common run of all pairs is found side by side, then those of the parts
    before and after it, and so on.  Of equal runs the first in ``x`` and then in ``y`` counts.
    """
    codes, ends, sizes = [], [], []
    for texts in (xs, ys):
        codes.append(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"))
        sizes.append(np.array([len(v) for v in texts]))
        ends.append(np.cumsum(sizes[-1]))
    matched = np.zeros(len(xs))
    parts = np.stack([np.arange(len(xs)), ends[0] - sizes[0], ends[0], ends[1] - sizes[1], ends[1]])
    while True:
        parts = parts[:, (parts[2] > parts[1]) & (parts[4] > parts[3])]
        if not parts.shape[1]:
            return 2.0 * matched / (sizes[0] + sizes[1])
        parts = parts[:, np.lexsort((parts[4] - parts[3], parts[2] - parts[1]))]
        left = []
        for start in range(0, parts.shape[1], together):
            pair, alo, ahi, blo, bhi = parts[:, start:start + together]
            a, b = _columns(codes[0], alo, ahi, 2**32 - 1), _columns(codes[1], blo, bhi, 2**32 - 2)
            # Length of the common run that ends at character i of x and j - 1 of y.
            runs = np.zeros((len(a), len(b) + 1, len(pair)), np.uint8)
            for i in range(len(a)):
                before = runs[i - 1, :-1] if i else np.uint8(0)
                np.multiply(before + np.uint8(1), a[i] == b, out=runs[i, 1:])
            cells = runs[:, 1:].reshape(-1, len(pair))
            at = cells.argmax(axis=0)
            k = cells[at, np.arange(len(pair))].astype(np.int64)
            matched += np.bincount(pair, k, len(xs))
            i, j = alo + at // len(b) + 1, blo + at % len(b) + 1
            found = k > 0
            left.append(np.stack([pair, alo, i - k, blo, j - k])[:, found])
            left.append(np.stack([pair, i, ahi, j, bhi])[:, found])
        parts = np.concatenate(left, axis=1)


def _ratios(pairs: Iterator[tuple], together: int = 8_192) -> Iterator[float | None]:
    """Ratio of each pair ``(x, y, at_least)`` as of ``_ratio``, NULL where a text is."""
    while some := list(islice(pairs, together)):
        short = [i for i, (x, y, _) in enumerate(some)
                 if x is not None and y is not None and x != y and max(len(x), len(y)) < _SHORT]
        done = dict(zip(short, short_ratios(*zip(*[some[i][:2] for i in short])).tolist())) if short else {}
        for i, (x, y, at_least) in enumerate(some):
            yield done[i] if i in done else None if x is None or y is None else _ratio(x, y, at_least)


def first_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(source, target, d)`` from edges ``(source, target, x, y)`` in that order.

    Every ``x`` takes its first ``y`` that is still free.  Edges stream past; what is held is
    the taken ``y`` of the pair at hand.
    """
    at, last_x, taken = None, None, set()
    for batch in batches:
        done = {SOURCE: [], TARGET: [], "d": []}
        for source, target, x, y in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if (source, target) != at:
                if at is not None:
                    for held, value in zip(done.values(), (*at, len(taken))):
                        held.append(value)
                at, last_x, taken = (source, target), None, set()
            if x != last_x and y not in taken:
                taken.add(y)
                last_x = x
        types = (*batch.schema.types[:2], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(done.values(), types)], names=list(done))
    if at is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip((*at, len(taken)), types)], names=list(done))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def ratio_grid(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Ratio of every ``x`` with every ``y`` of two arrays, NULL where either is."""
    both = [s is not None and t is not None for s, t in zip(xs, ys)]
    ratios = _ratios((x, y, 0.0) for s, t, ok in zip(xs, ys, both) if ok for x in s for y in t)
    return pd.Series([list(islice(ratios, len(s) * len(t))) if ok else None
                      for s, t, ok in zip(xs, ys, both)])


@F.pandas_udf(T.BooleanType())
def reaches(xs: pd.Series, ys: pd.Series, threshold: pd.Series) -> pd.Series:
    """Is the ratio of two texts at least ``threshold``?"""
    ratios = _ratios(zip(xs, ys, threshold))
    return pd.Series([r >= h for r, h in zip(ratios, threshold)], dtype="bool")


# Classes that characters are counted in; any number gives a valid bound.
_CLASSES = 32


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def class_counts(values: pd.Series) -> pd.Series:
    """Characters of a text per class, the class being the code point modulo ``_CLASSES``."""
    def counts(value):
        codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
        return np.bincount(codes % _CLASSES, minlength=_CLASSES).astype("int32")

    return pd.Series([counts(v) for v in values], dtype="object")


def at_most_shared(xs: Column, ys: Column) -> Column:
    """Bound on the characters two texts can share, from their ``class_counts``."""
    return reduce(Column.__add__, [F.least(xs[i], ys[i]) for i in range(_CLASSES)])


def levenshtein_similarity(x: Column, y: Column) -> Column:
    """``1 - distance / longer length``; 1.0 for two empty strings, NULL beside a NULL."""
    longer = F.greatest(F.length(x), F.length(y))
    known = x.isNotNull() & y.isNotNull()
    return F.when(known & (longer == 0), 1.0).otherwise(1.0 - F.levenshtein(x, y) / longer)


def exact_jaccard(xs: Column, ys: Column) -> Column:
    """Jaccard of two non-empty sets: the soft form at threshold 1."""
    return F.size(F.array_intersect(xs, ys)) / F.size(F.array_union(xs, ys))
