"""Native text expressions for keys and values."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinweave.schema import LEVEL_SEPARATOR

# Send these small functions with the tasks, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of text that are looked at together; a longer text is looked at whole.
WINDOW = 1 << 22
# Distinct words that a task holds before it hands their counts on, and rows handed on at once.
HELD_WORDS = 1_000_000
HANDED_WORDS = 100_000

_PLAIN_CLASS = re.compile(r"\[\^((?:[0-9A-Za-z]-[0-9A-Za-z]|[0-9A-Za-z._])+)\]\+")
_NEGATED_CLASS = re.compile(r"\[\^((?:[^\[\]\\&^]|\\[^QE])+)\]\+")


def tokens(value: Column, pattern: str) -> Column:
    """Lower-cased tokens between matches of ``pattern``; repeats are kept.

    Splitting on a negated class is the same as extracting the runs of the class, and
    that form needs no empty strings removed and scales better over threads.
    """
    negated = _NEGATED_CLASS.fullmatch(pattern)
    if negated:
        return F.regexp_extract_all(F.lower(value), F.lit(f"[{negated.group(1)}]+"), F.lit(0))
    return F.array_remove(F.split(F.lower(value), pattern), "")


def clean(value: Column, ignore: str) -> Column:
    """Lower-case and remove every match of ``ignore`` (none when empty)."""
    lowered = F.lower(value)
    return F.regexp_replace(lowered, ignore, "") if ignore else lowered


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def value_id(value: Column) -> Column:
    """128-bit identity of a value, so long texts need not travel through shuffles."""
    return F.unhex(F.md5(value))


def render_key(path: Column) -> Column:
    """``$a$b`` for the path ``[a, b]``."""
    return F.concat(F.lit(LEVEL_SEPARATOR), F.array_join(path, LEVEL_SEPARATOR))


def pair_order(*columns: str, seed: int, use: str) -> Column:
    """Reproducible pseudo-random order of rows, independent of partitioning.

    Every ``use`` (``sample``, ``thin``, ``order``) has a hash of its own, so rows picked
    by one are in no particular order for another.
    """
    return F.md5(F.concat_ws(
        "|", *[F.col(c).cast("string") for c in columns], F.lit(f"{seed}|{use}")))


def keep_fraction(rate: float, *columns: str, seed: int) -> Column:
    """True for about ``rate`` of the rows, decided by a hash of its own."""
    if not 0.0 <= rate <= 1.0:
        raise ValueError("a rate lies in [0, 1]")
    if rate == 1.0:
        return F.lit(True)
    limit = format(int(rate * 16**8), "08x")
    return F.substring(pair_order(*columns, seed=seed, use="thin"), 1, 8) < limit


def word_bytes(pattern: str) -> np.ndarray | None:
    """Which bytes stand in words, for a plain negated class of ASCII characters; else None."""
    plain = _PLAIN_CLASS.fullmatch(pattern)
    if not plain:
        return None
    one = re.compile(f"[{plain.group(1)}]")
    return np.array([b < 128 and one.fullmatch(chr(b)) is not None for b in range(256)])


def _runs(texts: pa.Array, held: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """``(words, rows)``: the runs of ``held`` bytes of texts without nulls, some texts at a time."""
    width = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return
    bounds = np.frombuffer(offsets, width, len(texts) + 1, texts.offset * width.itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + WINDOW, side="right")) - 1)
        part, here = data[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at]
        inside = held[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = here[:-1][here[:-1] < len(part)]
        begins[first] = inside[first]
        starts = np.flatnonzero(begins)
        if len(starts):
            length = np.add.reduceat(inside, starts, dtype=np.int64)
            to = np.append(0, np.cumsum(length)).astype(np.int32)
            yield (pa.StringArray.from_buffers(len(starts), pa.py_buffer(to), pa.py_buffer(part[inside])),
                   at + np.searchsorted(here, starts, side="right") - 1)
        at = end


def count_words(held: np.ndarray) -> Callable:
    """Task that writes ``(word, cnt)`` of the runs of ``held`` bytes in its texts."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def merged() -> pa.Table:
            table = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("cnt", "sum")])
            return table.select(["word", "cnt_sum"]).rename_columns(["word", "cnt"])

        for batch in batches:
            for words, _ in _runs(batch.column(0), held):
                found = words.value_counts()
                parts.append(pa.Table.from_arrays([found.field(0), found.field(1)], names=["word", "cnt"]))
                size += len(found)
                if size > HELD_WORDS:
                    parts = [merged()]
                    size = parts[0].num_rows
                    # Merged words stay for the texts to come as long as they leave room.
                    if size > HELD_WORDS // 2:
                        yield from parts.pop().to_batches(max_chunksize=HANDED_WORDS)
                        size = 0
        if parts:
            yield from merged().to_batches(max_chunksize=HANDED_WORDS)

    return counted


def low_ranks(words: pa.Array, counts: np.ndarray, max_len: int,
              held: np.ndarray | None = None, counted: bool = False) -> Callable:
    """Task that writes a row per word of the last column that can be of the ``max_len`` rarest.

    ``words`` are known words and ``counts`` how often they occur.  Of them only those of a row's
    ``max_len`` lowest counts are written; words that are not known always are.  With ``counted``
    those are sure to be rarer than all known words, and take a rank.  The last column
    has texts whose words are runs of ``held`` bytes, or lists of words when ``held`` is None.
    """
    none = np.iinfo(np.int64).max

    def pieces(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
        if held is not None:
            yield from _runs(column, held)
            return
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        if n.sum():
            yield column.flatten(), np.repeat(np.arange(len(n)), n)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flat, row in pieces(batch.column(batch.num_columns - 1)):
                at = pc.index_in(flat, value_set=words)
                known = at.is_valid().to_numpy(zero_copy_only=False)
                cnt = np.full(len(flat), none)
                cnt[known] = counts[at.drop_null().to_numpy()]
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                n = np.diff(np.append(starts, len(row)))
                bound = np.full(len(n), -1)
                ranks = max_len - (np.logical_or.reduceat(~known, starts) if counted and len(starts) else 0)
                for i in range(max_len):
                    higher = np.minimum.reduceat(np.where(cnt > np.repeat(bound, n), cnt, none), starts)
                    bound = np.where(i < ranks, higher, bound)
                kept = np.flatnonzero(~known | (cnt <= np.repeat(bound, n)))
                # A word of a text once.
                coded = flat.take(pa.array(kept)).dictionary_encode()
                _, once = np.unique(
                    row[kept] * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_index=True)
                kept = kept[once]
                rows = pa.array(row[kept])
                columns = [batch.column(i).take(rows) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, flat.take(pa.array(kept))], names=[*batch.schema.names[:-1], "word"])

    return written
