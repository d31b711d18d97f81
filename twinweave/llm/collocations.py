"""Collocations by Toivonen's method: a sample proposes, full passes decide.

A sample is mined level by level and proposes phrases.  Full passes over all texts count
the negative border as far as it occurs: every word, and every longer phrase whose beginning
and end (all but its last word, all but its first) are proposed, that is not proposed itself.
A border phrase that turns out frequent was missing from the proposal; it is added and
another pass counts the border that its addition opens, until none is missing.  What was
proposed or added is then counted word by word.

Proposals are held as a bit table of fixed size, and border counts are kept by 64-bit hash.
Where hashes fall together a count can only be too high, which adds a phrase to those that
the last pass counts, so the result is exact whatever the size of the corpus.  Counting is
made inside Arrow batches over the bytes of many texts at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.llm.common import SEED, materialise
from twinweave.operators.skew import lookup_join

LONGEST = 4
UNKNOWN = "und"
# Bytes of text that are looked at together; a longer piece is not cut.
WINDOW = 1 << 20
# Distinct phrases of windows that a task holds before it hands their counts on.
HELD = 1_500_000
HANDED = 100_000
# Rows of one language that one task ranks.
RANKED = 50_000

# Kinds of bytes: of a word, between words, between pieces.
_WORD, _GAP, _END = 0, 1, 2
_KIND = np.full(256, _WORD, np.uint8)
_KIND[[0x20, 0x09]] = _GAP
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _END
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_U = np.uint64
# Multipliers of the two 64-bit halves of a hash.
_HALVES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
# Words of more bytes are hashed one by one.
_LANES = 64


@dataclass(frozen=True)
class CollocationParams:
    """``min_count`` makes a phrase frequent; ``covered`` of a hundred drops a part of it.

    ``sample_of`` is the inverse share of documents that make the proposal, ``ease`` the
    share of the expected count that suffices in it (two at least), ``filter_bits`` the
    power of two of the bit table that every task holds.
    """

    min_count: int = 30
    covered: int = 80
    scale: int = 2_000_000
    top: int = 2_000
    sample_of: int = 10
    ease: float = 0.8
    filter_bits: int = 26

    @property
    def sample_count(self) -> int:
        return max(2, math.ceil(self.ease * self.min_count / self.sample_of))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _marked(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """True where both bits of a hash are set."""
    found = np.ones(len(h), bool)
    for at in _places(h, bits):
        found &= (table[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1
    return found


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = h & ~_U(1)
    return h >> _U(64 - bits), (h * _U(0xD6E8FEB86659FD93)) >> _U(64 - bits)


class Words:
    """The words of some texts: bytes, bounds, neighbours and the halves of their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray):
        """``data`` holds texts back to back from ``offsets``; ``seeds`` tells languages apart."""
        kind = _KIND[data]
        word = kind == _WORD
        edge = np.empty(len(data), bool)
        edge[:1] = True
        np.not_equal(word[1:], word[:-1], out=edge[1:])
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        edge[inner] = True
        at = np.flatnonzero(edge)
        held = word[at]
        self.start = at[held]
        self.length = np.diff(np.append(at, len(data)))[held]
        self.bytes = _LOWER[data]
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        piece = np.cumsum(kind == _END, dtype=np.int32)[self.start]
        # True where the next word stands in the same piece of the same text.
        self.joined = np.zeros(len(self.start), bool)
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.hash = self._hashes(seeds[self.doc])

    def _hashes(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([self.bytes, np.zeros(8, np.uint8)])
        # Eight bytes from every place on, as one number.
        eight = np.ndarray((len(self.bytes) + 1,), "<u8", padded, 0, (1,))
        size = self.length.astype(_U)
        one, two = (_mixed(seeds + size * m) for m in _HALVES)
        who = np.arange(len(size))
        for done in range(0, _LANES, 8):
            who = who[self.length[who] > done]
            if not len(who):
                break
            left = np.minimum(self.length[who] - done, 8).astype(_U)
            lane = eight[self.start[who] + done] & (~_U(0) >> (_U(64) - _U(8) * left))
            one[who] = _mixed(one[who] ^ lane * _HALVES[0])
            two[who] = _mixed(two[who] ^ lane * _HALVES[1])
        for i in np.flatnonzero(self.length > _LANES):
            text = self.bytes[self.start[i]:self.start[i] + self.length[i]].tobytes()
            digest = np.frombuffer(hashlib.blake2b(text, digest_size=16).digest(), "<u8")
            one[i], two[i] = (_mixed(seeds[i:i + 1] ^ d)[0] for d in digest)
        return one, two

    def grown(self, halves: tuple, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of phrases of ``k`` words at places ``at``, from those of ``k - 1``."""
        return tuple(_mixed(h[at] * _U(3) + w[at + k - 1]) for h, w in zip(halves, self.hash))


def _grouping(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs of halves together, and where each begins in it."""
    order = np.argsort(one)
    a, b = one[order], two[order]
    new = np.append(True, a[1:] != a[:-1])
    if np.any(~new[1:] & (b[1:] != b[:-1])):
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    return order, np.flatnonzero(new[:len(order)])


def _grouped(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(example, counts)`` of the distinct pairs of halves."""
    order, first = _grouping(one, two)
    return order[first], np.diff(np.append(first, len(order)))


class Counts:
    """Counts of phrases over several windows of a task, handed on together.

    Rows are told apart by both halves of a hash, or by the first alone when ``two`` is None;
    ``more`` are Arrow columns that equal rows share.
    """

    def __init__(self, names: list[str]):
        self.names, self.parts, self.size = names, [], 0

    def add(self, one: np.ndarray, two: np.ndarray | None, counts: np.ndarray,
            *more: pa.Array) -> Iterator[pa.RecordBatch]:
        self.parts.append((one, one if two is None else two, counts, more))
        self.size += len(one)
        if self.size > HELD:
            self._merge()
            # Merged rows stay for the windows to come as long as they leave room for them.
            if self.size > HELD // 2:
                yield from self.rest()

    def _merge(self) -> None:
        one, two, counts = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        order, first = _grouping(one, two)
        at = order[first]
        sums = np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else counts
        more = [pa.concat_arrays([p[3][i] for p in self.parts]).take(pa.array(at))
                for i in range(len(self.parts[0][3]))]
        self.parts, self.size = [(one[at], two[at], sums, more)], len(at)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        self._merge()
        (one, _, sums, more), = self.parts
        self.parts, self.size = [], 0
        columns = [*([] if more else [pa.array(one.view(np.int64))]), *more, pa.array(sums.astype(np.int64))]
        for i in range(0, len(sums), HANDED):
            yield pa.RecordBatch.from_arrays([c.slice(i, HANDED) for c in columns], names=self.names)


def _longer(words: Words, table: np.ndarray, bits: int, before: np.ndarray | None = None,
            upto: int = LONGEST) -> Iterator[tuple]:
    """``(k, places, halves)`` of the phrases of 2 to ``upto`` words that the table opens.

    Opened is a phrase whose beginning and end are both marked.  With ``before`` only places
    come out that the table ``before`` did not open.
    """
    n = len(words.start)
    halves, whole, old = words.hash, np.ones(n, bool), np.ones(n, bool)
    for k in range(2, upto + 1):
        known = np.flatnonzero(whole)
        marked = np.zeros(n, bool)
        marked[known] = _marked(table, halves[0][known], bits)
        whole = np.zeros(n, bool)
        whole[:-1] = marked[:-1] & marked[1:] & words.joined[:-1]
        if before is not None:
            known = np.flatnonzero(marked & old)
            seen = np.zeros(n, bool)
            seen[known] = _marked(before, halves[0][known], bits)
            old = np.zeros(n, bool)
            old[:-1] = seen[:-1] & seen[1:] & whole[:-1]
        at = np.flatnonzero(whole)
        if not len(at):
            return
        grown = words.grown(halves, at, k)
        if before is None:
            yield k, at, grown
        else:
            fresh = ~old[at]
            yield k, at[fresh], tuple(h[fresh] for h in grown)
        halves = tuple(np.zeros(n, _U) for _ in grown)
        for h, g in zip(halves, grown):
            h[at] = g


def _phrases(words: Words, places: np.ndarray, k: int) -> pa.Array:
    """The phrases of ``k`` words from ``places`` on, joined by single spaces."""
    size = sum(words.length[places + j] for j in range(k)) + (k - 1)
    out = np.concatenate([[0], np.cumsum(size)])
    buffer = np.full(int(out[-1]), 0x20, np.uint8)
    to = out[:-1].copy()
    for j in range(k):
        n = words.length[places + j]
        steps = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
        buffer[np.repeat(to, n) + steps] = words.bytes[np.repeat(words.start[places + j], n) + steps]
        to += n + 1
    return pa.StringArray.from_buffers(
        len(places), pa.py_buffer(out.astype(np.int32).tobytes()), pa.py_buffer(buffer.tobytes()))


def _language_seeds(langs: pa.Array) -> np.ndarray:
    """One 64-bit value per row, the same wherever the language is the same."""
    coded = langs.dictionary_encode()
    each = []
    for lang in coded.dictionary.to_pylist():
        each.append(np.frombuffer(hashlib.blake2b(lang.encode("utf-8"), digest_size=8).digest(), "<u8")[0])
    return np.array(each, _U)[coded.indices.to_numpy(zero_copy_only=False)]


def _windows(batch: pa.RecordBatch) -> Iterator[tuple[Words, pa.Array]]:
    """The words of a batch ``(lang, text)`` in windows of whole pieces, with the languages."""
    langs, texts = batch.column(0), batch.column(1)
    if not batch.num_rows:
        return
    seeds = _language_seeds(langs)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    base, stop = int(offsets[0]), int(offsets[-1])
    if stop == base:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)[base:stop]
    offsets = offsets - base
    at = 0
    while at < len(data):
        end = min(len(data), at + WINDOW)
        if end < len(data):
            end = _piece_end(data, offsets, end)
        # Texts that begin before the window's end; the first may have begun before it.
        low = int(np.searchsorted(offsets, at, side="right")) - 1
        high = int(np.searchsorted(offsets, end, side="left"))
        bounds = np.maximum(offsets[low:high], at) - at
        yield Words(data[at:end], bounds, seeds[low:high]), langs.slice(low, high - low)
        at = end


def _piece_end(data: np.ndarray, offsets: np.ndarray, end: int) -> int:
    """The first end of a piece or text from ``end`` on."""
    stop = int(offsets[np.searchsorted(offsets, end)])
    while end < stop:
        found = np.flatnonzero(_KIND[data[end:min(stop, end + WINDOW)]] == _END)
        if len(found):
            return end + int(found[0]) + 1
        end = min(stop, end + WINDOW)
    return stop


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))


def _sample_pass(texts: DataFrame, level: int, table, bits: int, least: int) -> DataFrame:
    """Hashes of the phrases of ``level`` words that occur ``least`` times in the sample."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts(["h", "c"])
        for batch in batches:
            for words, _ in _windows(batch):
                found = [words.hash] if level == 1 else [
                    h for k, _, h in _longer(words, table.value, bits, upto=level) if k == level]
                for one, _ in found:
                    example, counts = _grouped(one, one)
                    yield from held.add(one[example], None, counts)
        yield from held.rest()

    return texts.mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(
        F.sum("c").alias("c")).where(F.col("c") >= least).select("h")


def _border_pass(texts: DataFrame, table, before, bits: int) -> DataFrame:
    """``(h, c)``: counts of the border, the phrases that the table opens but does not mark.

    With ``before``, the table of the passes until now, only of what it did not open; else
    of words too.  The lowest bit of ``h`` tells phrases of the greatest length from others.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = before.value if before is not None else None
        held = Counts(["h", "c"])
        for batch in batches:
            for words, _ in _windows(batch):
                every = [(1, None, words.hash)] if old is None else []
                for k, _, (one, _) in chain(every, _longer(words, table.value, bits, old)):
                    example, counts = _grouped(one, one)
                    h = one[example]
                    fresh = ~_marked(table.value, h, bits)
                    h = (h[fresh] & ~_U(1)) | _U(k == LONGEST)
                    yield from held.add(h, None, counts[fresh])
        yield from held.rest()

    return texts.mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _exact_pass(texts: DataFrame, table, bits: int) -> DataFrame:
    """``(lang, k, phrase, c)``: exact counts of the phrases that the table marks, and as
    ``k = 0`` the number of words of a language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts(["lang", "k", "phrase", "c"])
        for batch in batches:
            for words, langs in _windows(batch):
                coded = langs.dictionary_encode()
                per_doc = np.bincount(words.doc, minlength=len(langs))
                sums = np.bincount(coded.indices.to_numpy(), per_doc, len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([
                    coded.dictionary, pa.array(np.zeros(len(sums), np.int32)),
                    pa.array([""] * len(sums), pa.string()), pa.array(sums.astype(np.int64)),
                ], names=held.names)
                every = [(1, np.arange(len(words.start)), words.hash)]
                for k, at, halves in chain(every, _longer(words, table.value, bits)):
                    known = _marked(table.value, halves[0], bits)
                    at, one, two = at[known], halves[0][known], halves[1][known]
                    example, counts = _grouped(one, two)
                    at = at[example]
                    yield from held.add(
                        one[example], two[example], counts, langs.take(pa.array(words.doc[at])),
                        pa.array(np.full(len(at), k, np.int32)), _phrases(words, at, k))
        yield from held.rest()

    return texts.mapInArrow(count, "lang string, k int, phrase string, c bigint").groupBy(
        "lang", "k", "phrase").agg(F.sum("c").alias("c"))


def _with_marks(table: np.ndarray, hashes: DataFrame, bits: int) -> tuple[np.ndarray, bool]:
    """The bit table with the bits of ``hashes`` set, and whether there were any.

    Bits are gathered by Spark into at most ``2**(bits - 6)`` rows.
    """
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            at = np.concatenate(_places(h, bits))
            yield pa.RecordBatch.from_pydict({
                "w": pa.array((at >> _U(6)).astype(np.int64)),
                "b": pa.array((_U(1) << (at & _U(63))).view(np.int64))})

    found = hashes.mapInArrow(places, "w bigint, b bigint").groupBy("w").agg(
        F.bit_or("b").alias("b")).toArrow()
    out = table.copy()
    out[found["w"].to_numpy()] |= found["b"].to_numpy().view(_U)
    return out, found.num_rows > 0


def count_phrases(docs: DataFrame, params: CollocationParams = CollocationParams(),
                  lang: str = "lang", text: str = "text") -> tuple[DataFrame, int]:
    """``(lang, k, phrase, c)`` of all frequent phrases, and the number of border passes.

    A row with ``k = 0`` has the number of words of its language.
    """
    spark, bits = docs.sparkSession, params.filter_bits
    texts = _texts(docs, lang, text)
    sample = materialise(
        texts.where(F.pmod(F.xxhash64("lang", "text", F.lit(SEED)), F.lit(params.sample_of)) == 0),
        "phrase-sample")
    marks = np.zeros(1 << (bits - 6), _U)
    shared = None
    for level in range(1, LONGEST):
        proposed = _sample_pass(sample, level, shared, bits, params.sample_count)
        marks, any_ = _with_marks(marks, proposed, bits)
        shared = spark.sparkContext.broadcast(marks)
        if not any_:
            break
    before, passes, closed = None, 0, False
    while not closed:
        counts = _border_pass(texts, shared, before, bits).where(F.col("c") >= params.min_count)
        failures = materialise(counts.select("h"), "border-failures")
        marks, _ = _with_marks(marks, failures, bits)
        before, shared, passes = shared, spark.sparkContext.broadcast(marks), passes + 1
        # Phrases of the greatest length open no others.
        closed = failures.where(F.col("h").bitwiseAND(1) == 0).isEmpty()
    exact = _exact_pass(texts, shared, bits)
    return materialise(exact.where(
        (F.col("c") >= params.min_count) | (F.col("k") == 0)), "phrases"), passes


def _part(words: Column, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def _scored(frequent: DataFrame, params: CollocationParams) -> DataFrame:
    """``(lang, phrase, k, a, l, r, score)``: every candidate at its lowest-scoring cut."""
    known = frequent.where(F.col("k") > 0).select("lang", "phrase", "c")
    words = F.split("phrase", " ")
    cuts = frequent.where(F.col("k") > 1).select(
        "lang", "phrase", "k", F.col("c").alias("a"), words.alias("_words"),
        F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"),
    ).select(
        "lang", "phrase", "k", "a", "cut", _part(F.col("_words"), 1, F.col("cut")).alias("left"),
        _part(F.col("_words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        counts = known.select("lang", F.col("phrase").alias(side), F.col("c").alias(name))
        cuts = lookup_join(cuts, counts, ["lang", side], ["phrase", "cut"])
    whole = F.expr(
        f"(cast({params.scale} as decimal(10,0)) * cast(a as decimal(20,0))) div "
        "(cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = F.min(F.struct(whole.alias("score"), "cut", "l", "r")).alias("_low")
    return cuts.groupBy("lang", "phrase", "k", "a").agg(lowest).select(
        "lang", "phrase", "k", "a", "_low.l", "_low.r", "_low.score")


def _uncovered(scored: DataFrame, params: CollocationParams) -> DataFrame:
    """Without the phrases that a longer candidate covers."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
            F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: _part(words, at, size))))
    holders = scored.where(F.col("k") > 2).select(
        "lang", F.explode(spans).alias("phrase"), F.col("a").alias("_a")
    ).groupBy("lang", "phrase").agg(F.max("_a").alias("_longer"))
    exact = "cast({} as decimal(10,0)) * cast({} as decimal(20,0))"
    covered = F.expr(f"{exact.format(100, '_longer')} >= {exact.format(params.covered, 'a')}")
    return scored.join(holders, ["lang", "phrase"], "left").where(
        ~F.coalesce(covered, F.lit(False))).drop("_longer")


def _first_rows(rows: DataFrame, n: int) -> DataFrame:
    """Rank and keep the first ``n`` of every language, in rounds of bounded tasks."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = materialise(rows, "phrase-scores")
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while most > max(RANKED, 2 * n):
        slices = -(-most // max(RANKED, 2 * n))
        part = F.pmod(F.xxhash64("phrase", F.lit(most)), F.lit(slices))
        rows = rows.withColumn("_part", part).withColumn(
            "_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
        ).where(F.col("_rank") <= n).drop("_part", "_rank")
        most = slices * n
    return rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ).where(F.col("rank") <= n)


def collocations(docs: DataFrame, params: CollocationParams = CollocationParams(),
                 lang: str = "lang", text: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best collocations of each language.

    A-Z are lower-cased; texts fall into pieces at ``.,;:!?`` and line ends, pieces into
    words at spaces and tabs.  A phrase has 2 to 4 words of one piece.  A null text is empty,
    a null language is ``und``; repeated rows count as often as they stand.  Ids and other
    columns play no part.  A language without frequent phrases has no rows.  A piece is
    looked at whole: memory is some thirty times the longest piece, or window of pieces.
    """
    found, _ = count_phrases(docs, params, lang, text)
    best = _first_rows(_uncovered(_scored(found, params), params), params.top)
    totals = found.where(F.col("k") == 0).select("lang", F.col("c").alias("n"))
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
