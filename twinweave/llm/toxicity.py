"""Toxic passages as maximum-scoring segments of token log-odds.

Word counts of the whole corpus give a Dirichlet prior; log-odds of the words in toxic
against clean labelled documents, shifted down so that ordinary text drifts below zero,
score every token.  A linear scan finds every maximal passage of positive score.  Passage
scores become comparable over text lengths by the extreme-value law of such segments, and
a logistic curve fitted on the labelled sample turns that evidence into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import SEED, materialise, smallest_by_hash

TOKEN = re.compile(r"[^\W\d_]+")
PIECE = 1 << 20


@dataclass(frozen=True)
class ToxicityParams:
    """``docs_per_class`` bounds the labelled sample, ``max_words`` the model's size.

    ``prior_share`` is the prior's weight as a share of the labelled tokens.  ``curve_points``
    bounds the points that the curve is fitted on, taken in hash order: more than it there
    can only be when many rows share the sampled ids.
    """

    docs_per_class: int = 20_000
    max_words: int = 50_000
    curve_points: int = 200_000
    prior_share: float = 0.05
    min_z: float = 3.0
    drift: float = 0.5
    seed: int = SEED


@dataclass(frozen=True)
class ToxicityModel:
    """Token scores, the drift of all other tokens, the law's two numbers, the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    drift: float = 0.5
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 0.0
    offset: float = -50.0


def tokens(text: str) -> Iterator[list[str]]:
    """Lower-cased runs of letters, piece by piece; no piece ends inside a run."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        yield TOKEN.findall(text[at:end].lower())
        at = end


def passages(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal segments ``(first, last, score)`` of a score sequence, in linear time.

    ``hits`` holds positions and scores of the tokens that differ from ``-drift``.  Each
    candidate keeps the running sum before it and after it; a new positive token joins the
    nearest earlier candidate that began lower, as long as that raises the whole.
    """
    found: list[list[float]] = []  # first, last, sum before, sum after
    total, at = 0.0, 0
    for pos, score in hits:
        total -= drift * (pos - at)
        at = pos + 1
        before = total
        total += score
        if score <= 0:
            continue
        new = [pos, pos, before, total]
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
        found.append(new)
    return [(int(a), int(b), r - q) for a, b, q, r in found]


def evidence(text: str | None, model: ToxicityModel) -> tuple[float, list[tuple[int, int, float]]]:
    """How far the best passages exceed what ordinary text of this length shows.

    With ``r`` best passages of total score S in ``n`` tokens the law gives
    ``rate * S - r ln(scale * n) + ln r!``.  The largest over r counts, 0 without any, on a
    logarithmic scale.
    """
    hits: list[tuple[int, float]] = []
    n, weights = 0, model.weights
    for words in tokens(text or ""):
        hits += [(n + i, weights[w]) for i, w in enumerate(words) if w in weights]
        n += len(words)
    found = passages(hits, model.drift)
    if not found:
        return 0.0, []
    cost = math.log(max(model.scale * n, 1e-9))
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted((s for _, _, s in found), reverse=True), 1):
        total += model.rate * s - cost + math.log(r)
        best = max(best, total)
    significant = [f for f in found if model.rate * f[2] > cost]
    return math.log1p(best), significant


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = {k: Counter() for k in (None, 0, 1)}
        for text, kind in zip(batch.column(0), batch.column(1)):
            for words in tokens(text.as_py() or ""):
                kinds[kind.as_py()].update(words)
        words, cols = list(set().union(*kinds.values())), []
        for k in (None, 0, 1):
            cols.append(pa.array([kinds[k][w] for w in words], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *cols], names=["word", "rest", "clean", "toxic"]
        )


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1; 1 when there is none."""
    if not len(scores) or not (scores > 0).any() or (share * scores).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    value = lambda x: (share * np.exp(np.minimum(x * scores, 700))).sum()
    while value(high) < 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return (low + high) / 2


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with smoothed targets (Newton steps)."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 0.0, (50.0 if pos else -50.0)
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, math.log((pos + 1) / (neg + 1))
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g, h = target - q, q * (1 - q) + 1e-9
        m = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(m, [(g * x).sum() - 1e-3 * a, g.sum()])
        size = max(abs(da), abs(db))
        scale = min(1.0, 2.0 / size) if size else 1.0
        a, b = a + scale * da, b + scale * db
        if size < 1e-8:
            break
    return max(0.0, float(a)), float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column,
                 p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on ``labels (doc_id, toxic)`` where ``usable`` holds.

    A bounded hash-ordered sample of labelled documents gives the class counts; the prior
    comes from the words of all documents.  Ids labelled both ways count as toxic; null
    labels and ids are left out.  Without both classes nothing is toxic (or all is).
    """
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(
        "doc_id").agg(F.max("toxic").cast("int").alias("kind")).withColumn(
        "_hash", F.xxhash64("doc_id", F.lit(p.seed)))
    limits = smallest_by_hash(known, "kind", "_hash", p.docs_per_class)
    # At most two classes of docs_per_class ids: small enough for every task.
    sample = materialise(
        known.join(F.broadcast(limits), "kind").where(F.col("_hash") <= F.col("limit"))
        .select("doc_id", "kind"), "toxic-sample",
    )
    texts = docs.select("doc_id", "text")
    counted = materialise(
        texts.join(F.broadcast(sample), "doc_id", "left").select("text", "kind")
        .mapInArrow(_counts, "word string, rest bigint, clean bigint, toxic bigint")
        .groupBy("word").agg(*[F.sum(c).alias(c) for c in ("rest", "clean", "toxic")]), "words",
    )
    sums = counted.agg(F.sum("rest"), F.sum("clean"), F.sum("toxic")).first()
    rest, clean, toxic = (float(x or 0) for x in sums)
    if not toxic or not clean:
        return ToxicityModel(offset=50.0 if toxic and not clean else -50.0)
    alpha0, every = p.prior_share * (clean + toxic), rest + clean + toxic
    prior = F.lit(alpha0) * (F.col("rest") + F.col("clean") + F.col("toxic")) / F.lit(every)
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    delta = F.log(t / (F.lit(toxic + alpha0) - t)) - F.log(c / (F.lit(clean + alpha0) - c))
    scored = counted.select(
        "word", delta.alias("delta"), (delta / F.sqrt(1 / t + 1 / c)).alias("z"),
        (c / F.lit(clean + alpha0)).alias("share"),
    )
    kept = scored.where(F.abs("z") >= p.min_z).orderBy(F.desc(F.abs("z")), "word").limit(
        p.max_words).collect()
    weights = {r.word: r.delta - p.drift for r in kept}
    share = np.array([r.share for r in kept])
    score = np.array([r.delta - p.drift for r in kept])
    rate = _rate(np.append(score, -p.drift), np.append(share, max(0.0, 1 - share.sum())))
    tilted = share * np.exp(np.minimum(rate * score, 700))
    model = ToxicityModel(weights, p.drift, rate, max(1e-9, float(tilted[score > 0].sum())))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [evidence(text.as_py(), model)[0] for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)],
                                             names=["x", "kind"])

    rows = (
        texts.join(F.broadcast(sample), "doc_id").select("text", "kind")
        .mapInArrow(examples, "x double, kind int").groupBy("x", "kind").count()
        .orderBy(F.xxhash64("x", "kind", F.lit(p.seed))).limit(p.curve_points).collect()
    )
    x = np.repeat([r.x for r in rows], [r["count"] for r in rows])
    y = np.repeat([r.kind for r in rows], [r["count"] for r in rows])
    slope, offset = _curve(x, y)
    return ToxicityModel(weights, p.drift, rate, model.scale, slope, offset)


def score_toxicity(docs: DataFrame, model: ToxicityModel,
                   keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
                   carry_text: str | None = None) -> DataFrame:
    """``(keep..., score, passages)`` for every row of ``docs``, from its text alone.

    ``passages`` holds first and last token and score of every significant passage.  A
    null, empty or letterless text has no evidence and gets the curve's lowest score.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text"):
                x, found = evidence(text.as_py(), model)
                scores.append(1 / (1 + math.exp(-max(-50.0, min(50.0, model.slope * x
                                                                + model.offset)))))
                spans.append([{"first": a, "last": b, "score": s} for a, b, s in found])
            names = [c for c in batch.schema.names if c != "text"]
            span = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))],
                names=[*names, "score", "passages"],
            )

    cols = [F.col(c) for c in keep] + [F.col(text_col).alias("text")]
    if carry_text:
        cols.append(F.col(text_col).alias(carry_text))
    rows = docs.select(*cols)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(judge, ", ".join([
        *fields, "score double",
        "passages array<struct<first:bigint,last:bigint,score:double>>",
    ]))
