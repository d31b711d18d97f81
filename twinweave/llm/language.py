"""Language identification by a byte convolutional network.

Filters of several widths run over embedded bytes, each filter's largest answer in a
window feeds a softmax.  The network is trained in NumPy on a bounded sample of labelled
windows and applied to every fixed-length window of every text in Arrow batches; a text's
probabilities are the mean over its windows, weighed by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import SEED, smallest_by_hash

LETTER = re.compile(r"\p{L}")
UNDECIDED = "und"


@dataclass(frozen=True)
class LanguageParams:
    """``docs_per_lang`` and ``windows_per_doc`` bound the labelled sample of the fit."""

    docs_per_lang: int = 400
    windows_per_doc: int = 6
    window: int = 128
    embed: int = 8
    filters: int = 16
    widths: tuple[int, ...] = (2, 3, 4)
    epochs: int = 6
    batch: int = 64
    rate: float = 0.004
    seed: int = SEED


def windows_of(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text and the bytes each stands for; the last one ends at its end."""
    raw = np.frombuffer(data, np.uint8)
    n = max(1, -(-len(raw) // size))
    out = np.zeros((n, size), np.uint8)
    whole = len(raw) // size
    out[:whole] = raw[:whole * size].reshape(whole, size)
    rest = len(raw) - whole * size
    if rest and whole:
        out[-1] = raw[-size:]
    elif rest:
        out[0, :rest] = raw
    weight = np.full(n, size, np.float64)
    if rest or not whole:
        weight[-1] = max(1, rest)
    return out, weight


class ByteNet:
    """Embedding, multi-width filters, max pooling, softmax."""

    def __init__(self, n_langs: int, p: LanguageParams):
        rng = np.random.default_rng(p.seed)
        self.widths = p.widths
        normal = lambda *s: rng.normal(0, 1, s).astype(np.float32)
        self.embed = normal(256, p.embed) * 0.5
        self.filters = [normal(k * p.embed, p.filters) / np.float32(np.sqrt(k * p.embed))
                        for k in p.widths]
        self.bias = np.zeros(len(p.widths) * p.filters, np.float32)
        self.out = normal(len(self.bias), n_langs) * 0.1
        self.out_bias = np.zeros(n_langs, np.float32)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        x = self.embed[windows]
        n, size, d = x.shape
        tops, seen, where = [], [], []
        for k, w in zip(self.widths, self.filters):
            cols = np.lib.stride_tricks.sliding_window_view(
                x.reshape(n, size * d), k * d, axis=1)[:, ::d]
            flat = np.ascontiguousarray(cols).reshape(-1, k * d)
            answer = (flat @ w).reshape(n, size - k + 1, -1)
            tops.append(answer.max(axis=1))
            seen.append(flat)
            where.append(answer)
        return np.concatenate(tops, axis=1), seen, where

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        top = np.maximum(self.pooled(windows)[0] + self.bias, 0)
        z = top @ self.out + self.out_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, windows: np.ndarray, y: np.ndarray, p: LanguageParams) -> None:
        """Adam on the cross entropy, windows in a seeded order."""
        rng = np.random.default_rng(p.seed + 1)
        params = [self.embed, *self.filters, self.bias, self.out, self.out_bias]
        first = [np.zeros_like(a) for a in params]
        second = [np.zeros_like(a) for a in params]
        step, d = 0, self.embed.shape[1]
        for _ in range(p.epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), p.batch):
                pick = order[at:at + p.batch]
                w, t = windows[pick], y[pick]
                top, seen, where = self.pooled(w)
                lin = top + self.bias
                hidden = np.maximum(lin, 0)
                z = hidden @ self.out + self.out_bias
                e = np.exp(z - z.max(axis=1, keepdims=True))
                g = e / e.sum(axis=1, keepdims=True)
                g[np.arange(len(t)), t] -= 1
                g /= len(t)
                back = (g @ self.out.T) * (lin > 0)
                grads = [np.zeros_like(self.embed)]
                nf = self.filters[0].shape[1]
                for i, (k, f) in enumerate(zip(self.widths, self.filters)):
                    gb = back[:, i * nf:(i + 1) * nf]
                    best = where[i].argmax(axis=1)
                    rows = (np.arange(len(t))[:, None] * where[i].shape[1] + best)
                    cols = seen[i][rows]
                    grads.append(np.einsum("nf,nfd->df", gb, cols))
                    spread = (gb[:, :, None] * f.T[None]).reshape(len(t), nf, k, d)
                    at_byte = best[:, :, None] + np.arange(k)
                    np.add.at(grads[0], w[np.arange(len(t))[:, None, None], at_byte], spread)
                grads += [back.sum(0), hidden.T @ g, g.sum(0)]
                step += 1
                for a, da, m, v in zip(params, grads, first, second):
                    m += 0.1 * (da - m)
                    v += 0.001 * (da * da - v)
                    a -= (p.rate * (m / (1 - 0.9**step))
                          / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _sample(docs: DataFrame, usable: Column, p: LanguageParams) -> list[tuple[str, str]]:
    """Labelled windows: at most ``docs_per_lang`` documents per language, by id hash."""
    size = F.lit(p.window)
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn(
        "_hash", F.xxhash64("doc_id", F.lit(p.seed))
    )
    limits = smallest_by_hash(rows, "lang", "_hash", p.docs_per_lang)
    chosen = rows.join(F.broadcast(limits), "lang").where(F.col("_hash") <= F.col("limit"))
    room = F.greatest(F.char_length("text") - size, F.lit(1))
    cut = F.array(*[
        F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(i)), room).cast("int") + 1, size)
        for i in range(p.windows_per_doc)
    ])
    found = chosen.select("lang", "_hash", F.array_distinct(cut).alias("cut"))
    # Repeated ids share a hash; the second bound keeps what comes to the driver fixed.
    most = p.docs_per_lang * limits.count()
    rows = found.orderBy("_hash", "lang", "cut").limit(most).collect()
    return [(r.lang, c) for r in rows for c in r.cut if LETTER.search(c)]


def fit_language(docs: DataFrame, usable: Column,
                 p: LanguageParams = LanguageParams()) -> tuple[list[str], ByteNet | None]:
    """Languages in order and the trained network (None without a labelled letter)."""
    sample = _sample(docs, usable, p)
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return [], None
    windows, y = [], []
    for lang, cut in sample:
        w, _ = windows_of(cut.encode("utf-8", "replace")[:p.window], p.window)
        windows.append(w)
        y += [langs.index(lang)] * len(w)
    net = ByteNet(len(langs), p)
    net.fit(np.concatenate(windows), np.array(y), p)
    return langs, net


def _predictor(langs: list[str], net: ByteNet | None, size: int, at_once: int = 1_024):
    def flush(queue: list[tuple[int, np.ndarray, np.ndarray]], total: np.ndarray) -> None:
        if not queue:
            return
        probs = net.probabilities(np.concatenate([w for _, w, _ in queue]))
        weight = np.concatenate([x for _, _, x in queue])
        rows = np.repeat([i for i, _, _ in queue], [len(x) for _, _, x in queue])
        np.add.at(total, rows, probs * weight[:, None])
        queue.clear()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            total = np.zeros((n, max(1, len(langs))))
            queue, waiting = [], 0
            for i, value in enumerate(batch.column("text") if net else []):
                text = value.as_py()
                if text is None or not LETTER.search(text):
                    continue
                windows, weight = windows_of(text.encode("utf-8", "replace"), size)
                for a in range(0, len(windows), at_once):
                    queue.append((i, windows[a:a + at_once], weight[a:a + at_once]))
                    waiting += len(queue[-1][2])
                    if waiting >= at_once:
                        flush(queue, total)
                        waiting = 0
            if net:
                flush(queue, total)
            sums = total.sum(axis=1)
            known = sums > 0
            best = total.argmax(axis=1)
            score = np.where(known, total[np.arange(n), best] / np.where(known, sums, 1), 0.0)
            names = [langs[b] if k else UNDECIDED for b, k in zip(best, known)]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))],
                names=[*keep, "lang_pred", "score"],
            )

    return predict


def identify_language(docs: DataFrame, langs: list[str], net: ByteNet | None,
                      p: LanguageParams = LanguageParams(), keep: tuple[str, ...] = ("doc_id",),
                      text_col: str = "text", carry_text: str | None = None) -> DataFrame:
    """``(keep..., lang_pred, score)`` for every row of ``docs``, from its text alone.

    ``score`` is the mean probability of the language named.  A null text, one without a
    letter, and every text when no language was learned are ``und`` with score 0.  Repeated
    rows come back as often as they came.
    """
    cols = [F.col(c) for c in keep] + [F.col(text_col).alias("text")]
    if carry_text:
        cols.append(F.col(text_col).alias(carry_text))
    rows = docs.select(*cols)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(
        _predictor(langs, net, p.window),
        ", ".join([*fields, "lang_pred string", "score double"]),
    )
