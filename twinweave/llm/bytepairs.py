"""Byte-pair encoding and decoding of whole texts, by forced boundaries.

A token of the vocabulary is a string of bytes.  Two neighbouring bytes that stand side by
side in no token at all can never be joined by any merge, so the place between them is a
certain cut.  Every word is cut there, the fragments are encoded independently of each
other, and their ids are put one after the other.  A fragment is merged by rank with a
heap, so its time is near linear in its length.

The vocabulary is read once by the driver and broadcast; its size is that of the file.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed value: the pattern that splits text into words before any merge.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters after which a long text may be cut at the next white space.
PIECE = 1 << 18
# Words and fragments a worker remembers, and the longest word it does.
MEMO_WORDS = 400_000
MEMO_LENGTH = 32
# Rows that are handed on together, so that memory follows few texts.
ROWS = 256
_SHORT = 64
_NEVER = 1 << 62
# Texts whose characters all lie below this one are split by the faster standard matcher.
LATIN_END = 0x250


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte: itself, or the next free one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _unassigned_class() -> str:
    """Ranges of letters, digits and spaces that ``regex`` knows and the vocabulary's library,
    with an earlier Unicode, does not; that library takes them for other signs."""
    unknown = "".join(chr(c) for c in range(sys.maxunicode + 1)
                      if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn")
    points = [ord(c) for c in regex.findall(r"[\p{L}\p{N}\s]", unknown)]
    ranges: list[list[int]] = []
    for p in points:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def latin_words() -> re.Pattern:
    """``WORDS`` for texts of characters below ``LATIN_END``, with its classes spelt out."""
    low = [chr(c) for c in range(LATIN_END)]
    letter, number = ("".join(c for c in low if unicodedata.category(c)[0] == k) for k in "LN")
    space = "".join(re.escape(c) for c in low if regex.match(r"\s", c))
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+")


def load_vocabulary(path: str) -> dict:
    """Plain tables of a byte-level BPE file of the ``tokenizers`` library.

    ``merges`` maps a pair of ids to rank and id of the merged token, ``bytes`` has the
    bytes of every id, ``inside`` marks the byte pairs that some token holds.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], _byte_letters()
    held = {word: bytes(letters[c] for c in word) for word in vocab}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    table = [b""] * (1 + max([*vocab.values(), *added.values()]))
    for word, i in vocab.items():
        table[i] = held[word]
    for content, i in added.items():
        table[i] = content.encode("utf-8")
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
    inside = np.zeros(1 << 16, bool)
    for word in held.values():
        b = np.frombuffer(word, np.uint8).astype(np.int64)
        inside[b[:-1] << 8 | b[1:]] = True
    return {
        "merges": merges, "bytes": table, "inside": inside.tobytes(), "added": added,
        "first": [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])],
        "odd": _unassigned_class(),
    }


def merge_fragment(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Merge the pair of lowest rank, the leftmost of equals, until none is left."""
    if len(ids) <= _SHORT:
        ranks = [merges.get(a << 32 | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            ids[i:i + 2] = [best & 0xFFFFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = merges.get(ids[i - 1] << 32 | ids[i], _NEVER)
            if i < len(ranks):
                ranks[i] = merges.get(ids[i] << 32 | ids[i + 1], _NEVER)
        return ids
    n = len(ids)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := merges.get(a << 32 | b))]
    heapq.heapify(heap)
    while heap:
        merged, i = heapq.heappop(heap)
        j = right[i]
        if ids[i] < 0 or j >= n or merges.get(ids[i] << 32 | ids[j]) != merged:
            continue
        ids[i], ids[j] = merged & 0xFFFFFFFF, -1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if m := merges.get(ids[i] << 32 | ids[k]):
                heapq.heappush(heap, (m, i))
        if left[i] >= 0 and (m := merges.get(ids[left[i]] << 32 | ids[i])):
            heapq.heappush(heap, (m, left[i]))
    return [x for x in ids if x >= 0]


def fragments(word: bytes, inside: bytes) -> list[bytes]:
    """``word`` cut wherever its two neighbouring bytes stand together in no token."""
    if len(word) <= _SHORT:
        cuts = [i for i in range(1, len(word)) if not inside[word[i - 1] << 8 | word[i]]]
    else:
        b = np.frombuffer(word, np.uint8).astype(np.int64)
        known = np.frombuffer(inside, bool)[b[:-1] << 8 | b[1:]]
        cuts = (np.flatnonzero(~known) + 1).tolist()
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]


def _remembering(make: Callable) -> dict:
    class Memo(dict):
        def __missing__(self, key):
            value = make(key)
            if len(key) <= MEMO_LENGTH:
                if len(self) >= MEMO_WORDS:
                    self.clear()
                self[key] = value
            return value

    return Memo()


def text_encoder(vocabulary: dict) -> Callable[[str], bytes]:
    """Function from a text to its ids as little-endian unsigned 32-bit integers."""
    merges, inside, first = (vocabulary[k] for k in ("merges", "inside", "first"))
    # An array of C ints is little-endian on every machine Spark's Arrow path runs on.
    code = next(c for c in "IL" if array(c).itemsize == 4)

    def of_fragment(part: bytes) -> bytes:
        return array(code, merge_fragment([first[b] for b in part], merges)).tobytes()

    parts = _remembering(of_fragment)

    def of_word(word: str) -> bytes:
        cut = fragments(word.encode("utf-8"), inside)
        return parts[cut[0]] if len(cut) == 1 else b"".join([parts[p] for p in cut])

    lookup = _remembering(of_word).__getitem__
    words, latin, beyond = regex.compile(WORDS), latin_words(), re.compile(f"[^\\0-{chr(LATIN_END - 1)}]")
    odd = regex.compile(f"[{vocabulary['odd']}]") if vocabulary["odd"] else None
    added = {k: array(code, [v]).tobytes() for k, v in vocabulary["added"].items()}
    longest_first = sorted(added, key=len, reverse=True)
    special = re.compile("|".join(map(re.escape, longest_first))) if added else None
    edge = re.compile(r"\S(?= )")

    def of_plain(text: str) -> Iterator[bytes]:
        # No word holds a space after another sign, so a long text may be cut there.
        at = 0
        while at < len(text):
            found = edge.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = found.end() if found else len(text)
            piece = text[at:end] if at or found else text
            at = end
            if piece.isascii() or not beyond.search(piece):
                yield from map(lookup, latin.findall(piece))
            elif odd is not None and odd.search(piece):
                spans = words.finditer(odd.sub("￿", piece))
                yield from (lookup(piece[m.start():m.end()]) for m in spans)
            else:
                yield from map(lookup, words.findall(piece))

    def encode(text: str) -> bytes:
        if special is None or not special.search(text):
            return b"".join(of_plain(text))
        out, at = [], 0
        for m in special.finditer(text):
            out += [*of_plain(text[at:m.start()]), added[m.group()]]
            at = m.end()
        return b"".join([*out, *of_plain(text[at:])])

    return encode


def _few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))


def _kept(batch: pa.RecordBatch, n: int) -> list[pa.Array]:
    return [batch.column(i) for i in range(n)]


def encode_texts(docs: DataFrame, vocabulary: str | dict, keep: tuple[str, ...] = ("doc_id",),
                 text: str = "text") -> DataFrame:
    """``keep...`` and ``ids binary``: the token ids as little-endian unsigned 32-bit integers.

    One row per row of ``docs``, repeated rows included; a null text counts as empty and
    has no ids, other columns of ``docs`` play no part.  Strings of added tokens inside a
    text become those tokens.  Texts of any length are encoded whole; memory is a few times
    the longest text.  ``vocabulary`` is a path or what ``load_vocabulary`` returned.
    """
    loaded = vocabulary if isinstance(vocabulary, dict) else load_vocabulary(vocabulary)
    shared, n = docs.sparkSession.sparkContext.broadcast(loaded), len(keep)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "encode" not in held:  # kept with the broadcast: the next task of the worker has it
            held["encode"] = text_encoder(held)
        of_text = held["encode"]
        for batch in _few_rows(batches):
            ids = pa.array([of_text(t.as_py() or "") for t in batch.column(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([*_kept(batch, n), ids], names=[*keep, "ids"])

    rows = docs.select(*keep, text)
    schema = T.StructType([*rows.schema.fields[:n], T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(encode, schema)


def decode_ids(encoded: DataFrame, vocabulary: str | dict, keep: tuple[str, ...] = ("doc_id",),
               ids: str = "ids") -> DataFrame:
    """``keep...`` and ``text``: what the ids stand for, special tokens included.

    Null ids give an empty text.  Bytes that are no UTF-8 become U+FFFD; an id outside the
    vocabulary fails the job.
    """
    loaded = vocabulary if isinstance(vocabulary, dict) else load_vocabulary(vocabulary)
    shared, n = encoded.sparkSession.sparkContext.broadcast({"bytes": loaded["bytes"]}), len(keep)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value["bytes"]
        for batch in _few_rows(batches):
            texts = [
                b"".join(map(table.__getitem__, np.frombuffer(x.as_py() or b"", "<u4").tolist()))
                .decode("utf-8", "replace") for x in batch.column(n)
            ]
            yield pa.RecordBatch.from_arrays(
                [*_kept(batch, n), pa.array(texts, pa.string())], names=[*keep, "text"])

    rows = encoded.select(*keep, ids)
    schema = T.StructType([*rows.schema.fields[:n], T.StructField("text", T.StringType())])
    return rows.mapInArrow(decode, schema)
