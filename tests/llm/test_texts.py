"""Language identification, toxicity and chat formatting."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinweave.llm.chat import (
    chat_digest, example_texts, expand_examples, format_conversations, read_turns,
)
from twinweave.llm.common import shares_of, smallest_by_hash
from twinweave.llm.language import LanguageParams, fit_language, identify_language, windows_of
from twinweave.llm.queries import op8_language, op10_toxicity
from twinweave.llm.toxicity import (
    ToxicityModel, ToxicityParams, evidence, fit_toxicity, passages, score_toxicity, tokens,
)

SF = "/root/testdata/sf0.01"
QUICK = LanguageParams(docs_per_lang=60, epochs=3)


def test_shares_follow_the_decimal_digits(spark):
    got = {r.id: r.h for r in spark.range(40).select("id", shares_of(F.col("id"), 5, 0).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(40)}
    assert spark.sql("select cast(null as bigint) id").select(shares_of(F.col("id"), 5, 0)).first()[0] is False


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 16, 100])
def test_windows_cover_every_byte(n):
    data = bytes(i % 251 + 1 for i in range(n))
    windows, weight = windows_of(data, 8)
    assert weight.sum() == max(1, n)
    assert set(data) <= set(windows.ravel().tolist())
    assert len(windows) == max(1, -(-n // 8))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op8_language(spark, SF).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and held
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, net = fit_language(docs, F.lit(True), QUICK)
    odd = spark.createDataFrame(
        [(1, None, 9), (2, "", 9), (3, "12 + 7² = Ⅷ *** !", 9), (None, "the thing and the other", 9),
         (5, "the thing " * 60_000, 9), (5, "the thing " * 60_000, 9)],
        "doc_id long, text string, score int")
    got = identify_language(odd, langs, net).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and {by[i].lang_pred for i in (1, 2, 3)} == {"und"}
    assert by[5].lang_pred == "en" and by[1].score == 0.0 and by[None].lang_pred in langs
    assert identify_language(odd.limit(0), langs, net).collect() == []
    none = fit_language(docs.where("lang is null"), F.lit(True), QUICK)
    assert none == ([], None)
    assert {r.lang_pred for r in identify_language(odd, *none).collect()} == {"und"}


def best_segments(scores):
    """All maximal segments by definition: split at the best one, again and again."""
    found = []

    def split(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (best is None or total > best[0] + 1e-9
                                     or abs(total - best[0]) <= 1e-9 and j - i < best[2] - best[1]):
                    best = (total, i, j)
        if best:
            found.append((best[1], best[2], round(best[0], 6)))
            split(a, best[1])
            split(best[2] + 1, b)

    split(0, len(scores))
    return sorted(found)


@pytest.mark.parametrize("seed", range(30))
def test_linear_scan_finds_the_maximal_segments(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-0.5, -0.5, -0.5, 1.37, 2.11, 0.73, -1.91]) + rng.random() / 1000
              if rng.random() < 0.6 else -0.5 for _ in range(40)]
    hits = [(i, s) for i, s in enumerate(scores) if s != -0.5]
    got = sorted((a, b, round(s, 6)) for a, b, s in passages(hits, 0.5))
    assert got == best_segments(scores)


def test_pieces_of_a_long_text_lose_no_token():
    text = "ab " * 700_000 + "z" * 3_000_000 + " end"
    words = [w for piece in tokens(text) for w in piece]
    assert len(words) == 700_002 and words[-2] == "z" * 3_000_000


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = op10_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.8
    assert np.mean([r.predicted for r in clean]) < 0.03


def test_toxicity_edge_rows(spark):
    docs = spark.createDataFrame(
        [(i, "good day to all of you " * 5 + ("vile scum " * 6 if i % 2 else "")) for i in range(200)],
        "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(200)] + [(None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels, F.lit(True))
    assert model.weights["scum"] > 0
    odd = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, "1 2 3", 1), (4, "vile scum vile scum vile scum", 1),
         (4, "vile scum vile scum vile scum", 1), (None, "good day", 1)],
        "doc_id long, text string, passages int")
    got = score_toxicity(odd, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[4].score > 0.5 > by[1].score == by[2].score == by[3].score
    assert by[4].passages[0].first == 0 and by[4].passages[0]["last"] == 5
    assert score_toxicity(odd.limit(0), model).collect() == []
    nothing = fit_toxicity(docs, labels.where("toxic = 0"), F.lit(True))
    assert evidence("vile", nothing)[0] == 0 and nothing.weights == {}
    assert score_toxicity(odd, nothing).agg(F.max("score")).first()[0] < 0.01
    assert fit_toxicity(docs.limit(0), labels.limit(0), F.lit(True)) == ToxicityModel(offset=-50.0)
    assert ToxicityParams().docs_per_class > 0


HARD = ["", "\\", "\\b", "###", "####", "### User: ", "</turn>", "</turn>\n### Assistant: x", "\\h\\e\\c",
        "a: b", None, "é\U0001f600\n\n", "<\\/turn>", "</tu###rn>", "x" * 5000]


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 150 if conv == 3 else 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "to: ol###", "", None]),
                         rng.choice(HARD)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_chat_round_trip_and_digests(spark, seed):
    rows = conversations(seed) + [(None, 1, "assistant", "lost"), (50, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        want.setdefault(conv, []).append((role or "", text or ""))
    back = format_conversations(df).select("conv_id", read_turns(F.col("formatted")).alias("t")).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.t] for r in back} == want
    digest = {r.conv_id: r for r in chat_digest(df).collect()}
    for conv, turns in want.items():
        r, loss = digest[conv], "".join(t for role, t in turns if role == "assistant")
        both = "".join(f"{a}\n{b}\n" for a, b in turns)
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(both.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_each_reply_is_an_example_after_all_turns_before_it(spark):
    df = spark.createDataFrame(
        [(1, 0, "system", "be"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
         (1, 3, "user", "q2"), (1, 4, "assistant", "###"), (1, 5, "user", "q3")],
        "conv_id long, turn long, role string, text string")
    got = {r.example: r for r in example_texts(expand_examples(format_conversations(df))).collect()}
    head = "### system: be</turn>\n### user: q1</turn>\n### assistant: a1</turn>\n"
    assert got[0].text == head
    assert got[1].text == head + "### user: q2</turn>\n### assistant: \\h</turn>\n"
    cut = lambda r: r.text[r.loss_begin - 1:r.loss_begin - 1 + r.loss_length]
    assert (cut(got[0]), cut(got[1])) == ("a1", "\\h") and len(got) == 2


def test_repeated_turns_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, run int"
    df = spark.createDataFrame([(1, 0, "assistant", "x", "f", 1)] * 3, schema)
    r = chat_digest(df).first()
    assert (r.n_turns, r.loss_chars) == (3, 3)
    assert chat_digest(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 3, 50, 400, 5_000])
def test_smallest_by_hash_is_the_nth_smallest(spark, n):
    rng = random.Random(n)
    rows = [(k, h) for k, most in (("a", 63), ("b", 50), ("c", 40)) for h in
            (rng.randrange(-2**most, 2**most) for _ in range(600))]
    rows += [("d", 7)] * 30 + [("e", -5)]
    got = {r.k: r.limit for r in smallest_by_hash(
        spark.createDataFrame(rows, "k string, h long"), "k", "h", n).collect()}
    assert got == {k: sorted(h for x, h in rows if x == k)[:n][-1] for k in "abcde"}


def test_chat_digest_is_read_from_the_written_examples(spark):
    """Counts and lengths are those of the prefixes, a long conversation over several runs included."""
    told = [("user" if i % 2 == 0 else "assistant", f"turn {i} " + "x" * (i % 7)) for i in range(150)]
    turns = [(1, i, role, text) for i, (role, text) in enumerate(told)] + [(2, 0, "user", "alone"), (3, 0, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.examples, r.example_chars, r.loss_chars) for r in chat_digest(df).collect()}
    at, ends = 0, []
    for role, text in told:
        at += len(f"### {role}: {text}</turn>\n")
        if role == "assistant":
            ends.append(at)
    assert got[1] == (75, sum(ends), sum(len(t) for r, t in told if r == "assistant"))
    assert got[2] == (0, 0, 0)
    assert got[3] == (1, len("### assistant: </turn>\n"), 0)
