"""Collocations, whitening and byte-pair encoding."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinweave.llm import collocations as mining
from twinweave.llm.bytepairs import (
    decode_ids, encode_texts, fragments, load_vocabulary, merge_fragment, text_encoder,
)
from twinweave.llm.collocations import CollocationParams, collocations, count_phrases
from twinweave.llm.eigen import count_below, leading_eigenpairs, tridiagonal
from twinweave.llm.oracle import ORACLE_SQL
from twinweave.llm.queries import op11_collocations, op12_whitening, op13_byte_pairs
from twinweave.llm.whitening import fit_whitening, whiten, whitened_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"

# -- collocations -------------------------------------------------------------


def plain_counts(rows):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return counts, words


def plain_collocations(rows, p):
    counts, words = plain_counts(rows)
    out = set()
    for lang, c in counts.items():
        found = {}
        for g, a in c.items():
            if len(g) > 1 and a >= p.min_count:
                found[g] = min((p.scale * a // (c[g[:k]] + c[g[k:]]), k, c[g[:k]], c[g[k:]])
                               for k in range(1, len(g)))

        def covered(g):
            return any(len(h) > len(g) and 100 * c[h] >= p.covered * c[g]
                       and any(h[i:i + len(g)] == g for i in range(len(h))) for h in found)

        best = sorted((-s[0], -c[g], " ".join(g).encode(), s) for g, s in found.items() if not covered(g))
        for rank, (score, a, phrase, s) in enumerate(best[:p.top], 1):
            out.add((lang, rank, phrase.decode(), -a, s[2], s[3], words[lang], -score))
    return out


def hard_rows():
    r = random.Random(5)
    words = ["the", "The", "of", "Öl", "öl", "a", "b", "x-y", "'", "\x0b", "\x00", "日本", "é"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 40))) +
             r.choice(["", ".", "\r\n", "  ", "\t", "!?"]) + " ".join(r.choice(words) for _ in range(9)),
             r.choice(["en", "de", None, "und", ""]), "s") for i in range(400)]
    rows += [(None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s"), (2, " \t ", "fr", "s"),
             (3, "...", None, "s"), (4, "w" * 5_000 + " " + "of the " * 3_000, "en", "s")]
    rows += [(7, "a hot passage of many words, again a hot passage", "en", "s")] * 300
    return rows


@pytest.mark.parametrize("sample_of,window", [(10, 1 << 22), (1_000_000, 1 << 22), (1, 64), (3, 1_000)])
def test_collocations_are_exact_whatever_the_sample(spark, monkeypatch, sample_of, window):
    monkeypatch.setattr(mining, "WINDOW", window)
    monkeypatch.setattr(mining, "HELD", window)
    rows = hard_rows()
    p = CollocationParams(min_count=20, top=40, sample_of=sample_of, filter_bits=12)
    df = spark.createDataFrame(rows, DOCS).withColumns({
        "k": F.lit(1), "phrase": F.lit("x"), "rank": F.lit(2), "c": F.lit(3), "score": F.lit(1)})
    got = [tuple(x) for x in collocations(df.repartition(3), p).collect()]
    assert len(got) == len(set(got)) > 20
    assert set(got) == plain_collocations([(r[2], r[1]) for r in rows], p)


def test_border_failures_open_further_passes(spark):
    rows = [(i, "one two three four", "en", "s") for i in range(50)]
    # Nothing is proposed: words fail first, then what they open, up to four words.
    p = CollocationParams(sample_of=1 << 30)
    found, passes = count_phrases(spark.createDataFrame(rows, DOCS), p)
    assert passes == 4
    assert {tuple(r) for r in found.where("k = 4").collect()} == {("en", 4, "one two three four", 50)}
    # Everything is proposed: one pass.
    found, passes = count_phrases(spark.createDataFrame(rows, DOCS), CollocationParams(sample_of=1))
    assert passes == 1 and found.where("k = 4").count() == 1


def test_proposal_is_what_spares_counting(spark):
    """Rare pairs are counted only where both words are proposed or turn out frequent."""
    rows = [(i, f"hot word{i} hot word{i + 1}", "en", "s") for i in range(100)]
    texts = mining._texts(spark.createDataFrame(rows, DOCS), "lang", "text")
    def marks_of(*phrases):
        table = np.zeros(1 << 14, np.uint64)
        if phrases:
            one = mining._texts(spark.createDataFrame([(1, p, "en", "s") for p in phrases], DOCS), "lang", "text")
            none = spark.sparkContext.broadcast(table)
            table, _ = mining._with_marks(table, mining._border_pass(one, none, None, 20).select("h"), 20)
        return spark.sparkContext.broadcast(table)

    def border(*phrases, before=None):
        return mining._border_pass(texts, marks_of(*phrases), before, 20).count()

    assert border() == 102                               # words only
    assert border("hot") == 101                          # the others are the border
    assert border("hot", "word7") == 100 + 2             # and "hot word7", "word7 hot"
    assert border("hot", "word7", before=marks_of("hot")) == 2


def test_ranks_in_rounds_of_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(mining, "RANKED", 10)
    rows = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"),
        F.concat(F.lit("p"), F.col("id")).alias("phrase"), (F.col("id") % 7).alias("score"),
        (F.col("id") % 5).alias("a"))
    got = {(r.lang, r["rank"], r.phrase) for r in mining._first_rows(rows, 6).collect()}
    want = set()
    for lang in ("en", "de"):
        mine = sorted((-r.score, -r.a, r.phrase) for r in rows.collect() if r.lang == lang)
        want |= {(lang, i, x[2]) for i, x in enumerate(mine[:6], 1)}
    assert got == want


def test_collocations_beyond_64_bits(spark):
    big = 1 << 62
    found = spark.createDataFrame(
        [("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 1)], "lang string, k int, phrase string, c long")
    p = CollocationParams()
    row = mining._uncovered(mining._scored(found, p), p).first()
    assert row.score == p.scale * (big - 1) // (2 * big)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert collocations(empty).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None, None)], DOCS)).count() == 0


def test_collocations_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(ORACLE_SQL["op11_collocations"]).fetchall())
    assert sorted(tuple(r) for r in op11_collocations(spark, SF).collect()) == want and want


# -- whitening ----------------------------------------------------------------


@pytest.mark.parametrize("name", ["random", "repeated", "near", "rank", "one", "zero", "block", "diagonal"])
def test_leading_eigenpairs(name):
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.normal(size=(12, 12)))[0]
    m = r.normal(size=(40, 3))
    a = {
        "random": q @ np.diag(r.uniform(0, 9, 12)) @ q.T, "repeated": q @ np.diag([5.] * 4 + [2.] * 8) @ q.T,
        "near": q @ np.diag([5, 5 - 1e-12, 5 - 1e-9, 5 - 1e-6, *[1.0] * 8]) @ q.T, "rank": m @ m.T,
        "one": np.array([[2.0]]), "zero": np.zeros((4, 4)),
        "block": np.kron(np.eye(4), [[2.0, 1.0], [1.0, 2.0]]), "diagonal": np.diag(np.arange(9.0)),
    }[name]
    a = (a + a.T) / 2
    values, vectors = leading_eigenpairs(a, 8)
    want = np.linalg.eigvalsh(a)[::-1][:8]
    assert np.allclose(values, want, atol=1e-13 * max(1, want[0]))
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * max(1, want[0])
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-13


def test_tridiagonal_form_and_sturm_counts():
    r = np.random.default_rng(2)
    a = r.normal(size=(9, 9))
    a = a + a.T
    d, b, q = tridiagonal(a)
    t = np.diag(d) + np.diag(b, 1) + np.diag(b, -1)
    assert np.allclose(q @ t @ q.T, a) and np.allclose(q.T @ q, np.eye(9))
    w = np.linalg.eigvalsh(a)
    x = np.array([w[0] - 1, (w[2] + w[3]) / 2, w[-1] + 1])
    assert count_below(d, b, x).tolist() == [0, 3, 9]


def vector_rows():
    r = np.random.default_rng(4)
    rows = [(int(i), r.normal(size=3).tolist()) for i in range(60)]
    rows += [(None, [9.0, 2.0, -3.5]), (3, [1.0, 1.0, 1.0]), (3, [1.0, 1.0, 1.0]), (70, None), (71, []),
             (72, [float("nan"), 1.0, 2.0]), (73, [None, 1.0, 2.0]), (74, [float("inf"), 0.0, 0.0]),
             (75, [1.0]), (76, [1.0, 2.0, 3.0, 4.0])]
    return rows


def test_whitening_by_definition(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({
        "component": F.lit(9), "whitened": F.lit("x"), "n": F.lit(1), "deviation": F.lit(1)})
    got = whitened_components(df.repartition(4)).collect()
    whole = [(i, [int(np.floor(1024 * c)) + 100000 for c in v]) for i, v in rows
             if v is not None and len(v) == 3 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in whole])
    n, s = len(x), x.sum(axis=0)
    d = x - s / n
    e, vec = np.linalg.eigh(d.T @ d / n)
    e, vec = e[::-1], vec[:, ::-1]
    w = d @ vec / np.sqrt(e)
    assert len(got) == 3 * n and {r.n for r in got} == {n}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-12
    for k in range(3):
        mine = sorted((r.deviation, r.whitened, -1 if r.vec_id is None else r.vec_id) for r in got if r.component == k + 1)
        dev = [int(((n * v - s) ** 2).sum()) for v in x]
        sign = 1 if np.isclose(sorted(zip(dev, w[:, k]))[0][1], mine[0][1]) else -1
        want = sorted((a, sign * b, -1 if i is None else i) for a, b, (i, _) in zip(dev, w[:, k], whole))
        assert [(m[0], m[2]) for m in mine] == [(m[0], m[2]) for m in want]
        assert np.allclose([m[1] for m in mine], [m[1] for m in want], atol=1e-9)
        explained = {r.explained for r in got if r.component == k + 1}
        assert len(explained) == 1 and abs(explained.pop() - e[k] / e.sum()) < 1e-12


def test_whitening_leaves_out_what_has_no_variance(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitened_components(make([])).count() == 0
    assert whitened_components(make([(1, None)])).count() == 0
    assert whitened_components(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitened_components(make([(1, [1.0, 2.0]), (2, [1.0, 4.0])])).collect()
    assert {(r.vec_id, r.component) for r in flat} == {(1, 1), (2, 1)}
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in flat)


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [2.0 ** 40 * (i % 2), 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whiten(df, fit_whitening(df)).collect()
    assert {int(r.deviation) for r in got} == {(20 * 2 ** 50) ** 2}


def test_whitening_query_is_whole(spark):
    got = op12_whitening(spark, SF)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert got.count() == 8 * n and dict(got.dtypes)["deviation"] == "bigint"
    assert got.agg(F.max("identity_error")).first()[0] <= 1e-4


# -- byte pairs ---------------------------------------------------------------

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_ids_are_the_librarys(vocabulary, library):
    r = random.Random(3)
    bits = list("ab '  \n\t.!9é中՘ \x00\x1c\x85\U0001F600‍٣½ªǅ퟿") + [
        "'s", "'ll", "<|endoftext|>", "<|endoftext", "the ", "  ", "\r\n", "a" * 90, "字符" * 40, "ſ", "É" * 70]
    encode = text_encoder(vocabulary)
    for _ in range(5_000):
        s = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert ids_of(encode(s)) == library.encode(s, add_special_tokens=False).ids, s
    for c in [*range(0xD800), *range(0xE000, 0x110000, 61)]:
        s = f"a{chr(c)}1 {chr(c)}{chr(c)} '"
        assert ids_of(encode(s)) == library.encode(s, add_special_tokens=False).ids, hex(c)


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 50_000, " " * 50_000 + "x", "\n\t" * 20_000,
                                  "x y" * 800_000, "1 <|endoftext|>" * 5_000, "é" * 60_000])
def test_very_long_texts(vocabulary, library, text):
    assert ids_of(text_encoder(vocabulary)(text)) == library.encode(text, add_special_tokens=False).ids


def test_cuts_are_certain(vocabulary):
    """Cut or whole, the merges give the same; and natural words really are cut."""
    first, merges, inside = (vocabulary[k] for k in ("first", "merges", "inside"))
    words = ["Straße", "don’t", " naïve", "qzxq", "日本語テキスト", "x y", "\U0001F600\U0001F601"]
    cuts = 0
    for word in words:
        data = word.encode()
        parts = fragments(data, inside)
        assert b"".join(parts) == data
        cuts += len(parts) - 1
        apart = [i for p in parts for i in merge_fragment([first[b] for b in p], merges)]
        assert apart == merge_fragment([first[b] for b in data], merges)
    assert cuts >= 5
    held = set(vocabulary["bytes"])
    for a, b in ((p[-1:], q[:1]) for w in words for p, q in zip(fragments(w.encode(), inside), fragments(w.encode(), inside)[1:])):
        assert not any(a + b in token for token in held)


def test_encoded_and_decoded_rows(spark, vocabulary, library):
    rows = [(1, "Hello <|endoftext|> wörld", "en"), (1, "Hello <|endoftext|> wörld", "en"), (None, "", None),
            (2, None, "en"), (3, "\x00  ok", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {"ids": F.lit("clash"), "n_tokens": F.lit(1)})
    encoded = encode_texts(df, vocabulary)
    decoded = decode_ids(encoded, PATH)
    assert encoded.columns == ["doc_id", "ids"] and decoded.columns == ["doc_id", "text"]
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert Counter((r.doc_id, tuple(ids_of(r.ids))) for r in encoded.collect()) == want
    assert Counter(map(tuple, decoded.collect())) == Counter((i, t or "") for i, t, _ in rows)
    assert encode_texts(df.limit(0), vocabulary).count() == 0
    broken = spark.createDataFrame([(1, bytearray(np.array([447], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    assert {tuple(r) for r in decode_ids(broken, vocabulary).collect()} == {
        (1, library.decode([447], skip_special_tokens=False)), (2, "")}


def test_byte_pair_query_is_the_librarys(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in docs:
        ids = library.encode(r.text, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in op13_byte_pairs(spark, SF).collect()]
    assert len(got) == len(docs) and set(got) == want
