import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from twinweave.llm.mixing import mix_sources, words_taken
from twinweave.llm.queries import QUERIES
from twinweave.llm.simhash import simhash_groups

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 14))


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(10_000, "12345 *** 99", None, "x", 3), (10_001, None, None, None, None), (10_002, "", "en", None, 0)],
        docs.schema)
    now, seen = docs.unionByName(odd), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        seen[name] = (now, out)
        if name != "packing":
            assert out.columns == docs.columns
        now = out
    language = {r.doc_id for r in seen["language"][1].collect()}
    assert not language & {10_000, 10_001, 10_002} and len(language) >= 195
    kept = [r.doc_id for r in seen["near-duplicates"][1].collect()]
    groups = simhash_groups(seen["near-duplicates"][0]).collect()
    assert sorted(kept) == sorted({r.component_id for r in groups})
    before, after = seen["mixing"]
    words = lambda df: df.select(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))).first()[0]
    assert abs(words(after) - 1.5 * words(before)) < 0.05 * words(before)
    assert words_taken(mix_sources(before)).where("taken > 2 * size").count() == 0
    packed = seen["packing"][1].agg(F.sum("length")).first()[0]
    assert packed == words(after)


def test_stages_take_columns_of_any_name(spark):
    clash = {c: F.lit(7) for c in ("score", "lang_pred", "passages", "text_", "_text", "fp", "size", "shard",
                                   "block", "slot", "taken", "target", "component_id", "length", "_held0", "a.b")}
    now = spark.read.parquet(f"{SF}/documents.parquet").withColumns(clash)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != "packing":
            assert out.columns == now.columns
            now = spark.createDataFrame(out.collect(), out.schema)
        assert out.count() > 100
    assert now.where("score <> 7 OR passages <> 7 OR `a.b` <> 7").count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    rng = random.Random(1)
    line = lambda: " ".join(rng.choices(["the", "day", "was", "long", "and", "good"], k=40))
    rows = [(i, line() + (" vile scum" * 5 if i % 4 == 0 else ""), "en", "s", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 150)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert left == {i for i in range(200) if i % 4}


def test_one_document_of_each_group_stays(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten", "other words come here now")
    rows = [(4, a), (2, a), (2, a), (None, a), (None, b), (None, b), (2, c), (7, ""), (None, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, group int")
    kept = corpus_pipeline.keep_one_per_group(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(2, a), (None, b), (2, c), (7, "")], key=str)
    assert corpus_pipeline.keep_one_per_group(spark, docs.limit(0), SF).collect() == []


def test_run_over_a_whole_table(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and Counter(r.bin_size for r in rows if r.length).keys() <= {512, 1024, 2048, 4096}
