import random

import pytest
from conftest import rows

from twinweave.operators.blocking import Level, block_keys, candidate_pairs
from twinweave.schema import LABELS, PAIR
from twinweave.sources import stage_root
from twinweave.streaming.candidate_feed import (
    ARRIVING, FeedLevel, compact_feed, follow_instances, key_log, new_pairs, pair_log, seed_feed,
)
from twinweave.streaming.label_feed import (
    append_labels, compact_labels, label_log, merged_labels,
)

TWO = "source string, target string, sim_v array<double>, is_match double"


def _labels(spark, given):
    return spark.createDataFrame([(s, t, [1.0], float(y)) for s, t, y in given], TWO)


def _table(log, version):
    return rows(merged_labels(log, version).select(*PAIR, "is_match"))


def test_label_log_keeps_the_newest_version_of_a_pair(spark, tmp_path):
    log = label_log(spark, str(tmp_path))
    log.seed(_labels(spark, [("a", "x", 0), ("b", "x", 0), ("c", "x", 1)]))
    append_labels(log, _labels(spark, [("a", "x", 1), ("d", "x", 1), ("d", "x", 1)]), 1)
    append_labels(log, _labels(spark, [("a", "x", 0), ("b", "x", 1)]), 2)
    append_labels(log, _labels(spark, []), 3)
    at = [
        [("a", "x", 0.0), ("b", "x", 0.0), ("c", "x", 1.0)],
        [("a", "x", 1.0), ("b", "x", 0.0), ("c", "x", 1.0), ("d", "x", 1.0)],
        [("a", "x", 0.0), ("b", "x", 1.0), ("c", "x", 1.0), ("d", "x", 1.0)],
    ]
    at.append(at[2])
    assert [_table(log, v) for v in range(4)] == at
    # A batch writes its answers and nothing else.
    assert [log.delta(v).count() for v in range(4)] == [0, 2, 2, 0]
    append_labels(log, _labels(spark, [("a", "x", 1), ("d", "x", 1)]), 1)
    assert [_table(log, v) for v in range(4)] == at


def test_label_log_compacts_and_forgets_a_broken_compaction(spark, tmp_path):
    log = label_log(spark, str(tmp_path))
    log.seed()
    append_labels(log, _labels(spark, [("a", "x", 1), ("b", "x", 1)]), 1)
    append_labels(log, _labels(spark, [("a", "x", 0)]), 2)
    append_labels(log, _labels(spark, [("b", "x", 0)]), 3)
    # Written, but its number never came to stand in ``bases``.
    log._write(_labels(spark, [("z", "z", 1)]), "base", 2)
    assert _table(log, 2) == [("a", "x", 0.0), ("b", "x", 1.0)]
    compact_labels(log, 2)
    assert [r.v for r in log.parts(3)[1].select("v").collect()] == [3]
    assert _table(log, 3) == [("a", "x", 0.0), ("b", "x", 0.0)]
    assert _table(log, 1) == [("a", "x", 1.0), ("b", "x", 1.0)]


def test_label_log_refuses_other_labels(spark, tmp_path):
    log = label_log(spark, str(tmp_path))
    log.seed()
    with pytest.raises(Exception, match="is_match must be 0 or 1"):
        append_labels(log, _labels(spark, [("a", "x", 2)]), 1)
    assert log.schema == LABELS


def _instances(seed):
    """``(sub, db, values)`` of two levels, some without a value, with a common word."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(9)]
    out = []
    for i in range(24):
        kind = [rnd.choice("pq")] if rnd.random() < 0.6 else []
        text = [" ".join(["all", *rnd.choices(words, k=3)])] if rnd.random() < 0.8 else rnd.choice([[], [""], None])
        out.append((f"{i}", "source" if i % 2 else "target", [kind, text]))
    return out


def _by_definition(instances, frequency, missing):
    """Pairs that agree or lack a value at every level, in plain Python."""
    def keys(values):
        kinds = {v.lower() for v in values[0] or []}
        rare = set()
        for text in values[1] or []:
            found = set(text.lower().split())
            least = min((frequency.get(w, 0) for w in found), default=None)
            rare |= {w for w in found if frequency.get(w, 0) == least}
        return kinds, rare

    def meet(s, t):
        if missing == "wildcard":
            return all(not a or not b or a & b for a, b in zip(s, t))
        if missing == "drop":
            return all(a & b for a, b in zip(s, t))
        return all((not a and not b) or a & b for a, b in zip(s, t))

    return sorted((s, t) for s, db, sv in instances if db == "source"
                  for t, other, tv in instances if other == "target" and meet(keys(sv), keys(tv)))


def _feed(spark, batches, levels, root, missing="wildcard", between=None):
    """Pairs after all ``batches``, each of which a query of its own takes up."""
    seed_feed(spark, f"{root}/out", len(levels))
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, ARRIVING).coalesce(1).write.mode("append").parquet(f"{root}/in")
        if between:
            between(n)
        arriving = spark.readStream.schema(ARRIVING).parquet(f"{root}/in")
        query = follow_instances(arriving, levels, f"{root}/out", f"{root}/cp", missing)
        query.awaitTermination()
        assert query.exception() is None
    return rows(pair_log(spark, f"{root}/out").read(len(batches)))


@pytest.mark.parametrize("missing,cuts", [("wildcard", [24]), ("wildcard", [3, 4, 17]), ("null_block", [9, 15]),
                                          ("drop", [12, 12])])
def test_any_cut_into_batches_gives_the_same_pairs(spark, tmp_path, missing, cuts):
    instances = _instances(3)
    frequency = {"all": 50, "w0": 1, "w1": 2, "w2": 2, "w3": 9, "w4": 4, "w5": 4, "w6": 7}
    stored = spark.createDataFrame(list(frequency.items()), "word string, cnt long")
    batches, at = [], 0
    for n in cuts:
        batches.append(instances[at:at + n])
        at += n
    got = _feed(spark, batches, [FeedLevel(), FeedLevel(stored)], str(tmp_path), missing)
    assert got == _by_definition(instances, frequency, missing)


def test_feed_equals_the_batch_run_over_the_same_words(spark, kv, tmp_path):
    names = ["acme paper", "bolt paper works", "acme works", "crane", "", "delta acme"]
    s, t = kv([(f"s{i}", n) for i, n in enumerate(names)]), kv([(f"t{i}", n) for i, n in enumerate(names)])
    from twinweave.operators.words import word_frequency
    level = FeedLevel(word_frequency(s, t))
    arriving = [(f"{db[0]}{i}", db, [[n]]) for i, n in enumerate(names) for db in PAIR]
    got = _feed(spark, [arriving[:5], arriving[5:]], [level], str(tmp_path))
    assert got == rows(candidate_pairs(block_keys(s, t, [Level(s, t)])))


def test_feed_goes_on_after_a_break_and_after_compaction(spark, tmp_path):
    root = str(tmp_path)
    batches = [[("a", "source", [["k"]]), ("b", "target", [["k"]])], [("c", "target", [["k"]])],
               [("a", "source", [["other"]]), ("d", "source", [["k"]]), (None, "source", [["k"]]), ("e", "side", [["k"]])]]

    def between(n):
        if n == 1:  # A first try got as far as the keys, with half of the rows.
            log = key_log(spark, f"{root}/out", 1)
            log.append(spark.createDataFrame([("zz", "source", [], 1, "k")], log.schema), 2)
        if n == 2:
            compact_feed(spark, f"{root}/out", 1, 2)

    got = _feed(spark, batches, [FeedLevel()], root, between=between)
    assert got == [("a", "b"), ("a", "c"), ("d", "b"), ("d", "c")]
    log = pair_log(spark, f"{root}/out")
    assert [sorted((r.source, r.target) for r in log.delta(v).collect()) for v in (1, 2, 3)] == [
        [("a", "b")], [("a", "c")], [("d", "b"), ("d", "c")]]
    assert key_log(spark, f"{root}/out", 1).parts(3)[1].count() == 1


def test_no_pairs_without_new_instances(spark, tmp_path):
    log = key_log(spark, str(tmp_path), 1)
    log.seed(spark.createDataFrame([("a", "source", [], 1, "k"), ("b", "target", [], 1, "k")], log.schema))
    assert new_pairs(log.delta(0), log.read(0), 1).count() == 0


def test_texts_of_new_instances_are_not_shuffled(spark, monkeypatch):
    from twinweave.streaming import candidate_feed

    plans = []
    written = candidate_feed.materialise

    def kept(df, name):
        if name == "arrived":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(candidate_feed, "materialise", kept)
    log = key_log(spark, f"{stage_root(spark)}/texts-not-shuffled", 1)
    log.seed(spark.createDataFrame(
        [(f"old{i:05d}", "source", [], 1, f"k{i}") for i in range(3_000)], log.schema))
    batch = spark.createDataFrame([("old00007", "source", [["k"]]), ("new", "source", [["k"]]), (None, "source", [["k"]])],
                                  ARRIVING)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8192")
    try:
        keys = candidate_feed.batch_keys(batch, log.read(0), [FeedLevel()], "wildcard")
        assert [r.sub for r in keys.collect()] == ["new"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(sub" not in plans[0], plans[0]
