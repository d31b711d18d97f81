import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from twinweave.operators.skew import balanced_join, load_report, lookup_join, split_from
from twinweave.plans import workload


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    left = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 20)}") for i in range(300)]
    right = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 25)}") for i in range(150)]
    return (
        spark.createDataFrame(left, "a int, key string"),
        spark.createDataFrame(right, "b int, key string"),
    )


@pytest.mark.parametrize("n_workers, min_load", [(1, 0.0), (5, 0.0), (16, 100.0), (16, 1e9)])
def test_balanced_join_equals_plain_join(skewed, n_workers, min_load):
    left, right = skewed
    got = balanced_join(left, right, ["key"], ["a"], ["b"], n_workers, min_load)
    assert rows(got.select("a", "b")) == rows(left.join(right, "key").select("a", "b"))


def test_heavy_key_is_cut_on_both_sides(skewed):
    left, right = skewed
    joined = balanced_join(left, right, ["key"], ["a"], ["b"], 16, 0.0)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_i" in plan and "_j" in plan
    assert joined.where("key = 'hot'").count() == 100 * 50


def test_pairs_of_a_hot_key_come_from_several_tasks(spark, skewed):
    left, right = skewed
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}

    def tasks():
        joined = balanced_join(left, right, ["key"], ["a"], ["b"], 16)
        return joined.where("key = 'hot'").select(F.spark_partition_id()).distinct().count()

    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        assert tasks() == 1
        with split_from(spark, 10, 10):
            assert tasks() > 1
        assert tasks() == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("min_rows", [1, 10, 10_000])
def test_lookup_join_equals_plain_join(skewed, how, min_rows):
    left, right = skewed
    one = right.groupBy("key").count().where("key <> 'k3'")
    got = lookup_join(left, one, ["key"], ["a"], how, n_tasks=6, min_rows=min_rows)
    assert rows(got) == rows(left.join(one, "key", how))


def test_load_report_counts_pairs(skewed):
    left, right = skewed
    report = {r.key: r for r in load_report(left, right, ["key"], 8).collect()}
    assert (report["hot"].nl, report["hot"].nr, report["hot"].load) == (100, 50, 5000.0)
    total = sum(r.load for r in report.values())
    assert total == left.join(right, "key").count()
    assert report["hot"].n_part == -(-5000 * 8 // int(total))
    assert min(r.n_part for r in report.values()) == 1


def test_load_beyond_64_bits(spark):
    from twinweave.operators.skew import load_parts

    counts = spark.createDataFrame([("k", 10**10, 10**10)], "key string, nl long, nr long")
    assert load_parts(counts, 10).first().load == 1e20


def test_empty_inputs(spark, skewed):
    left, right = skewed
    none = left.where("a < 0")
    assert balanced_join(none, right, ["key"], ["a"], ["b"], 4, 0.0).count() == 0
    assert load_report(none, right, ["key"], 4).count() == 0


def test_few_rows_of_many_pairs_make_them_in_several_tasks(spark, monkeypatch):
    from twinweave.operators import skew

    monkeypatch.setattr(skew, "TASK_PAIRS", 500)
    left = spark.createDataFrame([(i, f"k{i % 3}") for i in range(300)], "a int, key string")
    joined = balanced_join(left, left.withColumnRenamed("a", "b"), ["key"], ["a"], ["b"], 40, 0.0)
    assert joined.count() == 3 * 100 * 100
    assert joined.select(F.spark_partition_id()).distinct().count() > 8


def test_part_numbers_are_parsed_before_they_are_joined(spark, tmp_path):
    spark.createDataFrame(
        [(i, "ab"[i % 2], 10 + 30 * (i % 3 > 0)) for i in range(12)], "p_partkey long, p_name string, p_size int"
    ).write.parquet(f"{tmp_path}/part.parquet")
    out = workload.balanced_join_parts(spark, str(tmp_path))
    want = {}
    for s in (i for i in range(12) if i % 3 == 0):
        for t in (i for i in range(12) if i % 3 and i % 2 == s % 2):
            n, apart = want.get("ab"[s % 2], (0, 0))
            want["ab"[s % 2]] = n + 1, apart + s - t
    assert {r.key: (r.pairs, r.apart) for r in out.collect()} == want
    aggregate = out._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert "Aggregate" in aggregate and "cast(s" not in aggregate
