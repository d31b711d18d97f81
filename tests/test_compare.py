import random
from difflib import SequenceMatcher

import pytest
from conftest import rows

from twinweave.operators import compare as module
from twinweave.functions.similarity import first_free, short_ratios
from twinweave.operators.compare import (
    Attribute, Relation, attribute_similarity, compare, fuzzy_matches, relation_similarity,
)


def plain_overlap(xs, ys, threshold=0.8):
    used, d = set(), 0
    for x in xs:
        for y in ys:
            if y not in used and SequenceMatcher(None, x, y).ratio() >= threshold:
                used.add(y)
                d += 1
                break
    return d / (len(xs) + len(ys) - d)


def random_sets(rng, n):
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(25)]
    return [sorted(set(rng.sample(words, rng.randint(1, 8)))) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_fuzzy_matches_equal_plain_statement(kv, pairs, threshold):
    rng = random.Random(5)
    xs, ys = random_sets(rng, 60), random_sets(rng, 60)
    texts = ["the quick brown fox", "a line of text that is long enough \U0001f600", ""]
    for sets in (xs, ys):
        for i in range(20):
            near = [t[:rng.randint(0, 4)] + t[rng.randint(2, 6):] + rng.choice(["", "s", "ed"]) for t in texts]
            sets[i] = sorted({*sets[i], *near})
    s = kv([(f"s{i}", v) for i, vs in enumerate(xs) for v in vs])
    t = kv([(f"t{i}", v) for i, vs in enumerate(ys) for v in vs])
    met = [(i, j) for i in range(60) for j in (i, (7 * i + 3) % 60)]
    got = relation_similarity(pairs([(f"s{i}", f"t{j}") for i, j in met]), s, t, threshold=threshold)
    assert {(r[0], r[1]): pytest.approx(r[2], abs=1e-12) for r in rows(got)} == {
        (f"s{i}", f"t{j}"): plain_overlap(xs[i], ys[j], threshold) for i, j in met}


def test_many_similar_lines_take_a_fixed_number_of_stages(spark, monkeypatch):
    """Every value is similar to its neighbours, so each choice hangs on the one before."""
    from twinweave.operators import compare as module

    def run(n):
        stages = []
        keep = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name: stages.append(name) or keep(df, name))
        side = spark.range(n).selectExpr("'a' AS source", "'1' AS target", "lpad(id * 7919 % 1000003, 9, '0') AS v")
        got = fuzzy_matches(side.withColumnRenamed("v", "x"), side.withColumnRenamed("v", "y"), 0.99).collect()
        monkeypatch.undo()
        return stages, [tuple(r) for r in got]

    few, many = run(10), run(1000)
    assert few[0] == many[0] and few[1] == [("a", "1", 10)] and many[1] == [("a", "1", 1000)]
    # A chain: x takes the y before it, which leaves the next x its second choice.
    edges = spark.range(20000).selectExpr(
        "'a' AS source", "'1' AS target", "id AS x", "explode(array(id, id + 1, id + 2)) AS y")
    out = edges.coalesce(1).sortWithinPartitions("x", "y").mapInArrow(
        first_free, "source string, target string, d bigint")
    assert rows(out) == [("a", "1", 20000)]


def test_attribute_rules(kv, pairs):
    s = kv([("a", "Tide"), ("b", ""), ("c", None), ("e", "x-Y!")])
    t = kv([("1", "diet"), ("2", ""), ("3", "z"), ("5", "xy")])
    p = pairs([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3"), ("e", "5")])
    got = dict(((r[0], r[1]), r[2]) for r in rows(
        attribute_similarity(p, s, t, default=0.3, ignore="[^a-z]")))
    assert got == {
        ("a", "1"): 0.25, ("b", "2"): 1.0, ("c", "3"): 0.3, ("d", "3"): 0.3, ("e", "5"): 1.0,
    }


def test_several_values_fan_out_or_take_the_best(kv, pairs):
    s, t = kv([("a", "x"), ("a", "y"), ("a", None)]), kv([("1", "x"), ("1", "q")])
    p = pairs([("a", "1")])
    fan = rows(attribute_similarity(p, s, t, default=0.5, metric="equal"))
    assert [r[2] for r in fan] == [0.0, 0.0, 0.0, 0.5, 0.5, 1.0]
    best = rows(attribute_similarity(p, s, t, default=0.5, metric="equal", multi="max"))
    assert best == [("a", "1", 1.0)]


def test_relation_rules(kv, pairs):
    s = kv([("a", "Alpha"), ("a", "beta"), ("b", "zzz"), ("c", None), ("e", "same"), ("e", "too")])
    t = kv([("1", "alphb"), ("1", "gamma"), ("2", "qqq"), ("3", "v"), ("5", "TOO"), ("5", "same")])
    p = pairs([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3"), ("e", "5")])
    got = dict(((r[0], r[1]), r[2]) for r in rows(relation_similarity(p, s, t, default=0.126)))
    assert got == {
        ("a", "1"): pytest.approx(1 / 3), ("b", "2"): 0.0, ("c", "3"): 0.126,
        ("d", "3"): 0.126, ("e", "5"): 1.0,
    }


@pytest.mark.parametrize("multi, limit", [("fanout", 0), ("max", 9)])
def test_row_form_equals_profile_form(kv, pairs, multi, limit):
    rng = random.Random(11)
    sets = random_sets(rng, 8)
    s = kv([(f"s{i}", v) for i, vs in enumerate(sets[:4]) for v in vs] + [("s0", None)])
    t = kv([(f"t{i}", v) for i, vs in enumerate(sets[4:]) for v in vs])
    p = pairs([(f"s{i}", f"t{j}") for i in range(5) for j in range(5)])
    features = [Relation(s, t, 0.1), Attribute(s, t, 0.2), Relation(s, t, 0.1, threshold=1.0)]

    def flat(df):
        return sorted((r[0], r[1], *[round(v, 9) for v in r[2]]) for r in df.collect())

    assert flat(compare(p, features, multi)) == flat(compare(p, features, multi, limit))


def test_vector_follows_feature_order(kv, pairs):
    s, t = kv([("a", "x")]), kv([("1", "x")])
    none = kv([])
    vector = compare(pairs([("a", "1")]), [
        Attribute(s, none, 0.4), Attribute(s, t), Relation(none, t, 0.7),
    ]).first()["sim_v"]
    assert vector == [0.4, 1.0, 0.7]


def test_levenshtein_of_null_and_empty(spark):
    from twinweave.functions.similarity import levenshtein_similarity

    df = spark.createDataFrame([(None, ""), ("", None), ("", ""), ("ab", "")], "x string, y string")
    got = [r[0] for r in df.select(levenshtein_similarity(df.x, df.y)).collect()]
    assert got == [None, None, 1.0, 0.0]


def test_combinations_become_rows_behind_the_join(kv, pairs, monkeypatch):
    """The scored stage has a row per pair of profiles and is not broadcast by its file's size."""
    from twinweave.operators import compare as module

    stages = {}
    kept = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: stages.setdefault(name, kept(df, name)))
    s = kv([("a", f"v{i}") for i in range(30)])
    t = kv([(x, f"v{i}") for x in ("1", "2") for i in range(20)])
    out = compare(pairs([("a", "1"), ("a", "2")]), [Attribute(s, t, metric="equal")])
    assert out.count() == 2 * 30 * 20 and stages["scored"].count() == 1
    assert "merge" in out._jdf.queryExecution().optimizedPlan().toString()


def test_short_ratios_equal_the_matcher():
    rng = random.Random(11)
    for alphabet, longest in (("ab", 9), ("abcde/.", 50), ("abcdefghij\U0001f600\u00e9", 199)):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(400)]
        met = [(x, y) for x, y in zip(texts, texts[::-1]) if x != y]
        expected = [SequenceMatcher(None, x, y).ratio() for x, y in met]
        assert short_ratios(*map(list, zip(*met)), together=64).tolist() == expected


def test_ratio_of_short_long_null_and_equal_values(kv, pairs):
    rng = random.Random(12)
    sides = [[None if i % 9 == 0 else "".join(rng.choice("abcdef") for _ in range(rng.choice([0, 7, 40, 199, 200, 260])))
              for i in range(60)] for _ in range(2)]
    sides[1][5] = sides[0][5]
    s, t = (kv([(f"{n}{i // 2}", v) for i, v in enumerate(vs)]) for n, vs in zip("st", sides))
    got = attribute_similarity(pairs([(f"s{i}", f"t{i}") for i in range(30)]), s, t, default=0.3)
    assert rows(got) == sorted(((
        f"s{i}", f"t{i}", 0.3 if x is None or y is None else SequenceMatcher(None, x, y).ratio())
        for i in range(30) for x in sides[0][2 * i:2 * i + 2] for y in sides[1][2 * i:2 * i + 2]), key=repr)


def test_few_bytes_for_the_matcher_are_dealt_to_several_tasks(spark, kv, pairs, monkeypatch):
    """Behind a join by the same columns too, where the planner would drop a plain repartition."""
    from twinweave.operators import compare as module

    tasks = {}
    keep = module.materialise

    def noted(df, name):
        out = keep(df, name)
        tasks[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(module, "materialise", noted)
    monkeypatch.setattr(module, "TASK_MATCHES", 10)
    s, t = kv([(f"s{i}", f"left {i}") for i in range(20)]), kv([(f"t{i}", f"right {i}") for i in range(20)])
    met = pairs([(f"s{i}", f"t{j}") for i in range(20) for j in range(20)])
    assert attribute_similarity(met, s, t).count() == 400
    assert tasks["scored"] == 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert compare(met, [Attribute(s, t), Relation(s, t)]).count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tasks["scored"] == 4


@pytest.mark.parametrize("multi", ["fanout", "max"])
def test_row_form_compares_copies_once(kv, pairs, monkeypatch, multi):
    from twinweave.operators import compare as module

    asked = []
    overlap = module._row_overlap
    monkeypatch.setattr(
        module, "_row_overlap", lambda met, *a: asked.append((met.count(), a[0].count())) or overlap(met, *a))
    lines = ["x", "y", "z", "z"]
    s = kv([(f"s{i}", v) for i in range(5) for v in lines] + [("few", "x"), ("odd", "x"), ("odd", None)])
    t = kv([(f"t{i}", v) for i in range(4) for v in [*lines, "w"]] + [("u", v) for v in ("x", None, "x", "y")])
    met = pairs([(a, b) for a in ("s0", "s1", "s2", "s3", "s4", "odd", "few", "none", "nil")
                 for b in ("t0", "t1", "t2", "t3", "u", "void")] + [(None, "t0"), ("s0", None)])
    features = [Relation(s, t, default=0.2, threshold=1.0), Attribute(s, t, default=0.3, metric="equal")]
    want = rows(compare(met.na.drop(), features, multi))
    asked.clear()
    # Every value makes its instance large; the pairs of two without values stay profiles.
    assert rows(compare(met, features, multi, 0)) == want
    # s0 to s4, odd, few and both without values, with t0 to t3, u and the one without values.
    assert asked == [(4 * 3 - 1, 3 + 1 + 1 + 4 + 2)]


def test_pairs_of_profiles_travel_as_numbers(kv, pairs, monkeypatch):
    staged = {}

    def told(df, name, write=module.materialise):
        staged[name] = dict(df.dtypes)
        return write(df, name)

    monkeypatch.setattr(module, "materialise", told)
    source = kv([("a", "x"), ("b", "x"), ("c", None), ("e", "y")])
    target = kv([("1", "x"), ("2", "y")])
    met = pairs([("a", "1"), ("b", "1"), ("b", "2"), ("c", "1"), ("d", "2"), ("e", "2"), ("a", "9")])
    got = module.attribute_similarity(met, source, target, default=0.25, metric="equal")
    assert rows(got) == [("a", "1", 1.0), ("a", "9", 0.25), ("b", "1", 1.0), ("b", "2", 0.0), ("c", "1", 0.25),
                         ("d", "2", 0.25), ("e", "2", 1.0)]
    for name in ("links", "combos", "scored"):
        assert staged[name]["s_pid"] == staged[name]["t_pid"] == "bigint"
