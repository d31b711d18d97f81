import itertools
import random
import re
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from twinweave.operators.blocking import (
    Level, _pattern_rows, block_keys, candidate_pairs, instances, key_table, pair_load, partition_keys,
    unique_pairs,
)
from twinweave.operators.skew import split_from
from twinweave.operators.words import rare_word_keys, tokenize, word_frequency

PATTERN = "[^0-9A-Za-z.]+"


def plain_keys(values, frequency, max_len, pattern):
    out = set()
    for sub, value in values:
        words = {w for w in re.split(pattern, (value or "").lower()) if w}
        ranks = sorted({frequency[w] for w in words})[:max_len]
        if len(ranks) == 1:
            out |= {(sub, w) for w in words if frequency[w] == ranks[0]}
        for a, b in itertools.product(words, words):
            if frequency[a] < frequency[b] and {frequency[a], frequency[b]} <= set(ranks):
                out.add((sub, f"{a}@{b}"))
    return out


@pytest.mark.parametrize("max_len", [1, 2, 3])
@pytest.mark.parametrize("pattern", [PATTERN, r"\s+|,"])
def test_rare_word_keys_follow_the_rule(kv, max_len, pattern):
    rng = random.Random(3)
    words = ["red", "blue", "Blue", "co.", "ltd", "x1", "été", "new", "york"]
    values = [(f"s{i % 17}", " ".join(rng.choices(words, k=rng.randint(1, 5)))) for i in range(40)]
    values += [("s90", "a a b"), ("s91", " ,, "), ("s92", None), ("s0", values[0][1])]
    counts = Counter(
        w for _, v in values for w in re.split(pattern, (v or "").lower()) if w
    )
    df = kv(values)
    frequency = word_frequency((df, pattern))
    assert dict(rows(frequency)) == dict(counts)
    want = plain_keys(values, counts, max_len, pattern)
    assert set(rows(rare_word_keys(df, frequency, max_len, pattern))) == want


def test_tokens_keep_repeats(kv):
    got = tokenize(kv([("a", "x y x"), ("b", "--"), ("c", None)]))
    assert rows(got.select("sub", "word")) == [("a", "x"), ("a", "x"), ("a", "y")]


def two_levels(rng, n=14):
    side = {}
    for i in range(n):
        side[str(i)] = tuple(rng.choice(["p", "q", None]) for _ in range(2))
    return side


@pytest.mark.parametrize("policy", ["wildcard", "null_block", "drop"])
def test_two_level_pairs_follow_the_pair_condition(kv, pairs, policy):
    rng = random.Random(8)
    s, t = two_levels(rng), two_levels(rng)

    def level(i):
        return Level(*[
            kv([(k, v[i]) for k, v in side.items() if v[i]]) for side in (s, t)
        ], None)

    full = [kv([(k, "") for k in side]) for side in (s, t)]
    keys = block_keys(*full, [level(0), level(1)], policy)

    def agree(a, b):
        if a is None or b is None:
            return {"wildcard": True, "null_block": a is b, "drop": False}[policy]
        return a == b

    want = {(a, b) for a in s for b in t if all(agree(x, y) for x, y in zip(s[a], t[b]))}
    assert set(rows(candidate_pairs(keys))) == want
    table = key_table(keys.candidate).collect()
    by_key = {}
    for r in table:
        by_key.setdefault(r.key, {"source": set(), "target": set()})[r.db].add(r.sub)
    met = {(a, b) for v in by_key.values() for a in v["source"] for b in v["target"]}
    assert met == want
    loads = {r.key: (r.nl, r.nr) for r in pair_load(keys, 4).collect()}
    assert loads == {
        k: (len(v["source"]), len(v["target"])) for k, v in by_key.items()
        if v["source"] and v["target"]
    }


def test_unique_blocks_need_one_instance_on_each_side(kv):
    s = kv([("a", "one"), ("b", "many"), ("c", "many"), ("d", "alone")])
    t = kv([("1", "one"), ("2", "many"), ("3", "other")])
    keys = block_keys(s, t, [Level(s, t)])
    assert rows(unique_pairs(keys)) == [("a", "1")]
    assert rows(keys.unique_rows) == [("1", "target", "$one"), ("a", "source", "$one")]
    assert rows(candidate_pairs(keys)) == [("a", "1"), ("b", "2"), ("c", "2")]


def test_unique_blocks_of_every_level_add_up(kv):
    s, t = kv([("a", "uk"), ("b", "us"), ("c", "us")]), kv([("1", "uk"), ("2", "us"), ("3", "us")])
    s2, t2 = kv([("b", "x"), ("c", "y")]), kv([("2", "x"), ("3", "z")])
    keys = block_keys(s, t, [Level(s, t, None), Level(s2, t2)])
    assert rows(unique_pairs(keys)) == [("a", "1"), ("b", "2")]


def test_prefix_comes_from_a_partition(kv):
    s, t = kv([("a", "us"), ("b", "uk")]), kv([("1", "US"), ("2", "uk")])
    names = Level(kv([("a", "acme"), ("b", "acme")]), kv([("1", "acme"), ("2", "acme")]))
    coarse = partition_keys(s, t, [Level(s, t)])
    keys = block_keys(s, t, [names], prefix=coarse.candidate)
    assert rows(candidate_pairs(keys)) == [("a", "1"), ("b", "2")]


def test_separators_inside_values_do_not_collide(kv):
    s1, s2 = kv([("a", "x$y")]), kv([("a", "z")])
    t1, t2 = kv([("1", "x")]), kv([("1", "y$z")])
    keys = block_keys(s1, t1, [Level(s1, t1, None), Level(s2, t2, None)])
    assert rows(candidate_pairs(keys)) == []
    assert rows(key_table(keys.candidate).select("key")) == [("$x$y$z",), ("$x$y$z",)]


def test_groups_of_copies_give_all_their_pairs(kv):
    s = kv([(f"s{i}", "same words here") for i in range(9)] + [("o", "here only")])
    t = kv([(f"t{i}", "same words here") for i in range(7)])
    got = set(rows(candidate_pairs(block_keys(s, t, [Level(s, t)]))))
    assert got == {(f"s{i}", f"t{j}") for i in range(9) for j in range(7)}


def test_bad_arguments(kv):
    s = kv([("a", "x")])
    with pytest.raises(ValueError):
        block_keys(s, s, [], "wildcard")
    with pytest.raises(ValueError):
        block_keys(s, s, [Level(s, s)], "unknown")


def test_repeated_prefix_rows_lose_no_pair(spark, kv):
    left = kv([("a1", "x"), ("a2", "x"), ("b1", "y"), ("b2", "y")])
    right = kv([("c1", "x"), ("c2", "x"), ("d1", "y"), ("d2", "y")])
    once = instances(left, right)
    level = [Level(left, right, None)]
    want = rows(candidate_pairs(block_keys(left, right, level, prefix=once)))
    twice = once.unionByName(once)
    assert rows(candidate_pairs(block_keys(left, right, level, prefix=twice))) == want
    assert len(want) == 8


@pytest.mark.parametrize("missing", ["wildcard", "null_block", "drop"])
def test_load_from_counts_equals_the_expanded_table(spark, kv, missing):
    left = kv([("a1", "x"), ("a2", "x"), ("a3", "y"), ("a5", "z")])
    right = kv([("c1", "x"), ("c2", "q"), ("c3", "y"), ("c3", "x")])
    full_l, full_r = left.unionByName(kv([("a8", "-"), ("a9", "-")])), right.unionByName(kv([("c9", "-")]))
    keys = block_keys(full_l, full_r, [Level(left, right, None)], missing)
    load = pair_load(keys, 3)
    plan = load._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    n = {}
    for r in keys.candidate.collect():
        n.setdefault("$" + "$".join(r.path), {"source": 0, "target": 0})[r.db] += 1
    want = {k: (v["source"], v["target"]) for k, v in n.items() if v["source"] and v["target"]}
    assert {r.key: (r.nl, r.nr) for r in load.collect()} == want


@pytest.mark.parametrize("policy", ["wildcard", "null_block", "drop"])
def test_three_levels_by_missing_pattern(kv, policy):
    """Several values, all masks on both sides, and a prefix that is never missing."""
    rng = random.Random(21)

    def side(n):
        return {str(i): tuple(frozenset(rng.sample("pqr", rng.choice([0, 0, 1, 1, 2]))) for _ in range(3))
                for i in range(n)}

    s, t = side(40), side(30)
    levels = [Level(*[kv([(k, x) for k, v in d.items() for x in v[i]]) for d in (s, t)], None) for i in range(3)]
    keys = block_keys(*[kv([(k, "") for k in d]) for d in (s, t)], levels, policy)

    def agree(a, b):
        if a and b:
            return bool(a & b)
        return {"wildcard": True, "null_block": not a and not b, "drop": False}[policy]

    want = {(a, b) for a in s for b in t if all(map(agree, s[a], t[b]))}
    got = rows(candidate_pairs(keys))
    assert len(got) == len(set(got)) and set(got) == want and want
    if policy == "wildcard":
        # Nobody is written once per key of the other side.
        written, patterns = _pattern_rows(keys)
        assert written.groupBy("sub", "db").count().agg({"count": "max"}).first()[0] <= 2 ** 3 * 2 ** 3
        assert len(patterns) <= 3 ** 3
        plan = written._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan
        table = {}
        for r in key_table(keys.candidate).collect():
            table.setdefault(r.key, {"source": set(), "target": set()})[r.db].add(r.sub)
        assert {(a, b) for v in table.values() for a in v["source"] for b in v["target"]} == want
        ones = {(min(v["source"]), min(v["target"])) for v in table.values()
                if len(v["source"]) == len(v["target"]) == 1}
        assert set(rows(unique_pairs(keys))) >= {p for p in ones if all(s[p[0]]) and all(t[p[1]])}


def test_a_value_of_very_many_words_pairs_as_rows(spark, kv):
    rare = [f"r{i}" for i in range(300)]
    common = [f"c{i}" for i in range(40)]
    both = kv([("hot", " ".join(rare + common)), ("b", " ".join(common)), ("c", "c0 c1")])
    frequency = word_frequency(both)
    with split_from(spark, 2, 4):
        keys = rare_word_keys(both, frequency, 2)
        plan = keys._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set" not in plan and "collect_list" not in plan
        got = {k for s, k in rows(keys) if s == "hot"}
    assert got == {f"{a}@{b}" for a in rare for b in common[2:]}


def test_pairs_ask_for_tasks_whatever_the_rows(spark, kv, monkeypatch):
    from twinweave.operators import blocking, skew

    for module in (blocking, skew):
        monkeypatch.setattr(module, "TASK_PAIRS", 100)
    s, t = kv([(f"s{i}", "same title") for i in range(40)]), kv([(f"t{i}", "same title") for i in range(40)])
    with split_from(spark, 1_000, 100):
        keys = block_keys(s, t, [Level(s, t, None)])
        met = blocking.met_pairs(blocking._pattern_rows(keys)[0], None)
        assert met.select(F.spark_partition_id()).distinct().count() > 8
        assert candidate_pairs(keys).count() == 1_600


def test_words_that_can_be_no_key_are_not_handed_on(kv, monkeypatch):
    from twinweave.operators import words

    handed = []
    joined = words.lookup_join
    monkeypatch.setattr(words, "lookup_join", lambda left, *a, **b: handed.append(left) or joined(left, *a, **b))
    common = [f"w{i}" for i in range(50)]
    df = kv([(f"s{j}", " ".join([f"r{j}", *common])) for j in range(20)]
            + [("z", " ".join(w for i, w in enumerate(common) for _ in range(i + 1))), ("n", None), ("e", "")])
    frequency = word_frequency(df)
    want = rows(rare_word_keys(df, frequency, 2))
    assert handed[0].count() == 2 * 21 and len(want) == 21
    for max_len in (1, 2, 3):
        every, few, none = (
            rows(words.rare_words(df, frequency, max_len, known_words=n)) for n in (1_000, 10, 0))
        assert every == few == none and every


def test_words_are_counted_over_bytes(kv, monkeypatch):
    """Every plain pattern gives the words of its regular expression, each once per task and text."""
    from twinweave.functions import text as functions
    from twinweave.operators import words

    odd = ["", None, "a", "b", ".", "A-b..c A", "\u0130x K\u212a \u00e9t\u00e9 9", "x" * 40, " y", "y ", "tail", "a a\ta\nb"]
    df = kv([(f"s{i}", v) for i, v in enumerate(odd * 2)] + [("s0", "a b"), ("s0", "b c")])
    for pattern in (PATTERN, "[^a-z]+", "[^0-9._]+"):
        counted = word_frequency((df, pattern))
        assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()
        lowered = [r[0] for r in df.select(F.lower("obj")).collect() if r[0]]
        want = Counter(w for v in lowered for w in re.split(pattern, v) if w)
        assert {r.word: r.cnt for r in counted.collect()} == want
        many = [rows(words.rare_words(df, counted, n, pattern)) for n in (1, 2)]
        assert all(many)
        # The same of a pattern that is left to the regular expression.
        spelt = pattern.replace("]+", "\\x00]+")
        assert functions.word_bytes(pattern) is not None and functions.word_bytes(spelt) is None
        assert rows(word_frequency((df, spelt))) == rows(counted)
        assert [rows(words.rare_words(df, counted, n, spelt).distinct()) for n in (1, 2)] == [
            sorted(set(m), key=repr) for m in many]
    monkeypatch.setattr(functions, "WINDOW", 4)
    monkeypatch.setattr(functions, "HELD_WORDS", 2)
    task = functions.count_words(functions.word_bytes(PATTERN))
    import pyarrow as pa
    texts = pa.array(["ab cd ef", "", "gh", "ij ab", "ab"]).slice(1)
    sums = Counter()
    for batch in task([pa.record_batch([texts], names=["text"])]):
        sums.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
    assert sums == {"gh": 1, "ij": 1, "ab": 2}


def test_known_words_are_not_handed_on_beside_rarer_ones(kv, monkeypatch):
    """Where every word is counted, words that are not known take ranks before the known ones."""
    from twinweave.operators import words

    handed = []
    joined = words.lookup_join
    monkeypatch.setattr(words, "lookup_join", lambda left, *a, **b: handed.append(left) or joined(left, *a, **b))
    df = kv([(f"s{j}", f"r{j} q{j // 2} a b c") for j in range(20)] + [("z", "a b c c"), ("q", "q1 b"), ("e", "")])
    frequency = word_frequency(df)
    for max_len, few, many in ((1, 42, 63), (2, 65, 105)):
        want = rows(words.rare_words(df, frequency, max_len, known_words=3))
        assert rows(words.rare_words(df, frequency, max_len, known_words=3, counted=True)) == want
        assert [handed.pop().count() for _ in range(2)] == [few, many]
        for n in (1_000, 0):
            assert rows(words.rare_words(df, frequency, max_len, known_words=n, counted=True)) == want


def test_values_of_a_level_are_counted_once(kv, monkeypatch):
    from twinweave.operators import blocking

    counts = []
    joined = blocking.lookup_join
    monkeypatch.setattr(
        blocking, "lookup_join", lambda *a, **b: counts.append(b.get("counts")) or joined(*a, **b))
    s, t = kv([("a", "x y"), ("b", "")]), kv([("c", "x"), ("d", "y z")])
    keys = block_keys(s, t, [Level(s, t)])
    valued = rows(blocking.valued(keys).select("sub", "db", "v0", "mask"))
    assert valued == [("a", "source", "x", 1), ("a", "source", "y", 1), ("b", "source", None, 0),
                      ("c", "target", "x", 1), ("d", "target", "z", 1)]
    assert rows(counts[0]) == [("a", "source", 2), ("c", "target", 1), ("d", "target", 1)]
