import random

import numpy as np
import pytest
import xxhash

from twinweave.llm.components import connected_components
from twinweave.llm.simhash import fingerprint, links, simhash_groups


def slow_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints):
    prints = list(prints)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_fingerprint_equals_definition(spark):
    texts = ["", None, "One", "one TWO", "a b c", "É a\tb\nc\x0bd a b c d", " x y z w "]
    texts.append(" ".join(random.Random(3).choices("abcdefgh", k=500)))
    for t in texts:
        assert fingerprint(t) & (2**64 - 1) == slow_print(t)


def test_hash_is_sparks_own(spark):
    got = spark.sql("select xxhash64('a b c') h").first().h
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", seed=42)


@pytest.mark.parametrize("most", [4, 50, 4096])
def test_links_connect_exactly_what_is_near(spark, most):
    rng = random.Random(most)
    prints = {0, 2**64 - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = links(df, 3, most)
    for u, v in edges.collect():
        assert ((u ^ v) & (2**64 - 1)).bit_count() <= 64
    star = {r.node: r.root for r in connected_components(edges).collect()}
    want = slow_groups(prints)
    as_groups = lambda m: sorted(map(sorted, m.values()))
    got_groups, want_groups = {}, {}
    for p in prints:
        s = int(np.uint64(p).astype(np.int64))
        got_groups.setdefault(star.get(s, s), []).append(p)
        want_groups.setdefault(want[p], []).append(p)
    assert as_groups(got_groups) == as_groups(want_groups)


def test_long_path_is_one_component(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long")
    star = connected_components(edges).collect()
    assert len(star) == n - 1 and {r.root for r in star} == {0}


def test_groups_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in simhash_groups(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    prints = {d: slow_print(t) for d, t in texts.items()}
    comp = slow_groups(set(prints.values()))
    first = {}
    for d, p in sorted(prints.items()):
        first.setdefault(comp[p], d)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {
        d: (f"{p:016x}", first[comp[p]]) for d, p in prints.items()
    }


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(5, None, 1, 2), (3, "", 1, 2), (3, "", 1, 2), (None, "a b c d", 1, 2),
         (9, "a B c d", 1, 2), (7, "q", 1, 2)],
        "doc_id long, text string, fp int, component_id int",
    )
    got = sorted(((r.doc_id, r.component_id) for r in simhash_groups(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 9), (9, 9), (7, 7)], key=str)
    assert simhash_groups(df.limit(0)).collect() == []


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 600:
        p = base
        for _ in range(rng.randint(1, 3)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    edges = links(spark.createDataFrame([(p,) for p in signed], "fp long"), 3, 64)
    assert edges.count() < 40 * len(prints)
    star = connected_components(edges).collect()
    assert len(star) == len(prints) - 1
