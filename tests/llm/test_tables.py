"""Packing, mixing, sharding, URL rules, search and neighbours."""

import math
import random
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinweave.llm.mixing import MixParams, mix_sources, mixed_blocks, mixed_documents, source_targets, words_taken
from twinweave.llm.neighbours import LshParams, nearest
from twinweave.llm.packing import PackParams, best_fit, pack_documents, pack_shard
from twinweave.llm.search import SearchParams, split_words, top_k, words_of
from twinweave.llm.sharding import allowed_moves, cut_links, shard_documents
from twinweave.llm.urlrules import UrlRuleParams, filter_urls, mine_rules

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None, 0) for i, t, s in rows], DOCS)


# Packing

def slow_best_fit(sizes, ladder, p):
    bins, left, place = [], sum(sizes), []
    for size in sizes:
        open_ = [(b[0] - b[1], i) for i, b in enumerate(bins) if b[0] - b[1] >= size]
        if open_:
            tight = min(open_)[0]
            i = max(i for s, i in open_ if s == tight)
        else:
            best = min((n for n in ladder if n >= size), key=lambda n: (p.cost(n) / min(n, left), n))
            bins.append([best, 0])
            i = len(bins) - 1
        bins[i][1] += size
        place.append(i)
        left -= size
    return Counter(b[1] for b in bins), [b[0] for b in bins], place


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_equals_plain_search(seed):
    rng, p = random.Random(seed), PackParams(lengths=(8, 16, 32))
    sizes = sorted((rng.randint(1, 31) for _ in range(rng.randint(1, 80))), reverse=True)
    bins, opened = best_fit(sizes, p.lengths, p)
    filled = [0] * len(opened)
    for b, s in zip(bins, sizes):
        filled[b] += s
    want, sizes_opened, _ = slow_best_fit(sizes, p.lengths, p)
    assert sorted(opened) == sorted(sizes_opened)
    assert all(f <= o for f, o in zip(filled, opened))
    placed, offsets, final = pack_shard(sizes, p)
    total = Counter()
    for b, s in zip(placed, sizes):
        total[b] += s
    assert all(final[b] == min(n for n in p.lengths if n >= f) for b, f in total.items())
    cost = sum(map(p.cost, final))
    assert cost <= sum(p.cost(min(n for n in p.lengths if n >= f)) for f in filled)


def test_packing_covers_every_word_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(0, 90)), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (7, "a b c", "s"), (7, "a b c", "s"), (None, "x y", "s"),
             (102, "w " * 1000, "s")]
    p = PackParams(lengths=(8, 16, 32), pieces_per_shard=20)
    got = pack_documents(docs(spark, rows), p).collect()
    words = Counter()
    for i, t, _ in rows:
        words[i] += len((t or "").split())
    have = Counter()
    bins = defaultdict(list)
    for r in got:
        have[r.doc_id] += r.length
        if r.shard is not None:
            bins[r.shard, r.bin, r.bin_size].append((r.bin_offset, r.length))
        elif r.length:
            assert r.length == r.bin_size == 32
        else:
            assert r.bin_size is None
    assert have == words
    for (_, _, size), parts in bins.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert sum(n for _, n in parts) <= size
    spans = sorted((r.start, r.length) for r in got if r.doc_id == 102)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert pack_documents(docs(spark, rows).limit(0), p).collect() == []


# Mixing

def slow_targets(sizes, p):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: p.weights[i % len(p.weights)] for i, s in enumerate(names)}
    left, target, open_ = p.share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > p.limit * sizes[s] + 1e-9]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = float(p.limit * sizes[s])
            open_.discard(s)
        left = p.share * sum(sizes.values()) - sum(v for k, v in target.items())
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_reshare_the_excess(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 5, 100, 1000, 9000]) for i in range(7)} | {None: 40, "É": 70}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = slow_targets(sizes, MixParams())
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_stays_near_targets_and_within_limits(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{j}" for j in range(rng.randint(0, 60))), rng.choice(["a", "b", "c", None, "hot", "hot"]))
            for i in range(400)] + [(1, None, "a"), (2, "", None), (900, "x " * 9000, "b")] * 2
    p = MixParams(block=16, slots_per_shard=64)
    mix = mix_sources(docs(spark, rows), p)
    got = words_taken(mix).collect()
    assert len(got) == len(rows)
    sums, targets, sizes = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sums[r.target] += r.taken
        targets[r.target] = r.source_size
        sizes[r.target] += r.size
    for t in targets:
        assert abs(sums[t] - t) <= 4 * p.block or sizes[t] != targets[t]
    again = sorted(map(tuple, words_taken(mix_sources(docs(spark, rows), p)).collect()), key=repr)
    assert again == sorted(map(tuple, got), key=repr)
    slots = mix.slots.groupBy("block").count().agg(F.max("count")).first()[0]
    assert slots <= 2
    empty = mix_sources(docs(spark, rows).limit(0), p)
    assert words_taken(empty).collect() == []


def test_output_shards_hold_the_blocks_of_their_drawn_slots(spark):
    """Counts per shard add up to a source's slots, which follow on each other shard by shard."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), f"s{i % 3}") for i in range(120)]
    p = MixParams(block=4, slots_per_shard=64)
    mix = mix_sources(docs(spark, rows), p)
    sources = {r.sid: r for r in mix.sources.collect()}
    counts = {}
    for r in mix.counts.collect():
        counts.setdefault(r.sid, {})[r.shard] = (r.first, r.n)
    shards = -(-sum(r.slots for r in sources.values()) // 64)
    assert shards > 10
    slots = {}
    for r in mix.slots.collect():
        slots.setdefault((r.sid, r.shard), []).append((r.slot, r.block))
    held = {}
    for r in mixed_blocks(mix).collect():
        held[r.sid, r.slot] = held.get((r.sid, r.slot), 0) + r.words
    for sid, s in sources.items():
        drawn = counts[sid]
        assert sum(n for _, n in drawn.values()) == s.slots and set(drawn) <= set(range(shards))
        # Multinomial with even shares: no shard is far from its mean.
        mean = s.slots / shards
        assert all(abs(drawn.get(k, (0, 0))[1] - mean) < 6 * mean ** 0.5 + 6 for k in range(shards))
        numbers = []
        for shard, (first, n) in drawn.items():
            here = sorted(slots[sid, shard])
            assert [x for x, _ in here] == list(range(first, first + n))
            numbers += here
        assert [x for x, _ in sorted(numbers)] == list(range(s.slots))
        once = [b for x, b in numbers if x < s.blocks]
        assert len(set(once)) == len(once) and all(s.base <= b < s.base + s.blocks for b in once)
        full = [held[sid, x] for x, b in numbers if b != s.base + s.blocks - 1]
        assert set(full) == {p.block}


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(i % 50)) + "\n", "ab"[i % 2]) for i in range(120)]
    p = MixParams(block=8)
    df = docs(spark, rows)
    want = {r.doc_id: r.taken for r in words_taken(mix_sources(df.withColumn("_r", F.col("doc_id")), p, row_id="_r")).collect()}
    out = mixed_documents(df, p)
    assert out.columns == df.columns
    have = Counter()
    for r in out.collect():
        words = r.text.split()
        assert all(w.startswith(f"d{r.doc_id}w") for w in words) and len(set(words)) == len(words)
        have[r.doc_id] += len(words)
    total = sum(len(t.split()) for _, t, _ in rows)
    assert abs(sum(have.values()) - 1.5 * total) < 0.05 * total
    assert all(have[i] <= 2 * len(t.split()) for i, t, _ in rows)
    assert abs(sum(want.values()) - sum(have.values())) < 0.05 * total


# Sharding

def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot"] * 10 + [f"g{rng.randint(0, 30)}"] * 10 + [f"own {i}"] * 15), "s") for i in range(700)]
    rows += [(None, None, None), (1, "", None), (1, "", None), (2, None, "s")]
    out = shard_documents(docs(spark, rows))
    got = out.collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 8
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    small = [r for r in got if r.text_crc32 and sum(x.text_crc32 == r.text_crc32 for x in got) < 80]
    away = cut_links(spark.createDataFrame(small, out.schema)).first()
    assert away.away <= 0.05 * away.linked
    hot = Counter(r.shard for r in got if sum(x.text_crc32 == r.text_crc32 for x in got) > 150)
    assert len(hot) <= 5  # a group larger than a shard fills some instead of lying in all
    assert shard_documents(docs(spark, rows).limit(0)).collect() == []
    assert sorted(Counter(r.shard for r in shard_documents(docs(spark, rows[:3])).collect()).values()) == [1, 1, 1]


@pytest.mark.parametrize("copies", [2, 5])
def test_groups_meet_when_every_row_has_a_copy(spark, copies):
    rows = [(i, f"g{i % (800 // copies)}", "s") for i in range(800)]
    out = shard_documents(docs(spark, rows))
    got = out.collect()
    assert Counter(Counter(r.shard for r in got).values()) == {100: 8}
    assert sorted(r.doc_id for r in got) == list(range(800))
    assert cut_links(out).first().away <= 7 * copies // 2  # a group per border of two shards


@pytest.mark.parametrize("own", [0, 120])
def test_pairs_meet_beside_a_hot_third(spark, own):
    rows = [(i, "hot", "s") for i in range(300)] + [(300 + i, f"g{i // 2}", "s") for i in range(600)]
    rows += [(900 + i, f"own {i}", "s") for i in range(own)]
    got = shard_documents(docs(spark, rows)).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    where = defaultdict(list)
    for r in got:
        if 300 <= r.doc_id < 900:
            where[r.doc_id // 2].append(r.shard)
    assert sum(len(set(s)) > 1 for s in where.values()) <= 7
    hot = Counter(r.shard for r in got if r.doc_id < 300)  # needs three shards
    assert sum(n for _, n in hot.most_common(3)) > 0.6 * 300


@pytest.mark.parametrize("seed", range(6))
def test_allowed_moves_fit_and_swap(seed):
    rng = random.Random(seed)
    room = {s: rng.choice([0, 0, 3, 20]) for s in range(5)}
    wanted = {(s, t, large): rng.randint(0, 30) for s in room for t in room if s != t for large in (False, True)}
    got = allowed_moves(wanted, room)
    assert all(0 < n <= wanted[k] for k, n in got.items())
    for t in room:
        assert sum(n for k, n in got.items() if k[1] == t) - sum(n for k, n in got.items() if k[0] == t) <= room[t]
    full = dict.fromkeys(room, 0)
    assert allowed_moves({(0, 1, False): 5, (1, 0, False): 3, (2, 0, False): 9}, full) == {
        (0, 1, False): 3, (1, 0, False): 3}
    assert allowed_moves({(0, 1, False): 5, (2, 1, True): 5, (1, 0, False): 5, (1, 2, False): 5}, full) == {
        (0, 1, False): 5, (2, 1, True): 5, (1, 0, False): 5, (1, 2, False): 5}


def test_rare_lengths_and_outliers_are_never_short(spark):
    r = np.random.default_rng(0)
    tight = [(i, (np.ones(6) + 0.01 * r.normal(size=6)).tolist()) for i in range(1, 2_000)]
    rare = [(10_000 + i, r.normal(size=9).tolist()) for i in range(30)]
    far = [(20_000 + i, (-np.eye(6)[i % 6] + 0.1 * r.normal(size=6)).tolist()) for i in range(10)]
    pair = [(30_000, [1.0, 2.0]), (30_001, [3.0, -1.0])]
    rows = tight + rare + far + pair
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, lambda i: (i >= 10_000) & (i % 5 == 0), LshParams(tables=2)).collect()
    per = defaultdict(list)
    for x in got:
        per[x.query_id].append(x)
    vec = dict(rows)
    asked = [i for i in vec if i >= 10_000 and i % 5 == 0]
    assert set(per) == set(asked)
    for q in asked:
        others = [i for i in vec if i != q and len(vec[i]) == len(vec[q])]
        mine = sorted(per[q], key=lambda x: x["rank"])
        assert [x["rank"] for x in mine] == list(range(1, min(5, len(others)) + 1))
        assert [(-x.score, x.vec_id) for x in mine] == sorted((-x.score, x.vec_id) for x in mine)


# URL rules

def test_mined_rules_leave_out_no_token_of_a_deep_url(spark):
    """Rows of more tokens than FP-growth is given: still all rules of counting all subsets."""
    rng = random.Random(5)
    names = list("abcdefg")
    rows = []
    for _ in range(300):
        items = sorted(set(rng.choices(names, k=rng.randint(0, 9))))
        bad = rng.random() < (0.9 if {"a", "b"} <= set(items) else 0.8 if {"e", "f", "g"} <= set(items) else 0.3)
        rows.append((items, bad))
    p = UrlRuleParams(min_support=0.02, min_count=4, min_confidence=0.6, row_tokens=2)
    got = {tuple(r["items"]): (r.support, round(r.confidence, 9))
           for r in mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), p).collect()}
    full = [r for r in rows if r[0]]
    rules = {}
    for n in range(1, 8):
        for items in combinations(names, n):
            hit = [b for t, b in full if set(items) <= set(t)]
            if sum(hit) >= max(0.02 * len(full), 4) and sum(hit) / len(hit) >= 0.6:
                rules[items] = (sum(hit), round(sum(hit) / len(hit), 9))
    want = {i: v for i, v in rules.items()
            if not any(set(j) < set(i) and w[1] >= v[1] for j, w in rules.items())}
    assert got == want and any(len(r) > 2 for r in want)


def test_mined_rules_equal_counting_all_subsets(spark):
    rng = random.Random(8)
    names = list("abcdefg")
    rows = []
    for _ in range(300):
        items = sorted(set(rng.choices(names, k=rng.randint(0, 5))))
        bad = rng.random() < (0.9 if {"a", "b"} <= set(items) else 0.8 if "g" in items else 0.2)
        rows.append((items, bad))
    p = UrlRuleParams(min_support=0.02, min_count=4, min_confidence=0.6)
    got = {tuple(r["items"]): (r.support, round(r.confidence, 9))
           for r in mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), p).collect()}
    full = [r for r in rows if r[0]]
    least = max(p.min_support, p.min_count / len(full)) * len(full)
    rules = {}
    for n in range(1, 8):
        for items in combinations(names, n):
            hit = [b for t, b in full if set(items) <= set(t)]
            if sum(hit) >= least and sum(hit) / len(hit) >= p.min_confidence:
                rules[items] = (sum(hit), round(sum(hit) / len(hit), 9))
    want = {i: v for i, v in rules.items()
            if not any(set(j) < set(i) and w[1] >= v[1] for j, w in rules.items())}
    assert got == want and want


@pytest.mark.parametrize("depth", [18, 40])
def test_rules_of_a_hot_deep_url(spark, depth):
    """One URL of many segments, then nested ones: no combination of every subset."""
    deep = [(["host:h"] + [f"path:{i:02}" for i in range(depth)], True)] * 2_500
    nested = [([f"seg:{j:02}" for j in range(i)], True) for i in range(1, depth)]
    clean = [(["host:h", "path:ok"], False)] * 3_000
    rows = spark.createDataFrame(deep + nested + clean, "tokens array<string>, bad boolean")
    begin = time.monotonic()
    got = {tuple(r["items"]): (r.support, r.confidence) for r in mine_rules(rows).collect()}
    assert time.monotonic() - begin < 60
    # Tokens that always stand together are one, by its smallest; shorter rules suffice.
    assert got[("path:00",)] == (2_500, 1.0) and ("seg:00",) in got
    assert all(len(r) == 1 for r in got)


def test_url_verdicts(spark):
    urls = [
        ("http://a.com/x", "a.com", "/x", "com/", "allow"),
        ("HTTPS://A.Example.COM/en/1?q#f", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://x.www.example.com/en/a://b", "x.www.example.com", "/en/a://b", "www.example.com/en/", "allow"),
        ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        ("http://b.net/es/x", "b.net", "/es/x", "net/es/", "block"),
        ("http://b.net", "b.net", "", None, "allow"), ("http://a.com", "a.com", "", None, "allow"),
        ("//", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("no scheme/en", "", "", None, "allow"), ("http://?x", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "h", "r") for i, u in enumerate(urls)] * 2,
                                  "page_id long, url string, verdict string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_urls(pages, labels).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.page_id][1:]
    assert filter_urls(pages.limit(0), labels).collect() == []


def test_mined_rule_blocks(spark):
    pages = spark.createDataFrame(
        [(i, f"http://h{i % 7}.org/{'casino' if i % 3 == 0 else 'news'}/{i}") for i in range(90)],
        "page_id long, url string")
    labels = spark.createDataFrame(
        [(i, 0 if i % 3 == 0 else 1, 0) for i in range(60)] + [(None, 0, 0), (1, None, None)],
        "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in filter_urls(pages, labels).collect()}
    assert all((got[i].verdict == "block") == (i % 3 == 0) and got[i].rule is None for i in range(90))


# Search

def slow_bm25(docs_, queries, k, k1=1.2, b=0.75):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    words = [(d, Counter(low(t)), len(low(t))) for d, t in docs_]
    n, mean = len(words), sum(x[2] for x in words) / max(1, len(words))
    df = Counter(w for _, c, _ in words for w in c)
    out = {}
    for q, t in queries:
        hits = []
        for d, c, dl in words:
            s = sum(m * round(1e9 * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1)
                              / (c[w] + k1 * (1 - b + b * dl / mean))) for w, m in Counter(low(t)).items() if w in c)
            if s > 0 and d != q and d is not None:
                hits.append((-s / 1e9, d))
        out[q] = [(d, round(-s, 5)) for s, d in sorted(hits)[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("shard, block, words", [(7, 2, 1000), (8192, 64, 40), (50, 8, 10**6)])
def test_search_equals_brute_force(spark, shard, block, words):
    rng = random.Random(shard)
    vocab = [f"W{i}" for i in range(60)]
    pick = lambda n: " ".join(rng.choices(vocab, weights=[1 / (i + 1) for i in range(60)], k=n))
    data = [(i, pick(rng.randint(0, 40))) for i in range(150)] + [(500, None), (501, ""), (None, "w0 w1")]
    data += [(600 + i, data[3][1]) for i in range(20)]
    ask = [(i, data[i][1]) for i in range(0, 150, 10)] + [(900, "w59 w58"), (901, "nothing"), (902, None)]
    p = SearchParams(k=4, shard_docs=shard, block=block, query_words=words)
    got = defaultdict(list)
    rows = top_k(spark.createDataFrame(data, "doc_id long, text string").repartition(3),
                 spark.createDataFrame(ask + ask[:2], "query_id long, text string"), p).collect()
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.doc_id, round(r.score, 5)))
    assert dict(got) == slow_bm25(data, ask, 4)


@pytest.mark.parametrize("own", [2, 12, 40])
def test_search_passes_over_repeated_rows_of_the_own_id(spark, own):
    text = "w0 w1 w2 w3"
    data = [(7, text)] * own + [(100 + i, f"w{i % 4} w{(i + 1) % 5} x{i} x{i % 7}") for i in range(60)]
    ask = [(7, text)]
    got = top_k(spark.createDataFrame(data, "doc_id long, text string").coalesce(1),
                spark.createDataFrame(ask, "query_id long, text string"), SearchParams(k=4)).collect()
    got = [(r.doc_id, round(r.score, 5)) for r in sorted(got, key=lambda r: r["rank"])]
    assert {7: got} == slow_bm25(data, ask, 4)


@pytest.mark.parametrize("more", [
    {"dense": 0}, {"dense": 3, "posting_cost": 1e9, "block": 4}, {"posting_cost": 1e9}, {"shard_words": 50}])
def test_search_by_matrix_rows_postings_and_bounds_equals_brute_force(spark, more):
    rng = random.Random(9)
    pick = lambda n: " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(n))
    data = [(i, pick(rng.randint(0, 60))) for i in range(120)] + [(300, None)]
    ask = [(i, data[i][1]) for i in range(0, 120, 6)] + [(900, "w39"), (901, "nothing")]
    got = defaultdict(list)
    rows = top_k(spark.createDataFrame(data, "doc_id long, text string").repartition(2),
                 spark.createDataFrame(ask, "query_id long, text string"), SearchParams(k=5, **more)).collect()
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.doc_id, round(r.score, 5)))
    assert dict(got) == slow_bm25(data, ask, 5)


def test_many_texts_are_cut_like_one():
    texts = ["  A b ", "", None, " ", "a\x0bB\x1cc\x0cd e\x85f\u0130", "x\x00y", "\n\t"]
    words, count = split_words(pa.array(texts))
    assert [w.encode() for w in words.to_pylist()] == [w for t in texts for w in words_of(t)]
    assert count.tolist() == [len(words_of(t)) for t in texts]
    assert [len(x) for x in split_words(pa.array([], pa.string()))] == [0, 0]


def test_search_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert top_k(df, df.withColumnRenamed("doc_id", "query_id")).collect() == []


# Neighbours

def slow_nearest(rows, is_query, k):
    good = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and any(v)
            and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q, a in good:
        if is_query(q):
            near = {}
            for i, b in good:
                if i != q and len(a) == len(b):
                    cos = np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
                    near[i] = max(cos, near.get(i, -2))
            out[q] = sorted(((-round(s, 9), i) for i, s in near.items()))[:k]
    return {q: [(i, -s) for s, i in v] for q, v in out.items() if v}


def test_all_probes_find_the_exact_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, rows[10][1]) for i in range(40)]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (304, [float("nan")] * 6),
             (305, [float("inf")] * 6), (None, [1.0] * 6), (306, [1.0, 2.0]), (308, [1e200] * 6), rows[4], rows[4]]
    df = spark.createDataFrame([(i, v, 0.5, 1) for i, v in rows],
                               "vec_id long, embedding array<double>, score double, rank int")
    p = LshParams(k=5, tables=4, hashes=3, width=4.0, index_cell=16, query_cell=4)
    got = defaultdict(list)
    found = nearest(df, lambda c: c % 10 == 0, p, probes=27).collect()
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    want = slow_nearest(rows, lambda i: i % 10 == 0, 5)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in v}) for q, v in want.items())
    assert set(got) <= set(want) and hit >= 0.97 * sum(map(len, want.values()))
    for q, v in want.items():
        exact = dict(v)
        assert all(abs(s - exact[i]) < 1e-8 for i, s in got[q] if i in exact)
    assert nearest(df.limit(0), lambda c: c % 10 == 0, p).collect() == []


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = slow_nearest(rows, lambda i: i % 50 == 0, 5)
    got = defaultdict(set)
    for r in nearest(df, lambda c: c % 50 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hit = sum(len(got[q] & {i for i, _ in v}) for q, v in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))
