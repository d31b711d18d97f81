"""URL filter from association rules, in DataFrame functions and Spark's FP-growth.

URLs become sets of tokens.  FP-growth over the labelled ones finds token combinations
that go with bad pages; those with enough support and confidence, and without a shorter
rule at least as sure, become block rules.  An inverted index on each rule's rarest token
finds the rules that may match a URL.  Explicit host rules go before mined ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm.common import materialise

# Equal rows that are written at a time.
WRITTEN = 1_000
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The explicit rules (host, path, verdict).
HOST_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class UrlRuleParams:
    """Support is a share of the labelled URLs; ``min_count`` rows are needed besides.

    FP-growth is given the ``row_tokens`` tokens of a URL that go most surely with bad pages,
    as it makes a combination for every subset of them; tokens that always stand together count
    as one, and one that only bad pages have is a rule by itself.  What URLs of more tokens hold
    besides is found level by level (``longer_sets``), so the bound leaves out no rule.
    """

    min_support: float = 0.002
    min_count: int = 4
    min_confidence: float = 0.7
    row_tokens: int = 10


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/ ? #``, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, LETTERS, LETTERS.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments, query names; digits as ``0``."""
    part = lambda name, items: F.transform(
        F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(name + ":"), x))
    digits = lambda c: F.regexp_replace(F.translate(c, LETTERS, LETTERS.lower()), "[0-9]+", "0")
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    names = F.transform(F.split(digits(query_of(url)), "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(
        part("scheme", F.array(digits(scheme))), part("host", F.split(host_of(url), r"\.")),
        part("path", F.split(digits(path_of(url)), "/")), part("query", names)))


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest explicit rule that fits, nulls when none does.

    Length counts host and path together; among equals the longer host wins.  ``rules``
    are a handful of overrides that become one expression.
    """
    rule = verdict = None
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0], r[1]))
    for name, start, what in order:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def longer_sets(wide: DataFrame, front: DataFrame, least: float, row_tokens: int) -> DataFrame | None:
    """``(items)``: combinations with ``least`` bad rows that a row of over ``row_tokens`` tokens holds.

    ``wide (items, n, b)`` are all rows and ``front (items, n, b, key)`` the single tokens, ``key``
    being the rarest token with its rows.  A combination that has the rows of a shorter one, or
    that holds one which only bad rows have, can be no rule beside that one, and neither can any
    that holds it; so only the others grow.
    """
    found, size = [], 1
    while True:
        a, b = (front.select(F.col("items").alias(x), F.slice("items", 1, size - 1).alias("start"),
                             F.col("key").alias(f"{x}_key")) for x in "ab")
        last = lambda x: F.element_at(x, -1)
        grown = a.join(b, "start").where(last("a") < last("b")).select(
            F.array_append("a", last("b")).alias("set"), F.least("a_key", "b_key").alias("key"))
        subsets = F.transform("set", lambda x: F.array_remove("set", x))
        size += 1
        tried = materialise(grown.select("set", "key", F.explode(subsets).alias("items")).join(
            front.select("items", F.col("n").alias("_n")), "items").groupBy("set", "key").agg(
            F.count(F.lit(1)).alias("_in"), F.min("_n").alias("_n")).where(F.col("_in") == size), "url-tried")
        held = wide.where(F.size("items") >= size).select("items", "n", "b", F.explode("items").alias("token"))
        cut = F.when(F.size("items") > row_tokens, F.col("b")).otherwise(0)
        front = materialise(held.join(tried.withColumn("token", F.col("key.token")), "token").where(
            F.size(F.array_except("set", "items")) == 0).groupBy(F.col("set").alias("items"), "key", "_n").agg(
            F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum(cut).alias("_cut")).where(
            (F.col("b") >= least) & (F.col("_cut") > 0) & (F.col("n") < F.col("_n"))), "url-longer")
        if front.isEmpty():
            return reduce(DataFrame.unionByName, found) if found else None
        found.append(front.select("items"))
        front = front.where(F.col("b") < F.col("n"))


def mine_rules(labelled: DataFrame, p: UrlRuleParams = UrlRuleParams()) -> DataFrame:
    """``(items, confidence, support, key)`` from ``labelled (tokens, bad)``.

    ``support`` counts labelled rows with the combination and a bad label.  ``key`` is the
    combination's rarest token.  Rules that contain another rule of at least the same
    confidence are left out.  Rows without tokens say nothing; no rows, no rules.
    FP-growth runs over the bad rows; their combinations are counted over all rows.
    """
    # Equal token sets are one row with its counts.
    bad = F.coalesce(F.col("bad"), F.lit(False)).cast("bigint")
    rows = materialise(labelled.where(F.size("tokens") > 0).groupBy(
        F.array_sort("tokens").alias("tokens")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(bad).alias("b")), "url-items")
    spark = labelled.sparkSession
    n = rows.agg(F.sum("n")).first()[0]
    empty = "items array<string>, confidence double, support bigint, key string"
    if not n:
        return spark.createDataFrame([], empty)
    least = max(p.min_support * n, p.min_count)
    # Tokens of too few bad rows are in no rule; of those with the same rows one is kept.
    tokens = rows.select("n", "b", F.xxhash64("tokens").cast("decimal(38,0)").alias("_h"),
                         F.explode("tokens").alias("token"))
    single = materialise(tokens.groupBy("token").agg(
        F.sum("n").alias("rows"), F.sum("b").alias("bad"), F.sum("_h").alias("_h")), "url-tokens")
    kept = single.where(F.col("bad") >= least).groupBy("rows", "bad", "_h").agg(
        F.min("token").alias("token")).select(
        "token", (F.col("bad") / F.col("rows")).alias("sure"), "bad", "rows")
    kept = materialise(kept, "url-kept")
    # With a token that only bad rows have no longer combination is a rule.
    unsure = kept.where(F.col("bad") < F.col("rows"))
    surest = F.array_sort(F.collect_list(F.struct(
        (-F.col("sure")).alias("a"), (-F.col("bad")).alias("c"), "token")))
    wide = materialise(
        rows.select("tokens", "n", "b", F.explode("tokens").alias("token"))
        .join(unsure.drop("rows"), "token")
        .groupBy("tokens").agg(F.first("n").alias("n"), F.first("b").alias("b"), surest.alias("_surest"))
        .select(F.transform("_surest", lambda x: x["token"]).alias("items"), "n", "b")
        .groupBy("items").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "url-wide")
    narrow = materialise(wide.groupBy(F.slice("items", 1, p.row_tokens).alias("items")).agg(
        F.sum("n").alias("n"), F.sum("b").alias("b")), "url-narrow")
    sets = [kept.select(F.array("token").alias("items"))]
    cut = wide.where((F.size("items") > p.row_tokens) & (F.col("b") > 0))
    if not cut.isEmpty():
        rest = cut.select(F.explode("items").alias("token")).distinct().join(unsure, "token").select(
            F.array("token").alias("items"), F.col("rows").alias("n"), F.col("bad").alias("b"),
            F.struct("rows", "token").alias("key"))
        longer = longer_sets(wide, materialise(rest, "url-longer"), least, p.row_tokens)
        sets += [] if longer is None else [longer]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Only bad rows propose; a combination's confidence is counted over all rows below.  More
    # equal rows than make a combination frequent change nothing, so no more are written.
    enough = narrow.where(F.col("b") > 0).withColumn("m", F.least("b", F.lit(math.ceil(least))))
    n_bad = enough.agg(F.sum("m")).first()[0]
    proposing = enough.select("items", "m", F.explode(
        F.sequence(F.lit(0), F.floor((F.col("m") - 1) / WRITTEN))).alias("c")).select(
        "items", F.explode(F.array_repeat(F.lit(1), F.least(F.lit(WRITTEN), F.col("m") - F.col("c") * WRITTEN)
                                          .cast("int")))).select("items")
    if n_bad:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 1e-6) / n_bad),
                         minConfidence=p.min_confidence, numPartitions=parts).fit(proposing)
        sets.append(model.freqItemsets.select(F.array_sort("items").alias("items")))
    proposed = materialise(reduce(DataFrame.unionByName, sets).distinct(), "url-sets")
    index = proposed.select("items", F.explode("items").alias("token")).join(
        single.select("token", "rows"), "token").groupBy("items").agg(
        F.min(F.struct("rows", "token")).getField("token").alias("key"))
    counted = rows.select("tokens", "n", "b", F.explode("tokens").alias("key")).join(index, "key").where(
        F.size(F.array_except("items", "tokens")) == 0).groupBy("items", "key").agg(
        F.sum("n").alias("freq"), F.sum("b").alias("support"))
    rules = materialise(counted.where(F.col("support") >= least).withColumn(
        "confidence", F.col("support") / F.col("freq")
    ).where(F.col("confidence") >= p.min_confidence).drop("freq"), "url-rules")
    short = rules.select(F.col("items").alias("less"), F.col("confidence").alias("sure"),
                         F.col("key").alias("token"))
    covered = rules.select("items", "confidence", F.explode("items").alias("token")).join(
        short, "token").where(
        (F.size("less") < F.size("items")) & (F.size(F.array_except("less", "items")) == 0)
        & (F.col("sure") >= F.col("confidence"))).select("items").distinct()
    return rules.join(covered, "items", "left_anti").select("items", "confidence", "support", "key")


def matching_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, confidence, items)``: the surest rule that matches each of ``urls (url, tokens)``."""
    index = rules.select("key", "items", "confidence")
    hits = urls.select("url", "tokens", F.explode("tokens").alias("key")).join(index, "key").where(
        F.size(F.array_except("items", "tokens")) == 0)
    return hits.groupBy("url").agg(
        F.max(F.struct("confidence", "items")).alias("best")).select("url", "best.*")


def filter_urls(pages: DataFrame, labels: DataFrame, p: UrlRuleParams = UrlRuleParams(),
                rules=HOST_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, confidence)``, one row per row of ``pages``.

    A page is bad by label when ``labels`` (joined by id) calls it of low quality or toxic.
    The explicit rule's verdict counts, else ``block`` when a mined rule matches, else
    ``allow``.  A null URL has empty host and path and is allowed.  Each distinct URL is
    judged once, so a URL with many rows costs one.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = materialise(rows.where(F.col("url").isNotNull()).select("url").distinct().select(
        "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        url_tokens(F.col("url")).alias("tokens")), "urls")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    labelled = rows.where(F.col("url").isNotNull()).join(marks, "page_id").select(
        url_tokens(F.col("url")).alias("tokens"), "bad")
    mined = mine_rules(labelled, p)
    best = matching_rules(urls, mined)
    rule, verdict = host_rule(F.col("host"), F.col("path"), rules)
    judged = urls.join(best, "url", "left").select(
        "url", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
        .alias("verdict"), "confidence")
    return rows.join(judged, "url", "left").select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"), "confidence")
