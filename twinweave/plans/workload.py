"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.config import (
    AttributeConfig, FtrlParams, FusionConfig, LevelConfig, MatchingConfig, PredicateRef,
    RelationConfig, Thresholds,
)
from twinweave.operators.blocking import (
    Level, block_keys, candidate_pairs, instances, key_table, pair_load, partition_keys, unique_pairs,
)
from twinweave.operators.compare import (
    Attribute, Relation, attribute_similarity, compare, relation_similarity,
)
from twinweave.operators.decide import apply_labels, best_matches, decide
from twinweave.operators.evaluate import evaluate, evaluate_blocking
from twinweave.operators.fuse import (
    fuse_attribute, fuse_relation, intersect_set, longest, prefer_target, union_set,
)
from twinweave.operators.labels import (
    correct, label_pairs, label_worklist, sample_training_pairs, uncertain, upsert_labels,
)
from twinweave.operators.learn import (
    ftrl_fit, ftrl_fit_batch, ftrl_fit_distributed, ftrl_score, ftrl_score_by, ftrl_update,
)
from twinweave.operators.skew import balanced_join, default_tasks, load_report, split_from
from twinweave.operators.words import rare_word_keys, tokenize, word_frequency
from twinweave.plans.graphs import (
    ORDER_DIM, Documents, order_labels, order_parts, order_ref, order_scores, pages, parties,
    parts, table,
)
from twinweave.plans.matching import run_matching
from twinweave.schema import PAIR
from twinweave.sources import Catalog, load_model, materialise, new_model, save_model, stage_root
from twinweave.streaming.candidate_feed import ARRIVING, FeedLevel, follow_instances, pair_log, seed_feed
from twinweave.streaming.label_feed import append_labels, compact_labels, label_log, merged_labels

Query = Callable[[SparkSession, str], DataFrame]

# Parameters shared with the SQL of ``oracle``.
FIT = FtrlParams(max_iter=200, epochs=10)
WEIGHTS = (0.8, 0.6, -0.4)
# Settings of three models that are updated side by side.
MODEL_FITS = {
    "R": FIT,
    "A": FtrlParams(l1=0.01, l2=0.1, alpha=0.3, beta=1.0, max_iter=200, epochs=10),
    "N": FtrlParams(l1=0.0, l2=1.0, alpha=0.02, beta=0.1, max_iter=200, epochs=10),
}
N_WORKERS = 10
BATCH_STEPS = 4
# Batches in which instances arrive.
BATCHES = 3


def _vector(df: DataFrame, names: list[str], column: str = "sim_v") -> DataFrame:
    return df.select(
        *PAIR, *[F.round(F.col(column)[i], 6).alias(n) for i, n in enumerate(names)]
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _model_row(df: DataFrame) -> DataFrame:
    cols = [F.round(F.col(a)[i], 5).alias(f"{a}{i}") for a in "znw" for i in range(ORDER_DIM)]
    return df.select("model", *cols, "version")


# -- words and keys ---------------------------------------------------------


def kg_tokens(spark, d):
    s, t = Documents(spark, d).text()
    return tokenize(s.unionByName(t)).groupBy("sub", "word").agg(F.count(F.lit(1)).alias("n"))


def document_words(spark, d):
    return word_frequency(*Documents(spark, d).text())


def _keys(kvs, max_len):
    frequency = materialise(word_frequency(*kvs), "word-frequency")
    both = kvs[0].withColumn("db", F.lit("source")).unionByName(
        kvs[1].withColumn("db", F.lit("target"))
    )
    return rare_word_keys(both, frequency, max_len, keep=("db",), counted=True)


def rare_word_keys_1(spark, d):
    return _keys(Documents(spark, d).text(), 1)


def rare_word_keys_2(spark, d):
    return _keys(pages(spark, d)["title"], 2)


def word_pair_keys(spark, d):
    return _keys(Documents(spark, d).lines(), 2)


# -- blocking ---------------------------------------------------------------


def _document_keys(spark, d):
    s, t = Documents(spark, d).text()
    return block_keys(s, t, [Level(s, t)])


def _partition(spark, d, *names):
    docs = Documents(spark, d)
    s, t = docs.lang()
    return partition_keys(s, t, [Level(*getattr(docs, n)(), None) for n in names])


def partition_keys_lang(spark, d):
    return key_table(_partition(spark, d, "lang").candidate)


def partition_wildcard_quality(spark, d):
    return key_table(_partition(spark, d, "quality").candidate)


def partition_two_levels(spark, d):
    return key_table(_partition(spark, d, "quality", "lang").candidate)


def unique_blocks(spark, d):
    return _document_keys(spark, d).unique_rows


def prefix_table_block(spark, d):
    """A stored partition table may hold a row twice; pairs are those of distinct rows."""
    s, t = Documents(spark, d).text()
    once = instances(s, t)
    return candidate_pairs(block_keys(s, t, [Level(s, t)], prefix=once.unionByName(once)))


def document_unique_pairs(spark, d):
    return unique_pairs(_document_keys(spark, d))


def document_candidate_pairs(spark, d):
    return candidate_pairs(_document_keys(spark, d))


def multi_level_block(spark, d):
    docs = Documents(spark, d)
    s, t = docs.text()
    levels = [Level(*docs.lang(), None), Level(*docs.quality(), None), Level(s, t)]
    return candidate_pairs(block_keys(s, t, levels))


def three_level_wildcard(spark, d):
    """Quality and toxicity, both mostly unknown, then rare words."""
    docs = Documents(spark, d)
    s, t = docs.text()
    levels = [Level(*docs.quality(), None), Level(*docs.toxic(), None), Level(s, t)]
    return candidate_pairs(block_keys(s, t, levels))


def multi_level_unique(spark, d):
    docs = Documents(spark, d)
    s, t = docs.text()
    return unique_pairs(block_keys(s, t, [Level(*docs.quality(), None), Level(s, t)]))


def missing_null_block(spark, d):
    docs = Documents(spark, d)
    s, t = docs.text()
    levels = [Level(*docs.quality(), None), Level(s, t)]
    return candidate_pairs(block_keys(s, t, levels, missing="null_block"))


def missing_drop(spark, d):
    docs = Documents(spark, d)
    s, t = docs.text()
    levels = [Level(*docs.quality(), None), Level(s, t)]
    return candidate_pairs(block_keys(s, t, levels, missing="drop"))


def wildcard_load(spark, d):
    return pair_load(_partition(spark, d, "quality"), N_WORKERS)


def stream_candidate_pairs(spark, d):
    """Quality and rare words, instances arriving in three batches; the pairs of the batch run."""
    docs = Documents(spark, d)
    text = docs.text()
    frequency = materialise(word_frequency(*text), "word-frequency")
    both, known = (
        side[0].withColumn("db", F.lit("source")).unionByName(side[1].withColumn("db", F.lit("target")))
        for side in (text, docs.quality())
    )
    # A label is one of its document, on whichever side that stands; texts travel once.
    quality = known.groupBy("sub").agg(F.collect_set("obj").alias("quality"))
    arrived = both.repartition(max(BATCHES, default_tasks(spark)), "sub").join(quality, "sub", "left").select(
        "sub", "db", F.array("quality", F.array("obj")).alias("values"))
    root = f"{stage_root(spark)}/twinweave/feed-{uuid.uuid4().hex}"
    arrived.write.parquet(f"{root}/arrived")
    files = len(spark.read.schema(ARRIVING).parquet(f"{root}/arrived").inputFiles())
    arriving = (
        spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", -(-files // BATCHES))
        .parquet(f"{root}/arrived")
    )
    seed_feed(spark, root, 2)
    query = follow_instances(arriving, [FeedLevel(), FeedLevel(frequency)], root, f"{root}/checkpoint")
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return pair_log(spark, root).read(BATCHES)


# -- balanced join ----------------------------------------------------------


def block_load_report(spark, d):
    return load_report(*parts(spark, d), ["key"], N_WORKERS)


def balanced_join_parts(spark, d):
    """Names cut into a thousand workers' shares, so that the heavy ones are really split."""
    # As numbers before the join, so that they are not parsed again for every pair.
    left, right = (
        side.select("key", F.col("sub").cast("bigint").alias(name)) for side, name in zip(parts(spark, d), "st"))
    joined = balanced_join(left, right, ["key"], ["s"], ["t"], n_workers=1_000, min_load=0.0)
    return joined.groupBy("key").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(F.col("s") - F.col("t")).alias("apart"))


def balanced_join_lines(spark, d):
    line = table(spark, d, "lineitem")
    sides = [
        line.where(F.col("l_linestatus") == status).select(
            "l_orderkey", F.col("l_partkey").alias(f"{a}_part"), F.col("l_linenumber").alias(f"{a}_line")
        )
        for status, a in (("O", "s"), ("F", "t"))
    ]
    joined = balanced_join(
        *sides, ["l_orderkey"], ["s_part", "s_line"], ["t_part", "t_line"], N_WORKERS, min_load=0.0
    )
    return joined.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(F.col("s_part") + F.col("t_part")).alias("part_sum")
    )


# -- comparison -------------------------------------------------------------


def _document_pairs(spark, d):
    return materialise(candidate_pairs(_document_keys(spark, d)), "candidate-pairs")


def _page_pairs(spark, d):
    s, t = pages(spark, d)["title"]
    return materialise(candidate_pairs(block_keys(s, t, [Level(s, t, 2)])), "candidate-pairs")


def compare_exact_jaccard(spark, d):
    out = relation_similarity(
        _document_pairs(spark, d), *Documents(spark, d).lines(), threshold=1.0
    )
    return _rounded(out, "sim")


def compare_rows_jaccard(spark, d):
    """Instances of more than ten lines as rows: the same values as of profiles."""
    out = relation_similarity(
        _document_pairs(spark, d), *Documents(spark, d).lines(), threshold=1.0, profile_values=10
    )
    return _rounded(out, "sim")


def compare_empty_values(spark, d):
    """Https urls that junk removal may empty, against http urls of which some are NULL."""
    s, t = pages(spark, d)["url"]
    out = attribute_similarity(
        _page_pairs(spark, d),
        s.withColumn("obj", F.when(F.col("obj").contains("www."), F.col("obj"))), t,
        default=0.3, metric="levenshtein", ignore="https://.*[0-4]$",
    )
    return _rounded(out, "sim")


def compare_levenshtein(spark, d):
    s, t = pages(spark, d)["url"]
    out = attribute_similarity(_page_pairs(spark, d), s, t, metric="levenshtein", ignore="https?://")
    return _rounded(out, "sim")


def compare_ratio(spark, d):
    out = attribute_similarity(_document_pairs(spark, d), *Documents(spark, d).text())
    return _rounded(out, "sim")


def compare_ratio_urls(spark, d):
    s, t = pages(spark, d)["url"]
    out = attribute_similarity(_page_pairs(spark, d), s, t, ignore="https?://")
    return _rounded(out, "sim")


def compare_soft_jaccard(spark, d):
    out = relation_similarity(_document_pairs(spark, d), *Documents(spark, d).lines())
    return _rounded(out, "sim")


def attribute_default_fill(spark, d):
    out = attribute_similarity(
        _document_pairs(spark, d), *Documents(spark, d).quality(), default=0.126, metric="equal"
    )
    return _rounded(out, "sim")


def attribute_fanout(spark, d):
    docs = Documents(spark, d)
    out = attribute_similarity(_document_pairs(spark, d), *docs.lines(), metric="equal")
    return out.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("sim"), 6).alias("equal_lines")
    )


def attribute_best(spark, d):
    docs = Documents(spark, d)
    return attribute_similarity(_document_pairs(spark, d), *docs.lines(), metric="equal", multi="max")


def sim_vector(spark, d):
    docs = Documents(spark, d)
    features = [
        Attribute(*docs.lang(), metric="equal"),
        Attribute(*docs.quality(), default=0.3, metric="equal"),
        Relation(*docs.lines(), default=0.124, threshold=1.0),
    ]
    return _vector(compare(_document_pairs(spark, d), features), ["lang", "quality", "lines"])


# -- keys split at low limits: the same results as unsplit --------------------


def split_candidate_pairs(spark, d):
    with split_from(spark, 2, 4):
        return candidate_pairs(_document_keys(spark, d))


def split_sim_vector(spark, d):
    with split_from(spark, 2, 4):
        return sim_vector(spark, d)


def split_top1(spark, d):
    with split_from(spark, 2, 4):
        return top1_matches(spark, d)


def split_fuse_common(spark, d):
    with split_from(spark, 2, 4):
        return fuse_relation_common(spark, d)


# -- scores and decisions ---------------------------------------------------


def score_mean(spark, d):
    return _rounded(order_scores(spark, d).select(*PAIR, "score"), "score")


def _fixed_model(spark):
    return new_model(spark, ORDER_DIM).withColumns(
        {"w": F.array(*[F.lit(w) for w in WEIGHTS]), "trained": F.lit(True)}
    )


def score_trained(spark, d):
    out = ftrl_score(order_parts(spark, d), _fixed_model(spark))
    return _rounded(out.select(*PAIR, "score"), "score")


def score_by_model(spark, d):
    fixed = _fixed_model(spark)
    models = fixed.withColumn("model", F.lit("R")).unionByName(
        new_model(spark, ORDER_DIM, model="A")
    ).unionByName(new_model(spark, ORDER_DIM, model="N"))
    named = order_parts(spark, d).withColumnRenamed("flag", "model")
    return _rounded(ftrl_score_by(named, models).select(*PAIR, "model", "score"), "score")


def top1_matches(spark, d):
    return best_matches(order_scores(spark, d), 0.5)


def mutual_best_matches(spark, d):
    return best_matches(order_scores(spark, d), 0.5, "mutual_best")


def one_to_one_matches(spark, d):
    return best_matches(order_scores(spark, d), 0.5, "one_to_one")


def match_with_labels(spark, d):
    scores = order_scores(spark, d)
    return apply_labels(best_matches(scores, 0.5), order_labels(spark, d))


def decide_two_tables(spark, d):
    scores = order_scores(spark, d)
    returned = F.col("flag") == "R"
    return decide(scores.where(returned), scores.where(~returned), Thresholds(0.4, 0.5))


# -- labels -----------------------------------------------------------------


def label_alignment(spark, d):
    labelled = label_pairs(order_parts(spark, d), order_ref(spark, d))
    return _vector(labelled, ["d", "q", "t"]).join(labelled.select(*PAIR, "is_match"), PAIR)


def _ref_labels(spark, d):
    return label_pairs(order_parts(spark, d), order_ref(spark, d))


def label_upsert(spark, d):
    out = upsert_labels(_ref_labels(spark, d), order_labels(spark, d))
    return out.select(*PAIR, F.size("sim_v").alias("dim"), "is_match")


def label_correct(spark, d):
    scores = order_scores(spark, d)
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("source"),
        F.col("o_custkey").cast("string").alias("target"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_match"),
    )
    out = correct(_ref_labels(spark, d), orders, scores)
    return out.select(*PAIR, F.size("sim_v").alias("dim"), "is_match")


def label_history(spark, d):
    """Labels of three batches, the first run twice, compacted between the second and third."""
    log = label_log(spark, f"{stage_root(spark)}/twinweave/labels-{uuid.uuid4().hex}")
    log.seed(_ref_labels(spark, d))
    closed = order_labels(spark, d)
    for _ in range(2):
        append_labels(log, closed, 1)
    taxed = order_parts(spark, d).where(F.col("sim_v")[2] > 0.5)
    append_labels(log, taxed.withColumn("is_match", (F.col("flag") == "N").cast("double")), 2)
    compact_labels(log, 2)
    cheap = order_parts(spark, d).where(F.col("sim_v")[0] < 0.25)
    append_labels(log, cheap.withColumn("is_match", (F.col("flag") == "A").cast("double")), 3)
    return merged_labels(log, 3).select(*PAIR, F.size("sim_v").alias("dim"), "is_match")


def uncertain_band(spark, d):
    return _rounded(uncertain(order_scores(spark, d), 0.4, 0.6).select(*PAIR, "score"), "score")


def label_work(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("sub"), F.col("o_orderpriority").alias("obj"))
    names = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("sub"), F.col("p_name").alias("obj"))
    work = label_worklist(order_scores(spark, d), 0.4, 0.6, 50, {"what": (orders, names)}, seed=7)
    return _rounded(work.select(*PAIR, "score", "s_what", "t_what"), "score")


def training_sample(spark, d):
    return _vector(sample_training_pairs(order_scores(spark, d), 200, 0.5, seed=3), ["d", "q", "t"])


# -- learning ---------------------------------------------------------------


def _model_labels(spark, d):
    return order_parts(spark, d).select(
        *PAIR, "sim_v", F.col("closed").alias("is_match"), F.col("flag").alias("model")
    )


def ftrl_fit_group(spark, d):
    return _model_row(ftrl_fit(_model_labels(spark, d), ORDER_DIM, FIT, seed=1))


def ftrl_fit_averaged(spark, d):
    return _model_row(ftrl_fit_distributed(_model_labels(spark, d), ORDER_DIM, FIT, seed=1))


def ftrl_fit_full_batch(spark, d):
    return _model_row(ftrl_fit_batch(_model_labels(spark, d), ORDER_DIM, FIT, BATCH_STEPS))


def ftrl_update_batch(spark, d):
    chosen = order_scores(spark, d).withColumnRenamed("closed", "is_match")
    batch = label_worklist(chosen, 0.4, 0.6, 400, seed=5)
    updated = ftrl_update(
        new_model(spark, ORDER_DIM, FIT), batch, ORDER_DIM, neg_rate=0.25, seed=2
    )
    return _model_row(updated)


def ftrl_update_models(spark, d):
    """Three models, each with settings of its own, updated from one batch."""
    chosen = order_scores(spark, d).withColumnsRenamed({"closed": "is_match", "flag": "model"})
    batch = label_worklist(chosen, 0.4, 0.6, 600, seed=9)
    models = [new_model(spark, ORDER_DIM, p, name) for name, p in MODEL_FITS.items()]
    return _model_row(
        ftrl_update(models[0].unionByName(models[1]).unionByName(models[2]), batch, ORDER_DIM, seed=4))


def model_round_trip(spark, d):
    """Fitted, saved, loaded again, and applied."""
    path = f"{stage_root(spark)}/twinweave/model-{uuid.uuid4().hex}"
    save_model(ftrl_fit(_model_labels(spark, d), ORDER_DIM, FIT, seed=1), path, "json")
    models = load_model(spark, path, "json")
    named = order_parts(spark, d).withColumnRenamed("flag", "model")
    scored = ftrl_score_by(named, models).join(
        models.select("model", "max_iter", "epochs"), "model")
    return _rounded(scored.select(*PAIR, "model", "max_iter", "epochs", "score"), "score")


# -- evaluation and fusion --------------------------------------------------


def _quality(df):
    return _rounded(df, "precision", "recall", "f1")


def eval_prf(spark, d):
    return _quality(evaluate(top1_matches(spark, d), order_ref(spark, d)))


def eval_heldout(spark, d):
    return _quality(
        evaluate(top1_matches(spark, d), order_ref(spark, d), order_labels(spark, d))
    )


def eval_blocking(spark, d):
    docs = Documents(spark, d)
    keys = _document_keys(spark, d)
    n = [side.select("sub").distinct().count() for side in docs.lang()]
    out = evaluate_blocking(unique_pairs(keys), candidate_pairs(keys), docs.copies(), *n)
    return _rounded(out, "recall", "reduction")


def _party_matches(spark, d):
    s, t = parties(spark, d)["name"]
    return candidate_pairs(block_keys(s, t, [Level(s, t)]))


def fuse_attribute_longest(spark, d):
    return fuse_attribute(
        materialise(_party_matches(spark, d), "matches"), *parties(spark, d)["name"], longest, "name"
    )


def fuse_attribute_target(spark, d):
    docs = Documents(spark, d)
    copies = materialise(docs.copies(), "matches")
    return fuse_attribute(copies, *docs.quality(), prefer_target, "quality")


def fuse_relation_union(spark, d):
    matches = materialise(_party_matches(spark, d), "matches")
    return fuse_relation(matches, *parties(spark, d)["nation"], union_set, "nation")


def fuse_relation_common(spark, d):
    docs = Documents(spark, d)
    pairs = materialise(docs.copies(), "matches")
    out = fuse_relation(pairs, *docs.lines(), intersect_set, "line")
    return out.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("lines"))


def fuse_relation_rule(spark, d):
    """A rule of the user's own: values only one side has."""
    def apart(s, t):
        return F.array_union(F.array_except(s, t), F.array_except(t, s))

    matches = materialise(_party_matches(spark, d), "matches")
    return fuse_relation(matches, *parties(spark, d)["nation"], apart, "nation")


# -- whole runs -------------------------------------------------------------


def _document_catalog(spark, d):
    docs = Documents(spark, d)
    frames = {}
    for name in ("text", "lines", "lang", "quality"):
        s, t = getattr(docs, name)()
        frames[f"source.{name}"], frames[f"target.{name}"] = s, t
    return Catalog(spark, frames=frames)


def _refs(name):
    return PredicateRef(f"source.{name}"), PredicateRef(f"target.{name}")


def _end_to_end(**more):
    return MatchingConfig(
        "source.text", "target.text",
        partition_by=(LevelConfig(*_refs("lang"), max_len=None),),
        block_by=(LevelConfig(*_refs("text")),),
        attributes=(AttributeConfig("quality", *_refs("quality"), default=0.5, metric="equal"),),
        relations=(RelationConfig("lines", *_refs("lines"), default=0.124, threshold=1.0),),
        **more,
    )


def match_end_to_end(spark, d):
    """Partition by language, block on rare words, compare natively, mean score, top 1."""
    return run_matching(_document_catalog(spark, d), _end_to_end()).matches


def match_fused(spark, d):
    """The run with the quality of each match fused, and its lines counted."""
    config = _end_to_end(fuse=(
        FusionConfig("quality", *_refs("quality"), prefer_target),
        FusionConfig("line", *_refs("lines"), union_set, many=True),
    ))
    fused = run_matching(_document_catalog(spark, d), config).fused
    lines = fused["line"].groupBy(*PAIR).agg(F.count(F.lit(1)).alias("lines"))
    return fused["quality"].join(lines, PAIR, "left")


def _native(**more):
    return replace(_end_to_end(**more), partition_by=(), ftrl=FIT, train_size=200)


def match_learned_native(spark, d):
    """The run with a learner fitted on sampled, labelled pairs, over native features."""
    ref = Documents(spark, d).copies()
    return _quality(run_matching(_document_catalog(spark, d), _native(), ref=ref).quality)


def match_updated(spark, d):
    """The same, then answers for all copies: labels replaced, model updated, decided anew."""
    docs = Documents(spark, d)
    ref = materialise(docs.copies(), "ref")
    answers = ref.withColumn("is_match", F.lit(1.0))
    result = run_matching(_document_catalog(spark, d), _native(), ref=ref, answers=answers)
    cols = [F.round(F.col(a)[i], 5).alias(f"{a}{i}") for a in "znw" for i in range(2)]
    return result.model.select("model", *cols, "version")


def match_learned(spark, d):
    """The full run: fuzzy features and a learner fitted on sampled, labelled pairs."""
    config = MatchingConfig(
        "source.text", "target.text",
        block_by=(LevelConfig(*_refs("text")),),
        attributes=(AttributeConfig("text", *_refs("text")),),
        relations=(RelationConfig("lines", *_refs("lines"), default=0.124),),
    )
    result = run_matching(_document_catalog(spark, d), config, ref=Documents(spark, d).copies())
    return _quality(result.quality)


QUERIES: dict[str, Query] = {
    "kg_tokens": kg_tokens,
    "word_frequency": document_words,
    "rare_word_keys_1": rare_word_keys_1,
    "rare_word_keys_2": rare_word_keys_2,
    "word_pair_keys": word_pair_keys,
    "partition_keys_lang": partition_keys_lang,
    "partition_wildcard_quality": partition_wildcard_quality,
    "partition_two_levels": partition_two_levels,
    "unique_blocks": unique_blocks,
    "unique_pairs": document_unique_pairs,
    "candidate_pairs": document_candidate_pairs,
    "multi_level_block": multi_level_block,
    "multi_level_unique": multi_level_unique,
    "three_level_wildcard": three_level_wildcard,
    "missing_null_block": missing_null_block,
    "missing_drop": missing_drop,
    "wildcard_load": wildcard_load,
    "stream_candidate_pairs": stream_candidate_pairs,
    "block_load_report": block_load_report,
    "prefix_table_block": prefix_table_block,
    "balanced_join_parts": balanced_join_parts,
    "balanced_join_lines": balanced_join_lines,
    "compare_exact_jaccard": compare_exact_jaccard,
    "compare_rows_jaccard": compare_rows_jaccard,
    "compare_empty_values": compare_empty_values,
    "compare_levenshtein": compare_levenshtein,
    "compare_ratio": compare_ratio,
    "compare_ratio_urls": compare_ratio_urls,
    "compare_soft_jaccard": compare_soft_jaccard,
    "attribute_default_fill": attribute_default_fill,
    "attribute_fanout": attribute_fanout,
    "attribute_best": attribute_best,
    "sim_vector": sim_vector,
    "split_candidate_pairs": split_candidate_pairs,
    "split_sim_vector": split_sim_vector,
    "split_top1": split_top1,
    "split_fuse_common": split_fuse_common,
    "score_mean": score_mean,
    "score_trained": score_trained,
    "score_by_model": score_by_model,
    "top1_matches": top1_matches,
    "mutual_best_matches": mutual_best_matches,
    "one_to_one_matches": one_to_one_matches,
    "match_with_labels": match_with_labels,
    "decide_two_tables": decide_two_tables,
    "label_pairs": label_alignment,
    "label_upsert": label_upsert,
    "label_correct": label_correct,
    "label_log": label_history,
    "uncertain_band": uncertain_band,
    "label_worklist": label_work,
    "training_sample": training_sample,
    "ftrl_fit_group": ftrl_fit_group,
    "ftrl_fit_distributed": ftrl_fit_averaged,
    "ftrl_fit_batch": ftrl_fit_full_batch,
    "ftrl_update": ftrl_update_batch,
    "ftrl_update_models": ftrl_update_models,
    "model_round_trip": model_round_trip,
    "eval_prf": eval_prf,
    "eval_heldout": eval_heldout,
    "eval_blocking": eval_blocking,
    "fuse_attribute_longest": fuse_attribute_longest,
    "fuse_attribute_target": fuse_attribute_target,
    "fuse_relation_union": fuse_relation_union,
    "fuse_relation_common": fuse_relation_common,
    "fuse_relation_rule": fuse_relation_rule,
    "match_end_to_end": match_end_to_end,
    "match_fused": match_fused,
    "match_learned": match_learned,
    "match_learned_native": match_learned_native,
    "match_updated": match_updated,
}
