"""Knowledge-graph views of the given tables.

* Documents of sites below 10 are the source graph, those of the other sites the
  target graph.
* Plain-http pages face https pages.
* Customers face suppliers.
* Orders face parts: an order line is a pair with a similarity vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.config import FtrlParams
from twinweave.operators.learn import ftrl_score
from twinweave.operators.skew import balanced_join
from twinweave.schema import PAIR
from twinweave.sources import new_model, spread_small

ORDER_DIM = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sub(column: str) -> Column:
    return F.col(column).cast("string").alias("sub")


class Documents:
    """Predicates ``text``, ``lines``, ``lang`` and ``quality`` of both sides."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._docs = table(spark, sf_dir, "documents")
        self._labels = table(spark, sf_dir, "labels")

    def _sides(self, *columns: Column) -> tuple[DataFrame, DataFrame]:
        low_site = F.substring("source", 4, 9).cast("int") < 10
        return tuple(
            spread_small(self._docs.where(side).select(_sub("doc_id"), *columns), "sub")
            for side in (low_site, ~low_site)
        )

    def text(self) -> tuple[DataFrame, DataFrame]:
        return self._sides(F.col("text").alias("obj"))

    def lang(self) -> tuple[DataFrame, DataFrame]:
        return self._sides(F.col("lang").alias("obj"))

    def lines(self) -> tuple[DataFrame, DataFrame]:
        return tuple(
            kv.select("sub", F.explode(F.split("obj", "\n")).alias("obj")).where(F.col("obj") != "")
            for kv in self.text()
        )

    def quality(self) -> tuple[DataFrame, DataFrame]:
        known = self._labels.select(_sub("doc_id"), F.col("quality").cast("string").alias("obj"))
        return tuple(
            known.join(side.select("sub"), "sub", "left_semi") for side in self.lang()
        )

    def toxic(self) -> tuple[DataFrame, DataFrame]:
        """Toxicity, as stated for documents of good quality."""
        known = self._labels.where(F.col("quality") == 1).select(
            _sub("doc_id"), F.col("toxic").cast("string").alias("obj"))
        return tuple(
            known.join(side.select("sub"), "sub", "left_semi") for side in self.lang()
        )

    def copies(self) -> DataFrame:
        """Reference alignment: equal texts across the two sides."""
        ids = [
            kv.select(F.col("sub").alias(name), F.md5("obj").alias("digest"), F.length("obj").alias("n"))
            for kv, name in zip(self.text(), PAIR)
        ]
        met = balanced_join(*ids, ["digest", "n"], ["source"], ["target"])
        return met.select(*PAIR)


def pages(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Predicates ``url`` and ``title`` of http and https pages."""
    both = table(spark, sf_dir, "pages").select(
        _sub("page_id"), "url",
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.col("url").startswith("https:").alias("secure"),
    )
    return {
        name: tuple(
            both.where(side).select("sub", F.col(name).alias("obj"))
            for side in (~F.col("secure"), F.col("secure"))
        )
        for name in ("url", "title")
    }


def parties(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Predicates ``name`` and ``nation`` of customers and suppliers."""
    nations = table(spark, sf_dir, "nation")
    sides = [
        table(spark, sf_dir, "customer").select(
            _sub("c_custkey"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey")),
        table(spark, sf_dir, "supplier").select(
            _sub("s_suppkey"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n_nationkey")),
    ]
    return {
        "name": tuple(s.select("sub", F.col("name").alias("obj")) for s in sides),
        "nation": tuple(
            s.join(nations, "n_nationkey").select("sub", F.col("n_name").alias("obj")) for s in sides
        ),
    }


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part names; small sizes face large ones.  Few names, so every key is heavy."""
    both = table(spark, sf_dir, "part").select(_sub("p_partkey"), F.col("p_name").alias("key"), "p_size")
    return (
        both.where(F.col("p_size") <= 25).select("sub", "key"),
        both.where(F.col("p_size") > 25).select("sub", "key"),
    )


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, target, sim_v, flag, closed)`` of every distinct (order, part)."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy("l_orderkey", "l_partkey").agg(
        F.max("l_discount").alias("d"), F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"),
        F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"),
    ).select(
        F.col("l_orderkey").cast("string").alias("source"),
        F.col("l_partkey").cast("string").alias("target"),
        F.array(F.col("d") * 10, F.col("q") / 50, F.col("t") * 12.5).alias("sim_v"),
        "flag", (F.col("status") == "F").cast("double").alias("closed"),
    )


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, target, sim_v, score, flag, closed)``, scored by the untrained mean."""
    return ftrl_score(order_parts(spark, sf_dir), new_model(spark, ORDER_DIM, FtrlParams()))


def order_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference alignment of orders and parts: the pairs with a returned line."""
    line = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return line.select(
        F.col("l_orderkey").cast("string").alias("source"),
        F.col("l_partkey").cast("string").alias("target"),
    ).distinct()


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for every pair above quantity share 0.5: is the line closed?"""
    return order_parts(spark, sf_dir).where(F.col("sim_v")[1] > 0.5).select(
        *PAIR, "sim_v", F.col("closed").alias("is_match")
    )
