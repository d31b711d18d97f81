"""Append-only tables of numbered versions, merged by whoever reads them.

A version holds only what is new in it, and writing it again replaces it, so a batch that
is run twice changes nothing.  ``compact`` puts a merged table under the versions up to one
number; it counts from the moment its number stands in ``bases``, so a compaction that broke
off is as if it had never begun.  Older versions stay readable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "v"


@dataclass(frozen=True)
class VersionLog:
    """Rows of ``schema`` under the shared folder ``root``."""

    spark: SparkSession
    root: str
    schema: T.StructType

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        rows.select(self.schema.fieldNames()).write.mode("overwrite").parquet(
            f"{self.root}/{kind}/{VERSION}={version}")

    def seed(self, rows: DataFrame | None = None) -> None:
        """Write version 0: ``rows``, or nothing yet."""
        nothing = self.spark.createDataFrame([], self.schema)
        self._write(nothing, "delta", 0)
        self.compact(nothing if rows is None else rows, 0)

    def append(self, rows: DataFrame, version: int) -> None:
        self._write(rows, "delta", version)

    def compact(self, merged: DataFrame, version: int) -> None:
        """Let ``merged`` stand for all versions up to ``version``."""
        self._write(merged, "base", version)
        self.spark.range(1).select(F.lit(version).cast("bigint").alias(VERSION)).write.mode("append").parquet(
            f"{self.root}/bases")

    def _based_on(self, version: int) -> int:
        bases = self.spark.read.schema(f"{VERSION} long").parquet(f"{self.root}/bases")
        return bases.where(F.col(VERSION) <= version).agg(F.max(VERSION)).first()[0]

    def delta(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/delta/{VERSION}={version}")

    def parts(self, version: int) -> tuple[DataFrame, DataFrame]:
        """The last base up to ``version``, and the rows since then with their version ``v``."""
        based_on = self._based_on(version)
        base = self.spark.read.schema(self.schema).parquet(f"{self.root}/base/{VERSION}={based_on}")
        numbered = T.StructType([*self.schema.fields, T.StructField(VERSION, T.LongType())])
        deltas = self.spark.read.schema(numbered).parquet(f"{self.root}/delta").where(
            (F.col(VERSION) > based_on) & (F.col(VERSION) <= version))
        return base, deltas

    def read(self, version: int) -> DataFrame:
        """All rows up to ``version``, for tables whose versions only add rows."""
        base, deltas = self.parts(version)
        return base.unionByName(deltas.drop(VERSION))
