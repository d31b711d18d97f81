"""Joins that stay balanced when one key holds a large share of the rows.

Both joins first count rows per key (pre-aggregated on the map side) and look at the
``n_tasks`` largest keys only: no more than that many can exceed a task's fair share
of the total.  That list is all the driver sees and all that is broadcast, whatever
the size of the data.  Without such keys the plan is the plain join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SALT = "_salt"

# Session settings for the size from which a key is split, and what holds without them.
ROWS_SETTING = "spark.twinweave.skew.rows"
LOAD_SETTING = "spark.twinweave.skew.load"
SPLIT_FROM = 1_000_000
# Pairs that one task of a many-to-many join should make.
TASK_PAIRS = 1_000_000


def _limit(spark: SparkSession, given: float | None, setting: str) -> float:
    return float(spark.conf.get(setting, str(SPLIT_FROM)) if given is None else given)


@contextmanager
def split_from(spark: SparkSession, rows: int, load: float) -> Iterator[None]:
    """Joins built in this block split keys from ``rows`` rows and ``load`` pairs on.

    Heavy keys are looked up when a join is built, so what is built here stays split
    when it runs later.
    """
    settings = {ROWS_SETTING: str(rows), LOAD_SETTING: str(load)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def default_tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _bucket(columns: list[str], n: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), n).cast("int")


def _steps(n: Column) -> Column:
    return F.sequence(F.lit(0), n.cast("int") - 1)


def _largest(rows: DataFrame, by: str, n: int) -> DataFrame | None:
    """The ``n`` largest rows as a local table, None when there are none."""
    found = rows.orderBy(F.desc(by)).limit(n).collect()
    return rows.sparkSession.createDataFrame(found, rows.schema) if found else None


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str],
                how: str = "inner", counts: DataFrame | None = None,
                n_tasks: int | None = None, min_rows: int | None = None) -> DataFrame:
    """Join a possibly skewed ``left`` with a ``right`` that has few rows per key.

    The largest keys of ``left``, from ``min_rows`` rows on (by default what the session
    sets as ``spark.twinweave.skew.rows``), are spread over several tasks by a hash of ``spread_by``, and their right rows are repeated once per task.
    ``counts (on..., n)`` may be passed when it is known already.  Same result as
    ``left.join(right, on, how)`` for the kinds that keep or drop left rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("lookup_join supports inner, left, left_semi and left_anti")
    n_tasks = n_tasks or default_tasks(left.sparkSession)
    min_rows = max(1.0, _limit(left.sparkSession, min_rows, ROWS_SETTING))
    if counts is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    hot = _largest(counts.where(F.col("n") >= min_rows), "n", n_tasks)
    if hot is None:
        return left.join(right, on, how)
    share = F.ceil(F.col("n") / F.lit(min_rows))
    hot = hot.select(*on, F.least(F.lit(n_tasks), share).cast("int").alias("_parts"))
    spread = left.join(F.broadcast(hot), on, "left").withColumn(
        _SALT, F.when(F.col("_parts").isNull(), 0).otherwise(_bucket(spread_by, F.col("_parts")))
    ).drop("_parts")
    copies = right.join(F.broadcast(hot), on, "left").withColumn(
        _SALT, F.explode(_steps(F.coalesce("_parts", F.lit(1))))
    ).drop("_parts")
    return spread.join(copies, [*on, _SALT], how).drop(_SALT)


def key_counts(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``(on..., nl, nr)`` for the keys present on both sides."""
    nl = left.groupBy(*on).agg(F.count(F.lit(1)).alias("nl"))
    nr = right.groupBy(*on).agg(F.count(F.lit(1)).alias("nr"))
    return nl.join(nr, on)


def _with_load(counts: DataFrame) -> DataFrame:
    return counts.withColumn("load", F.col("nl").cast("double") * F.col("nr"))


def load_parts(counts: DataFrame, n_workers: int) -> DataFrame:
    """Add ``load`` (pairs of the key) and ``n_part`` to ``(on..., nl, nr)``."""
    loads = _with_load(counts)
    total = loads.agg(F.sum("load")).scalar()
    parts = F.ceil(F.col("load") * n_workers / total)
    return loads.withColumn("n_part", F.greatest(F.lit(1), parts).cast("bigint"))


def load_report(left: DataFrame, right: DataFrame, on: list[str],
                n_workers: int | None = None) -> DataFrame:
    """Pairs every key will produce, and in how many parts a balanced join cuts it.

    Returns ``(on..., nl, nr, load, n_part)`` for the keys present on both sides.
    ``load`` is a double because ``nl * nr`` can exceed 64 bits.
    """
    return load_parts(key_counts(left, right, on), n_workers or default_tasks(left.sparkSession))


def balanced_join(left: DataFrame, right: DataFrame, on: list[str],
                  left_id: list[str], right_id: list[str],
                  n_workers: int | None = None, min_load: float | None = None,
                  counts: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """Many-to-many inner equi-join with the pairs of heavy keys spread evenly.

    A key with ``n_part`` parts becomes a grid of ``a x b`` cells: left rows are cut
    into ``a`` slices and right rows into ``b``, so neither side of a heavy key ever
    meets in one task and the copies sent are ``nl*b + nr*a`` rather than
    ``nl + nr*n_part``.  Keys are cut from ``min_load`` pairs on, by
    default the session's ``spark.twinweave.skew.load``.  ``counts (on..., nl, nr)`` may
    be passed when known already, and so may the ``total`` of pairs.

    Few rows can make many pairs, and adaptive execution goes by the bytes read.  So with
    heavy keys, or a ``total`` given, rows are dealt to as many tasks as the pairs ask for.
    """
    spark = left.sparkSession
    most = max(n_workers or 0, default_tasks(spark))
    n_workers = n_workers or default_tasks(spark)
    min_load = _limit(spark, min_load, LOAD_SETTING)
    counts = key_counts(left, right, on) if counts is None else counts
    loads = _with_load(counts)
    hot = _largest(loads.where(F.col("load") >= min_load), "load", n_workers)
    if hot is not None and total is None:
        total = loads.agg(F.sum("load")).first()[0]
    tasks = min(most, math.ceil((total or 0) / TASK_PAIRS))

    def dealt(df: DataFrame, by: list[str]) -> DataFrame:
        return df.repartition(tasks, *by) if tasks > 1 else df

    if hot is None:
        return dealt(left, on).join(dealt(right, on), on)
    parts = F.ceil(F.col("load") / F.lit(max(min_load, total / n_workers, 1.0)))
    even = F.round(F.sqrt(F.col("_n") * F.col("nl") / F.col("nr")))
    cells = (
        hot.withColumn("_n", F.greatest(F.lit(1), parts))
        .withColumn("_a", F.greatest(F.lit(1), F.least("_n", "nl", even)).cast("int"))
        .withColumn("_b", F.least("nr", F.ceil(F.col("_n") / F.col("_a"))).cast("int"))
        .select(*on, "_a", "_b")
    )
    a = F.coalesce("_a", F.lit(1))
    b = F.coalesce("_b", F.lit(1))
    lhs = (
        left.join(F.broadcast(cells), on, "left")
        .withColumn("_i", _bucket(left_id, a))
        .withColumn("_j", F.explode(_steps(b)))
        .drop("_a", "_b")
    )
    rhs = (
        right.join(F.broadcast(cells), on, "left")
        .withColumn("_j", _bucket(right_id, b))
        .withColumn("_i", F.explode(_steps(a)))
        .drop("_a", "_b")
    )
    cell = [*on, "_i", "_j"]
    return dealt(lhs, cell).join(dealt(rhs, cell), cell).drop("_i", "_j")
