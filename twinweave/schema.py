"""Column names and explicit schemas shared by every operator.

A *predicate* is a ``(sub, obj)`` DataFrame, a *side* is the value of ``db``, a
*pair* is ``(source, target)``.  Block keys travel as ``path array<string>`` (one
element per level) so that values holding the separator can never collide; the
rendered string form is only made for output.
"""

from __future__ import annotations

from pyspark.sql import types as T

SOURCE = "source"
TARGET = "target"
PAIR = [SOURCE, TARGET]

# Spelling of rendered block keys and of a missing level.
LEVEL_SEPARATOR = "$"
WORD_SEPARATOR = "@"
MISSING_LEVEL = "NULL"

PREDICATE = T.StructType(
    [T.StructField("sub", T.StringType()), T.StructField("obj", T.StringType())]
)

PAIRS = T.StructType(
    [T.StructField(SOURCE, T.StringType()), T.StructField(TARGET, T.StringType())]
)

SCORES = T.StructType(
    PAIRS.fields
    + [
        T.StructField("sim_v", T.ArrayType(T.DoubleType())),
        T.StructField("score", T.DoubleType()),
    ]
)

LABELS = T.StructType(
    PAIRS.fields
    + [
        T.StructField("sim_v", T.ArrayType(T.DoubleType())),
        T.StructField("is_match", T.DoubleType()),
    ]
)

MODEL = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("z", T.ArrayType(T.DoubleType())),
        T.StructField("n", T.ArrayType(T.DoubleType())),
        T.StructField("w", T.ArrayType(T.DoubleType())),
        T.StructField("l1", T.DoubleType()),
        T.StructField("l2", T.DoubleType()),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("beta", T.DoubleType()),
        T.StructField("max_iter", T.IntegerType()),
        T.StructField("eta", T.DoubleType()),
        T.StructField("epochs", T.IntegerType()),
        T.StructField("trained", T.BooleanType()),
        T.StructField("version", T.LongType()),
    ]
)
