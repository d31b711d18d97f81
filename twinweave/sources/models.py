"""Model tables: one row per model, kept as parquet or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.config import FtrlParams
from twinweave.schema import MODEL


def new_model(spark: SparkSession, dim: int, params: FtrlParams = FtrlParams(),
              model: str = "default") -> DataFrame:
    """An untrained model: zero state of length ``dim``."""
    if dim < 1:
        raise ValueError("a model needs at least one feature")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return spark.range(1).select(
        F.lit(model).alias("model"),
        F.lit(dim).cast("int").alias("dim"),
        zeros.alias("z"), zeros.alias("n"), zeros.alias("w"),
        F.lit(float(params.l1)).alias("l1"), F.lit(float(params.l2)).alias("l2"),
        F.lit(float(params.alpha)).alias("alpha"), F.lit(float(params.beta)).alias("beta"),
        F.lit(params.max_iter).cast("int").alias("max_iter"),
        F.lit(float(params.eta)).alias("eta"),
        F.lit(params.epochs).cast("int").alias("epochs"),
        F.lit(False).alias("trained"),
        F.lit(0).cast("bigint").alias("version"),
    )


def model_params(model: DataFrame) -> FtrlParams:
    """The hyper-parameters stored with a model.  ``model`` is one row."""
    names = ["l1", "l2", "alpha", "beta", "max_iter", "eta", "epochs"]
    rows = model.select(*names).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("settings are read from a table of one model")
    return FtrlParams(**{k: v for k, v in rows[0].asDict().items() if v is not None})


def save_model(model: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a model table.  Never the path the same plan reads from."""
    model.select(MODEL.fieldNames()).write.mode("overwrite").format(fmt).save(path)


def load_model(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(MODEL).format(fmt).load(path)
