"""Saving and re-reading prepared sample sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SAMPLE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("split", T.StringType()),
    T.StructField("split_pos", T.LongType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("features", T.ArrayType(T.FloatType())),
    T.StructField("onehot", T.ArrayType(T.DoubleType())),
])


def write_dataset(df: DataFrame, path: str, parts: int | None = None, mode: str = "overwrite") -> str:
    """Write samples as Parquet, one folder per split.

    ``parts`` forces a file count (the reference used 14); by default every
    task writes its own file, which scales with the cluster.
    """
    out = df.repartition(parts) if parts else df
    out.write.mode(mode).partitionBy("split").parquet(path)
    return path


def read_dataset(spark: SparkSession, path: str, split: str | None = None,
                 schema: T.StructType = SAMPLE_SCHEMA) -> DataFrame:
    """Re-read with a declared schema; ``split`` prunes to one folder."""
    df = spark.read.schema(schema).parquet(path)
    if split is not None:
        df = df.filter(df["split"] == split)
    return df
