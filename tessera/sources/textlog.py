"""The GPU log as ordered text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordering import dense_index


def read_gpu_log(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)`` with ``line_no`` the 0-based line number in
    file order over all files below ``path`` (files in name order).

    Spark packs file splits into partitions by size, so partition numbers do
    not follow the file; the order key is (file, split start, row id inside
    the split).  Line numbers are a running count bucketed by split, so no
    task sees more than one split's lines at once.
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("__f"),
        F.col("_metadata.file_block_start").alias("__b"),
        F.monotonically_increasing_id().alias("__m"))
    out = dense_index(raw, order=["__m"], bucket=["__f", "__b"], out="line_no")
    return out.select("line_no", "value")


def write_lines(df: DataFrame, path: str, order: str = "line_no", parts: int | None = None) -> str:
    """Write ``value`` lines in ``order`` as text files named in order
    (range partitioning keeps file k before file k+1)."""
    n = parts or max(1, df.rdd.getNumPartitions())
    (df.repartitionByRange(n, order).sortWithinPartitions(order)
       .select("value").write.mode("overwrite").text(path))
    return path
