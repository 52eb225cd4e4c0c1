"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, shared_path, ship_package

#: ASCII white space; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches hold at most so many rows, so that a batch of long texts fits a worker.
ARROW_ROWS = 128


def prepare(spark: SparkSession) -> None:
    """Make the package and the shared folder available to the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage, fixes row numbers given by position, and gives the
    planner true sizes for its choice of join.
    """
    spark = df.sparkSession
    path = shared_path(spark, "llm", name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(c: Column) -> Column:
    """``c`` with A-Z in lower case and every other character unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gapless(df: DataFrame, group: str, key: list[str], out: str, rows: int = 200_000) -> DataFrame:
    """Add ``out`` = 0, 1, 2, ... inside each ``group``, without a task per group.

    Rows are dealt to buckets by a hash of ``key`` (about ``rows`` a bucket);
    a bucket's first number is the count of the group's earlier buckets.
    """
    buckets = max(1, -(-df.count() // rows))
    d = df.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    sizes = d.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("__g"), F.col("__bucket").alias("__b"),
                          F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, "__bucket").orderBy(*key)
    return (d.withColumn("__in", F.row_number().over(inside) - 1)
            .join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__bucket") == F.col("__b")), "left")
            .withColumn(out, (F.col("__start") + F.col("__in")).cast("bigint"))
            .drop("__bucket", "__in", "__g", "__b", "__start"))
