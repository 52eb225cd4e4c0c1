"""Live GPU log ingest with Structured Streaming.

``ingest_gpu_log`` reads new text files of a log folder with the file stream
source and appends every line with its order key ``(epoch, file, split,
row)`` to a Parquet table, one folder per micro-batch (overwritten when a
batch is replayed, so a restart after a failure leaves no duplicate).
``snapshot`` numbers the lines in that order and runs the batch monitor
(steps, means, resampled series) on what has arrived so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import gpulog
from tessera.operators.ordering import dense_index


def ingest_gpu_log(spark: SparkSession, log_dir: str, table_path: str, checkpoint: str,
                   available_now: bool = False):
    """Start the ingest query; returns the ``StreamingQuery``."""
    lines = (spark.readStream.format("text").option("maxFilesPerTrigger", 64).load(log_dir)
             .select("value",
                     F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("split")))
    base = table_path.rstrip("/")

    def write_batch(df: DataFrame, epoch_id: int) -> None:
        # inside a micro-batch the rows of one split stay in file order
        df.withColumn("row", F.monotonically_increasing_id()) \
          .withColumn("epoch", F.lit(epoch_id).cast("long")) \
          .write.mode("overwrite").parquet(f"{base}/batch={epoch_id}")

    w = lines.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def snapshot(spark: SparkSession, table_path: str, max_history: int = gpulog.MAX_HISTORY,
             points: int = gpulog.RESAMPLE_POINTS):
    """Steps, per-device means and the resampled series of the lines so far."""
    raw = spark.read.parquet(table_path)
    log = dense_index(raw, order=["row"], bucket=["epoch", "file", "split"], out="line_no") \
        .select("line_no", "value")
    st, n = gpulog.steps(log, max_history)
    if n == 0:
        return st, None, None
    return st, gpulog.gpu_means(st), gpulog.resample(gpulog.flatten_series(st, n), points)
