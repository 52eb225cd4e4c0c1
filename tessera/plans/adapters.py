"""Adapters that shape the supplied tables into the operators' input schemas.

Each adapter is a plain projection, so Catalyst prunes the scan to the
columns used and pushes filters into Parquet.  The oracle SQL in
``tessera.plans.oracle`` writes the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import epoch_ms
from tessera.plans.tables import table

# Fixed values for the adapters (see FIXTURES.md section 3).
OVERWRITE_ID_MOD = 2000
OVERWRITE_CATEGORY_MOD = 3
PATH_EXTENSIONS = (".jpg", ".png", ".bmp", ".txt", ".json")
GPU_HEADER_LINE = "utilization.gpu [%], memory.used [MiB]"


def records(spark: SparkSession, sf_dir: str, overwrite: bool = False) -> DataFrame:
    """events as BSON-like records ``(_id, category_id, imgs, pos)``."""
    ev = table(spark, sf_dir, "events")
    _id = F.col("event_id") % OVERWRITE_ID_MOD if overwrite else F.col("event_id")
    cat = F.col("user_id") % OVERWRITE_CATEGORY_MOD if overwrite else F.col("user_id")
    return ev.select(
        _id.alias("_id"),
        cat.alias("category_id"),
        F.array(F.struct(F.col("props").cast("binary").alias("picture"))).alias("imgs"),
        F.col("event_id").alias("pos"),
    )


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as file paths ``(id, path)``."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"))


def embedding_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as image file paths ``/data/<label>/<vec_id><ext>``."""
    exts = F.array(*[F.lit(e) for e in PATH_EXTENSIONS])
    ext = F.get(exts, (F.col("vec_id") % len(PATH_EXTENSIONS)).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("/data/"), F.col("label").cast("string"), F.lit("/"),
                 F.col("vec_id").cast("string"), ext).alias("path"))


def embedding_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8x8x1 images ``(id, label, pixels array<float>)``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").alias("pixels"))


def grey_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 4x4x4 images of whole grey values 0..255: ``floor((value + 1) * 127)``."""
    px = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127), F.lit(0)), F.lit(255)).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), px.alias("pixels"))


def class_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as class pictures ``(label = source, name = doc_id)``."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("label"), F.col("doc_id").cast("string").alias("name"))


def _whole(value: str = "value"):
    """A whole number from ``events.value``."""
    return F.floor(F.abs(value) * 100).cast("bigint")


def gpu_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an nvidia-smi style log ``(line_no, value)``, values from ``events.value``.

    A header line (``line_no = 2 * event_id``) precedes the events with a whole
    value divisible by 3, so blocks of all sizes occur; the data line is
    ``line_no = 2 * event_id + 1``.
    """
    ev = table(spark, sf_dir, "events").select("event_id", _whole().alias("v"))
    data = ev.select(
        (F.col("event_id") * 2 + 1).alias("line_no"),
        F.concat((F.col("v") % 101).cast("string"), F.lit(" %, "),
                 (F.col("v") * 13 % 4038).cast("string"), F.lit(" MiB")).alias("value"))
    headers = ev.filter(F.col("v") % 3 == 0).select(
        (F.col("event_id") * 2).alias("line_no"), F.lit(GPU_HEADER_LINE).alias("value"))
    return data.unionByName(headers)


def iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as training iterations ``(event_id, iteration)``, 0 to 399, from ``events.value``."""
    return table(spark, sf_dir, "events").select("event_id", (_whole() % 400).alias("iteration"))


def user_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log per user ``(log, line_no, value)``, values from ``events.value``.

    A header line precedes the events whose number is a multiple of 2 + user % 3,
    so blocks and device counts differ.  Users with user % 40 = 7 write a
    malformed line wherever the event's number is a multiple of 31.
    """
    ev = table(spark, sf_dir, "events")
    whole = _whole()
    line = F.concat((whole % 101).cast("string"), F.lit(" %, "), (whole % 4038).cast("string"), F.lit(" MiB"))
    broken = (F.col("user_id") % 40 == 7) & (F.col("event_id") % 31 == 0)
    data = ev.select(F.col("user_id").alias("log"), (F.col("event_id") * 2 + 1).alias("line_no"),
                     F.when(broken, F.lit("lost, [N/A]")).otherwise(line).alias("value"))
    headers = ev.filter(F.col("event_id") % (F.col("user_id") % 3 + 2) == 0).select(
        F.col("user_id").alias("log"), (F.col("event_id") * 2).alias("line_no"), F.lit(GPU_HEADER_LINE).alias("value"))
    return data.unionByName(headers)


#: Groups that events and orders share, the first event day, and microseconds of it for one day of orders.
PRICE_GROUPS, PRICE_START, PRICE_DAY = 25, "2024-01-01", 1_080_000_000


def priced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ``(event_id, grp, at)``, at in microseconds of the epoch."""
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % PRICE_GROUPS).alias("grp"), at.alias("at"))


def price_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as price steps ``(order_id, grp, at, price)``: their days, drawn together into the month of the events."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint")
    start = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.lit(PRICE_START).cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % PRICE_GROUPS).alias("grp"),
                                                 (start + days * PRICE_DAY).alias("at"), F.col("o_totalprice").alias("price"))


def predictions_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as predictions: actual = quality, predicted = toxic."""
    return table(spark, sf_dir, "labels").select(
        F.col("quality").alias("actual"), F.col("toxic").alias("predicted"))


def predictions_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as predictions: actual = label, predicted = vec_id % 10."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("actual"), (F.col("vec_id") % 10).cast("int").alias("predicted"))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as timing samples ``(day, ms)`` (ms from ts, whole milliseconds)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.to_date("ts").alias("day"), epoch_ms("ts").alias("ms"))
