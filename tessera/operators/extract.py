"""Extract: records -> pictures per category, counts and reports.

A record frame has ``_id``, ``category_id``, ``imgs`` (list of ``{picture}``)
and ``pos``, the 0-based record number in file order (dense, as the sources
produce it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import first_picture, parse_int_strict, picture_name
from tessera.operators.ordering import dense_index, running_total

PROGRESS_EVERY = 10_000


def parse_records(records: DataFrame) -> DataFrame:
    """``(_id int, category_id int, name, picture, pos)``."""
    return records.select(
        parse_int_strict("_id", "_id").alias("_id"),
        parse_int_strict("category_id", "category_id").alias("category_id"),
        picture_name("_id").alias("name"),
        first_picture("imgs").alias("picture"),
        F.col("pos"),
    )


def totals(pictures: DataFrame) -> DataFrame:
    """A1: number of pictures (records) and number of categories."""
    return pictures.agg(
        F.count(F.lit(1)).alias("n_pictures"),
        F.countDistinct("category_id").alias("n_categories"),
    )


def category_counts(pictures: DataFrame) -> DataFrame:
    """A2: pictures per category (every record counts, also overwritten ones)."""
    return pictures.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))


def category_ids(pictures: DataFrame) -> DataFrame:
    """A3: ids per category in file order, duplicates kept.

    One row per id, ``(category_id, pos, _id)``: ``pos`` orders a category's
    list, which no row or task has to hold as a whole.
    """
    return pictures.select("category_id", F.col("pos").cast("bigint").alias("pos"), "_id")


def progress(pictures: DataFrame, every: int = PROGRESS_EVERY, dense_pos: bool = True,
             pos_bucket: int = 1 << 20) -> DataFrame:
    """Before every ``every``-th record, pictures so far and categories so far.

    Rows ``(record_index, n_pictures, n_categories)``, values excluding the
    record itself.  A category counts from the first checkpoint after its
    first record; per-checkpoint increments come from a grouped minimum, so
    no window runs over the records.  ``pos`` must be the dense record
    number the sources give; with ``dense_pos=False`` it is first renumbered
    by a bucketed running count (buckets of ``pos_bucket`` positions).
    """
    if not dense_pos:
        pictures = dense_index(pictures.withColumn("__pb", F.floor(F.col("pos") / F.lit(pos_bucket))),
                               order=["pos"], bucket=["__pb"], out="__idx") \
            .drop("pos", "__pb").withColumnRenamed("__idx", "pos")
    first = pictures.groupBy("category_id").agg(F.min("pos").alias("first_pos"))
    new_at = (first.groupBy((F.floor(F.col("first_pos") / every) + 1).cast("bigint").alias("k"))
                   .agg(F.count(F.lit(1)).alias("new_cats")))
    checkpoints = (pictures.filter(F.col("pos") % every == 0)
                   .select(F.col("pos").alias("record_index"),
                           F.floor(F.col("pos") / every).cast("bigint").alias("k")))
    marks = (checkpoints.select("k").unionByName(new_at.select("k"))
             .distinct()
             .join(new_at, "k", "left")
             .fillna(0, ["new_cats"]))
    cum = _cumulative(marks)
    return (checkpoints.join(cum, "k", "left")
            .select("record_index", F.col("record_index").alias("n_pictures"),
                    F.coalesce(F.col("n_categories"), F.lit(0)).cast("bigint").alias("n_categories")))


def _cumulative(marks: DataFrame) -> DataFrame:
    m = marks.withColumn("kb", F.floor(F.col("k") / (1 << 16)))
    return running_total(m, "new_cats", "n_categories", bucket=["kb"], order=["k"]).drop("kb", "new_cats")


def last_per_id(pictures: DataFrame) -> DataFrame:
    """S7 (dedup part): a repeated ``(category_id, _id)`` overwrites the same
    file, so the last record in file order wins.  A grouped ``max_by`` gets
    map-side partial aggregation, so a key with many copies stays cheap."""
    last = F.max_by(F.struct("name", "picture", "pos"), "pos")
    return (pictures.groupBy("category_id", "_id").agg(last.alias("l"))
            .select("category_id", "_id", "l.name", "l.picture", "l.pos"))


def report_lines(pictures: DataFrame) -> DataFrame:
    """The three text reports as ``(report, category_id, seq, line)`` rows.

    ``count``: ``number of pictures: N, number of category: M``;
    ``cates``: ``k,v``; ``ids``: ``k,id``, one line per id.  Lines of a report
    are in order of ``(category_id, seq)``.
    """
    none, zero = F.lit(None).cast("int").alias("category_id"), F.lit(0).cast("bigint").alias("seq")
    t = totals(pictures).select(
        F.lit("count").alias("report"), none, zero,
        F.concat(F.lit("number of pictures: "), F.col("n_pictures").cast("string"),
                 F.lit(", number of category: "), F.col("n_categories").cast("string")).alias("line"))
    c = category_counts(pictures).select(
        F.lit("cates").alias("report"), "category_id", zero,
        F.concat_ws(",", F.col("category_id").cast("string"), F.col("n").cast("string")).alias("line"))
    i = category_ids(pictures).select(
        F.lit("ids").alias("report"), "category_id", F.col("pos").alias("seq"),
        F.concat_ws(",", F.col("category_id").cast("string"), F.col("_id").cast("string")).alias("line"))
    return t.unionByName(c).unionByName(i)
