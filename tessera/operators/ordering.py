"""Order-dependent building blocks that stay distributed.

A window without a partition key runs in one task, and a window over a hot key
runs in one task too.  The helpers here cut such work into bounded buckets:

* ``running_total``: inclusive prefix sum in a global order.  Per-bucket totals
  (a small aggregate) get exclusive offsets, then each bucket sums locally.
* ``sorted_index``: position of every row of a table of distinct keys.  Keys are
  range-partitioned and sorted where they are; a range starts at the count of
  the ranges before it.
* ``carry_forward``: the last value at or before each row (a prefix *last*).
  Rows are range-partitioned; a range takes over the last value of the ranges
  before it, one small row each.
* ``rank_in_groups``: ``row_number`` inside groups ordered by an md5 hash.  A
  hot group is split into ``2**bits`` hash sub-buckets with counted offsets.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_bucket
from tessera.session import shared_path

def _cols(cs) -> list[str]:
    return [cs] if isinstance(cs, str) else list(cs)


def running_total(df: DataFrame, value: Column | str, out: str,
                  bucket: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``value`` in (bucket, order) order.

    ``bucket`` columns must be monotone in the order and bound the rows per
    bucket (for example ``pos div 2**20``, or a file split).  Only the bucket
    totals meet in one task; rows are summed inside their own bucket.
    """
    return running_totals(df, {out: value}, bucket, order)


def running_totals(df: DataFrame, sums: dict, bucket: Sequence[str],
                   order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Several inclusive running sums at once: ``sums`` maps output name to a
    value column; one bucket aggregate and one join serve them all.  With
    ``group`` every group has sums of its own; a large one still is many buckets."""
    group, within = _cols(group), _cols(bucket)
    bucket = group + within
    order = _cols(order)
    d = df
    tmps = {}
    for out, value in sums.items():
        tmps[out] = f"__{out}_v"
        d = d.withColumn(tmps[out], F.col(value) if isinstance(value, str) else value)
    totals = d.groupBy(*bucket).agg(*[F.sum(t).alias(f"{t}_b") for t in tmps.values()])
    w_all = (Window.partitionBy(*group) if group else Window).orderBy(*within).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*bucket, *[
        F.coalesce(F.sum(f"{t}_b").over(w_all), F.lit(0)).alias(f"{t}_o") for t in tmps.values()])
    w_in = Window.partitionBy(*bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = d.join(offsets, bucket, "left")
    for out, t in tmps.items():
        r = r.withColumn(out, (F.col(f"{t}_o") + F.sum(t).over(w_in)).cast("bigint"))
    return r.drop(*tmps.values(), *[f"{t}_o" for t in tmps.values()])


def bits_for(max_group_rows: int, rows_per_bucket: int = 1 << 20) -> int:
    """Hash bits (a multiple of 4, 4..20) so that the largest group's
    sub-buckets hold about ``rows_per_bucket`` rows."""
    need = max(1, -(-int(max_group_rows) // rows_per_bucket))
    bits = max(4, (need - 1).bit_length())
    return min(20, -(-bits // 4) * 4)


def rank_in_groups(df: DataFrame, group: Sequence[str], md5_col: str, tiebreak: Sequence[str],
                   out: str = "rn", size_col: str | None = None, bits: int = 12,
                   return_sizes: bool = False, limit: int | None = None):
    """``row_number() over (partition by group order by md5_col, tiebreak)``, 1-based.

    The top ``bits`` of the md5 split every group into even sub-buckets, so a
    group holding a third of all rows is ranked by many tasks.  When
    ``size_col`` is given the group size is added as well.  With ``limit``,
    sub-buckets that begin past that rank are dropped before the ranking
    shuffle: one cut-off per group, joined on the map side where it is small.
    """
    group = _cols(group)
    tiebreak = _cols(tiebreak)
    d = df.withColumn("__hb", hash_bucket(F.col(md5_col), bits))
    counts = d.groupBy(*group, "__hb").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*group).orderBy("__hb")
    offs = counts.select(
        *group, "__hb",
        F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        *( [F.sum("__n").over(Window.partitionBy(*group)).alias(size_col)] if size_col else [] ),
    )
    if limit is not None:
        cut = offs.filter(F.col("__off") < limit).groupBy(*group).agg(F.max("__hb").alias("__cut"))
        d = d.join(cut, group).filter(F.col("__hb") <= F.col("__cut")).drop("__cut")
    w_in = Window.partitionBy(*group, "__hb").orderBy(md5_col, *tiebreak)
    ranked = (d.join(offs, [*group, "__hb"], "left")
              .withColumn(out, (F.col("__off") + F.row_number().over(w_in)).cast("bigint"))
              .drop("__hb", "__off"))
    if return_sizes:
        # group sizes from the same bucket counts (one row per group)
        sizes = counts.groupBy(*group).agg(F.sum("__n").cast("bigint").alias("group_n"))
        return ranked, sizes
    return ranked


def dense_index(df: DataFrame, order: Sequence[str], bucket: Sequence[str],
                out: str = "idx") -> DataFrame:
    """0-based dense position of every row in ``order`` (a distributed
    zipWithIndex): a running count bucketed by ``bucket``."""
    order = _cols(order)
    bucket = _cols(bucket)
    r = running_total(df, F.lit(1), out, bucket, order)
    return r.withColumn(out, F.col(out) - 1)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once below the shared folder and read back: cuts the lineage, and keeps
    ranges as they are (their bounds are sampled anew whenever they are computed)."""
    path = shared_path(df.sparkSession, "ordering")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_index(keys: DataFrame, order: Sequence[Column | str], out: str = "idx") -> DataFrame:
    """Add ``out`` = 0-based position of every row in ``order``, without a window.

    ``keys`` should hold distinct keys; rows that tie get neighbouring numbers
    in no fixed order.  Only one count a range meets on the driver.
    """
    taken = "__id"
    back = written(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(taken, F.monotonically_increasing_id()))
    # monotonically_increasing_id is (partition << 33) + row of the partition
    part, row = F.shiftright(taken, 33), F.col(taken).bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r[0]: r[1] for r in back.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [0]
    for p in range(max(counts, default=-1)):
        starts.append(starts[-1] + counts.get(p, 0))
    start = F.element_at(F.lit(np.array(starts, np.int64)), (part + 1).cast("int"))
    return back.withColumn(out, start + row).drop(taken)


def carry_forward(df: DataFrame, value: str, out: str, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Add ``out`` = the last non-null ``value`` at or before each row in ``order``, inside its ``group``.

    ``order`` should leave few ties, as rows that tie meet in one range.  A
    group or the whole table may be many ranges: each sorts its own rows, and
    one row a range (its last value and that value's group) is handed on.
    """
    spark = df.sparkSession
    order, group = _cols(order), _cols(group)
    back = written(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lasts = (back.filter(F.col(value).isNotNull()).groupBy("__part")
             .agg(F.max_by(F.struct(*group, F.col(value).alias("__value")), F.struct(*group, *order)).alias("__last")))
    # at most one number a range reaches the driver: which ranges have a value
    filled = set(r[0] for r in lasts.select("__part").collect())
    ranges = max((r[0] for r in back.agg(F.max("__part")).collect() if r[0] is not None), default=-1) + 1
    before, source = [], None
    for p in range(ranges):
        if source is not None:
            before.append((p, source))
        if p in filled:
            source = p
    handed = spark.createDataFrame(before, "__to int, __part int").join(lasts, "__part").select(F.col("__to").alias("__part"), "__last")
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__last.{g}"))
    own = F.last(value, ignorenulls=True).over(inside)
    return (back.withColumn("__own", own).join(handed, "__part", "left")
            .withColumn(out, F.coalesce(F.col("__own"), F.when(same, F.col("__last.__value")))).drop("__part", "__own", "__last"))
