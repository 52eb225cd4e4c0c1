"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links`` (columns a, b): the smallest id reachable.

    Every round hangs each node's larger neighbours on its smallest one (large
    star), then its smaller neighbours and itself (small star); rounds end when
    the links no longer change.  Neighbours are never gathered: a minimum is
    combined on the map side and joined back, so a hub costs rows, not memory.
    """
    e = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    leaves = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    roots = leaves.select(F.col("component").alias("id"), "component").distinct()
    return materialise(leaves.unionByName(roots), "components")
