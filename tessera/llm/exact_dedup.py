"""Exact dedup by a heavy-hitter split.

One pass over the texts leaves a small table of digests.  A Misra-Gries type
summary (Spark's ``approx_top_k``, a mergeable frequent-items sketch) names the
digests that may be frequent; an exact, map-side combined count verifies them.
The verified winners, at most ``heavy`` rows, are broadcast and settle their
rows on the map side, so that no group of copies larger than a small share of
the table is ever shuffled into one task.  All other digests go through an
ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialise

#: Any white space run that is more than one plain space.
_RUN = r"(?:[\x09-\x0D]|\x20[\x20\x09-\x0D])[\x20\x09-\x0D]*"

#: Counters of the summary and most winners taken from it.
COUNTERS, HEAVY = 8192, 1024


def text_digest(text: Column | str) -> Column:
    """SHA-256 (hex) of the text with each white space run as one space; null is empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ").cast("binary"), 256)


def heavy_digests(digests: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """Verified frequent digests: ``(digest, first, size)``, at most ``heavy`` rows.

    ``digests`` has ``digest`` and the sort key ``key`` (a struct).  Candidates
    come from the summary; each one's count and smallest key are exact.
    """
    found = (digests.agg(F.expr(f"approx_top_k(digest, {heavy}, {counters})").alias("top"))
             .select(F.explode("top.item").alias("digest")))
    return (digests.join(F.broadcast(found), "digest", "left_semi").groupBy("digest")
            .agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("size"))
            .where("size > 1"))


def _key(id_col: str, tie: Column) -> Column:
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), tie.alias("tie"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              heavy: int = HEAVY, digest: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest id stays.  Null texts equal empty ones.  A null
    id sorts after all others; of repeated rows with one id, exactly one stays.
    An empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    digest = text_digest(text_col) if digest is None else digest
    rows = materialise(docs.select(F.col(id_col).alias("id"), digest.alias("digest"))
                       .withColumn("key", _key("id", F.monotonically_increasing_id())), "exact")
    winners = materialise(heavy_digests(rows, heavy), "exact")
    large = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    small = (rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
             .withColumn("first", F.min("key").over(same)).withColumn("size", F.count(F.lit(1)).over(same)))
    both = large.select("key", "digest", "first", "size").unionByName(small.select("key", "digest", "first", "size"))
    return both.select(F.col("key.id").alias(id_col), F.col("first.id").alias("keep_id"),
                       F.col("size").alias("group_size"), (F.col("key.tie") == F.col("first.tie")).alias("kept"),
                       F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """``docs`` with one row of each text: the smallest id, as in ``decisions``.

    Rows of frequent texts are dropped before any shuffle; the rest meet by
    digest.  Of repeated rows with one id, the smallest row hash stays.
    """
    digest, key, first = (fresh(docs, x) for x in ("__digest", "__key", "__first"))
    # named so that no column of docs clashes with them
    tagged = docs.withColumn(digest, text_digest(text_col))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    ids = materialise(tagged.select(F.col(id_col).alias("id"), F.col(digest).alias("digest"),
                                    tie.alias("tie")).withColumn("key", _key("id", F.col("tie"))), "exact")
    winners = materialise(heavy_digests(ids.select("digest", "key"), heavy), "exact")
    tagged = tagged.withColumn(key, _key(id_col, tie))
    win = F.broadcast(winners.select(F.col("digest").alias(digest), F.col("first").alias(first)))
    rest = tagged.join(win, digest, "left").where(F.col(first).isNull() | (F.col(first) == F.col(key)))
    order = Window.partitionBy(digest).orderBy(key)
    rank = fresh(docs, "__rank")
    return (rest.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
