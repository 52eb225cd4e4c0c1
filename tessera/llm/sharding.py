"""Sharding by a k-d tree over document metadata, split at weighted medians.

Documents with equal texts form a group and stay together.  A group is a point
of metadata coordinates with its bytes as weight.  Level by level, every leaf
is split along its widest dimension at the weighted median (or the quantile its
halves of the shards ask for), until a leaf is one shard of the target size.
The median of all leaves of a level is found at once by histograms of SLICES
slices, refined until the slice in question is one group or next to nothing;
a hash breaks ties, so a value that a third of all documents share is split too.

Groups above a share of a shard (by bytes or by rows) cannot be balanced by a
median: there are at most 2 * SHARE of them for each shard, and they go first,
each to the emptiest shard; the tree then fills every shard up.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import gapless, materialise

#: A group of 1/SHARE of a shard is placed before the tree; slices of one histogram; weight a median may be off by.
SHARE, SLICES, SLACK = 50, 512, 0.0005


def _number(c: Column, kind: str) -> Column:
    """A value as a double in its order: strings by their first seven bytes; null as 0."""
    if kind == "string":
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0")
        c = F.conv(head, 16, 10).cast("double")
    return F.coalesce(c.cast("double"), F.lit(0.0))


def documents(docs: DataFrame, dims: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, size, text_crc32, key (of the text) and the coordinates d0, d1, ..."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = dict(docs.dtypes)
    if dims is None:
        dims = {c: _number(F.col(c), kinds[c]) for c in ("source", "lang") if c in kinds}
        dims |= {"bytes": F.log2(F.octet_length(text) + 1).cast("double"), "id": _number(F.col(id_col), kinds[id_col])}
    return docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.md5(text.cast("binary")).alias("key"), *[c.alias(f"d{i}") for i, c in enumerate(dims.values())])


def _fill(loads: list[int], total: float) -> list[float]:
    """What each shard still takes when ``total`` levels them: max(0, level - load)."""
    level, order = 0.0, sorted(loads)
    for i in range(1, len(order) + 1):
        level = (total + sum(order[:i])) / i
        if i == len(order) or level <= order[i]:
            break
    return [max(0.0, level - x) for x in loads]


def _split(points: DataFrame, nodes: DataFrame, dims: int) -> DataFrame:
    """``(first, at, dim)`` of every node: points whose coordinate is below ``at`` go left.

    ``nodes`` has first (the node's smallest shard) and share (of its weight
    that the left half takes).
    """
    ends = [f(F.shiftright(F.col(f"c{i}"), 32)).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    box = points.groupBy("first").agg(F.sum("weight").alias("all"), *ends).join(F.broadcast(nodes), "first")
    width = [F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(dims)]
    widest = F.greatest(*width) if dims > 1 else width[0]
    dim, lo, hi = F.lit(0), F.col("lo0"), F.col("hi0")
    for i in reversed(range(dims)):
        dim, lo, hi = (F.when(width[i] == widest, x).otherwise(y) for x, y in ((F.lit(i), dim), (F.col(f"lo{i}"), lo), (F.col(f"hi{i}"), hi)))
    state = box.select("first", "all", (F.col("all") * F.col("share")).alias("target"), dim.alias("dim"), F.shiftleft(lo, 32).alias("lo"),
                       (F.shiftleft(hi + 1, 32) - 1).alias("hi"), F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("bigint").alias("at"))
    state = materialise(state, "median")
    at = F.col("c0")
    for i in range(1, dims):
        at = F.when(F.col("dim") == i, F.col(f"c{i}")).otherwise(at)
    while True:
        left = state.where("at is null")
        if left.isEmpty():
            return state.select("first", "at", "dim")
        step = F.greatest(F.lit(1), F.expr(f"(hi - lo) div {SLICES} + 1"))
        slices = (points.join(F.broadcast(left), "first").withColumn("v", at).where("v >= lo and v <= hi")
                  .withColumn("step", step).withColumn("slice", F.expr("(v - lo) div step"))
                  .groupBy("first", "slice").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("all", "target", "dim", "lo", "before", "step")]))
        upto = Window.partitionBy("first").orderBy("slice")  # at most SLICES + 1 rows
        slices = slices.withColumn("sum", F.col("before") + F.sum("w").over(upto))
        cross = (slices.withColumn("last", F.max("slice").over(Window.partitionBy("first")))
                 .where((F.col("sum") >= F.col("target")) | (F.col("slice") == F.col("last")))
                 .withColumn("rank", F.row_number().over(upto)).where("rank = 1"))
        begin = F.col("lo") + F.col("slice") * F.col("step")
        done = (F.col("n") == 1) | (F.col("step") == 1) | (F.col("w") <= F.col("all") * SLACK)
        near = F.when(F.col("target") - (F.col("sum") - F.col("w")) >= F.col("sum") - F.col("target"), begin + F.col("step")).otherwise(begin)
        new = cross.select("first", "all", "target", "dim", begin.alias("lo"), (begin + F.col("step") - 1).alias("hi"),
                           (F.col("sum") - F.col("w")).cast("bigint").alias("before"), F.when(done, near).alias("at"))
        state = materialise(state.where("at is not null").unionByName(new), "median")


def assign(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None, dims: dict[str, Column] | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, size, text_crc32, key, shard.

    Sizes are UTF-8 bytes plus 1; a null text counts as empty.  Without
    ``shards`` there are as many as ``target_bytes`` asks for.  Sizes of shards
    are near equal; equal texts share a shard, also where one text is more than
    a shard.  Null metadata sorts first.  Repeated rows are kept.  An empty
    table gives no rows; with few texts some shards stay empty.
    """
    rows = documents(docs, dims, id_col, text_col)
    names = [c for c in rows.columns if c[0] == "d" and c[1:].isdigit()]
    rows = materialise(rows, "documents")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    shards = shards or max(1, -(-total // target_bytes))
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"),
                                                 *[F.min(c).alias(c) for c in names]), "groups")
    big = (F.col("weight") * shards * SHARE > total) | (F.col("n") * shards * SHARE > count)
    loads, heap, placed = [0] * shards, [(0, s) for s in range(shards)], []
    for g in sorted(groups.where(big).select("key", "weight").collect(), key=lambda g: (-g.weight, g.key)):  # at most 2 * SHARE * shards
        load, s = heapq.heappop(heap)
        loads[s] = load + g.weight
        placed.append((g.key, s))
        heapq.heappush(heap, (loads[s], s))
    light = groups.where(~big)
    ends = light.agg(F.sum("weight"), *[f(c) for c in names for f in (F.min, F.max)]).first()
    takes = _fill(loads, float(ends[0] or 0))
    tie = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    coords = []
    for i, c in enumerate(names):
        lo, hi = ends[1 + 2 * i] or 0.0, ends[2 + 2 * i] or 0.0
        unit = (F.col(c) - lo) / (hi - lo) if hi > lo else F.lit(0.0)
        coords.append((F.shiftleft(F.floor(unit * (2**30 - 1)).cast("bigint"), 32) + tie).alias(f"c{i}"))
    points = light.select("key", "weight", F.lit(0).alias("first"), *coords)
    nodes = [(0, shards)] if shards > 1 else []
    spark = docs.sparkSession
    while nodes and ends[0]:
        shares = [(a, b, float(sum(takes[a:a + b // 2])), float(sum(takes[a:a + b]))) for a, b in nodes]
        table = spark.createDataFrame([(a, b // 2, x / y if y else 0.5) for a, b, x, y in shares], "first int, half int, share double")
        points = materialise(points, "points")
        cuts = _split(points.join(F.broadcast(table.select("first")), "first", "left_semi"), table, len(names)).join(table.select("first", "half"), "first")
        value = F.col("c0")
        for i in range(1, len(names)):
            value = F.when(F.col("dim") == i, F.col(f"c{i}")).otherwise(value)
        points = (points.join(F.broadcast(cuts), "first", "left")
                  .withColumn("first", F.when(value >= F.col("at"), F.col("first") + F.col("half")).otherwise(F.col("first"))).drop("at", "dim", "half"))
        nodes = [x for a, b in nodes for x in ((a, b // 2), (a + b // 2, b - b // 2)) if x[1] > 1]
    where = materialise(points.select("key", F.col("first").alias("shard")), "shards")
    first = spark.createDataFrame(placed, "key string, shard int")
    one = rows.select(id_col, "size", "text_crc32", "key")
    heavy = one.join(F.broadcast(first), "key")
    rest = one.join(F.broadcast(first), "key", "left_anti").join(where, "key")
    return heavy.unionByName(rest).select(id_col, "size", "text_crc32", "key", "shard")


def numbered(assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``assigned`` plus slot: 0, 1, 2, ... in every shard."""
    return gapless(materialise(assigned, "assigned"), "shard", [id_col, "key"], "slot")


def write(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` below ``path``, one folder for each shard; ids must be unique."""
    docs.join(assigned.select(id_col, "shard"), id_col).repartitionByRange("shard", id_col).write.partitionBy("shard").parquet(path)
