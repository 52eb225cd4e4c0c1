"""Rebalance: bring every class to ``target`` pictures.

Originals above the target are capped; a class below it gets
``target - have`` drawn sources (with replacement), each to be turned into a
new picture by ``augment``.  The order inside a class is a seeded md5 of the
name (the file listing's order is unspecified), ranked in hash sub-buckets so
a huge class is ranked by many tasks.

A class with few originals makes a few join keys of many draws.  The draws of a
source are split into groups of about ``PER_COPY`` by their number, and the
source is copied once a group, as counted draws tell; copies add at most one row
for ``PER_COPY`` draws, so their bytes are a small part of the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import DEFAULT_SEED, hash32, seeded_md5
from tessera.operators.ordering import rank_in_groups, written

TARGET = 80_000
# Draws spelled out by one task at a time, and draws that one copy of a source serves.
DRAW_BLOCK = 10_000
PER_COPY = 2_000


def class_deficits(images: DataFrame, target: int = TARGET, labels: DataFrame | None = None,
                   label: str = "label") -> DataFrame:
    """A4: ``(label, have, to_generate)``; ``to_generate = max(0, target - have)``.

    ``labels`` (one column ``label``) keeps classes that have no picture."""
    have = images.groupBy(label).agg(F.count(F.lit(1)).alias("have"))
    if labels is not None:
        have = labels.select(label).distinct().join(have, label, "left").fillna(0, ["have"])
    return have.select(label, F.col("have").cast("bigint").alias("have"),
                       F.greatest(F.lit(0), F.lit(target) - F.col("have")).cast("bigint").alias("to_generate"))


def rank_originals(images: DataFrame, seed: int = DEFAULT_SEED, label: str = "label",
                   name: str = "name", limit: int | None = None) -> DataFrame:
    """Adds ``rn``: 1-based place of each picture in its class's seeded order
    (with ``limit``, later pictures may be left out)."""
    d = images.withColumn("__md5", seeded_md5(seed, name))
    return rank_in_groups(d, [label], "__md5", [name], out="rn", limit=limit).drop("__md5")


def _numbered_draws(need: DataFrame, count, label: str, block: int = DRAW_BLOCK) -> DataFrame:
    """One row per draw, ``draw_no`` from 1 to ``count``: blocks of draws are
    dealt to the tasks first and spelled out there, so that a class's draws
    are not made by one task."""
    last = F.floor((count - 1) / block).cast("bigint")
    blocks = need.select(label, "have", count.cast("bigint").alias("__count"),
                         F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("__block"))
    return (blocks.repartition(label, "__block")
            .select(label, "have", F.explode(F.sequence(F.col("__block") * block + 1,
                                                        F.least("__count", (F.col("__block") + 1) * block))).alias("draw_no")))


def _groups(draws, have) -> Column:
    """Groups into which a class's draws are split."""
    return F.ceil(draws / (have * F.lit(PER_COPY))).cast("bigint")


def _spread(draws: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Draws dealt to enough tasks by their keys, for a join that leaves them there.

    By bytes a few tasks would do, but what follows (a new picture for each draw)
    costs time for each row.  Small jobs are left to the planner."""
    if n <= PER_COPY:
        return draws
    spark = draws.sparkSession
    tasks = min(-(-n // PER_COPY), 4 * spark.sparkContext.defaultParallelism)
    return draws.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys).hint("merge")


def _drawn(need: DataFrame, count, ranked: DataFrame, seed: int, label: str) -> DataFrame:
    """``(label, draw_no, source)`` for ``count`` draws of each class in ``need`` (label, have), from ``ranked`` (label, rn, source)."""
    need = need.withColumn("__n", count.cast("bigint"))
    draws = _numbered_draws(need, F.col("__n"), label).withColumn("rn", (hash32(seed, label, "draw_no") % F.col("have") + 1).cast("bigint"))
    groups = need.select(label, _groups(F.col("__n"), F.col("have")).alias("__groups"))
    draws = draws.join(groups, label).withColumn("__copy", F.col("draw_no") % F.col("__groups"))
    copies = ranked.join(groups, label).select(label, "rn", "source", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__groups") - 1)).alias("__copy"))
    total = need.agg(F.sum("__n")).first()[0] or 0
    return _spread(draws, [label, "rn", "__copy"], total).join(copies, [label, "rn", "__copy"]).select(label, "draw_no", "source")


def cap_per_class(images: DataFrame, target: int = TARGET, seed: int = DEFAULT_SEED,
                  label: str = "label", name: str = "name") -> DataFrame:
    """L3: keep at most ``target`` originals per class."""
    return rank_originals(images, seed, label, name, target).filter(F.col("rn") <= target)


def draw_sources(images: DataFrame, deficits: DataFrame, seed: int = DEFAULT_SEED,
                 label: str = "label", name: str = "name") -> DataFrame:
    """One row per picture to generate, ``(label, draw_no, source)``, the
    source drawn uniformly with replacement from the class's originals.

    ``pick = hash(seed, label, draw_no) mod have + 1`` is joined to the
    ranked originals on ``(label, rn)``, a unique key on that side.  A class
    with no original has nothing to draw from and yields no rows.
    """
    need = deficits.filter((F.col("to_generate") > 0) & (F.col("have") > 0))
    ranked = rank_originals(images, seed, label, name).select(label, "rn", F.col(name).alias("source"))
    return _drawn(need, F.col("to_generate"), ranked, seed, label)


def rebalance(images: DataFrame, target: int = TARGET, seed: int = DEFAULT_SEED,
              labels: DataFrame | None = None, label: str = "label", name: str = "name") -> DataFrame:
    """Capped originals plus drawn sources for the generated pictures.

    Rows ``(label, name, source, generated)``; a generated row is named
    ``<label>_gen_<draw_no>`` and ``source`` names the original it is made
    from.  Every class with at least one original ends with ``target`` rows.
    The originals are ranked once; the cap, the class sizes and the draw join
    all use that one ranking.
    """
    d = images.select(label, name).withColumn("__md5", seeded_md5(seed, name))
    ranked, sizes = rank_in_groups(d, [label], "__md5", [name], out="rn", return_sizes=True)
    # read twice (cap and draw join): written once
    ranked = written(ranked.drop("__md5"))
    kept = ranked.filter(F.col("rn") <= target).select(
        label, name, F.col(name).alias("source"), F.lit(False).alias("generated"))
    have = sizes.select(label, F.col("group_n").alias("have"))
    if labels is not None:
        have = labels.select(label).distinct().join(have, label, "left").fillna(0, ["have"])
    need = have.filter((F.col("have") > 0) & (F.col("have") < target))
    gen = _drawn(need, F.lit(target) - F.col("have"), ranked.select(label, "rn", F.col(name).alias("source")), seed, label).select(
        label, F.concat(F.col(label).cast("string"), F.lit("_gen_"), F.col("draw_no").cast("string")).alias(name),
        "source", F.lit(True).alias("generated"))
    return kept.unionByName(gen)


def generation_report(rebalanced: DataFrame, label: str = "label") -> DataFrame:
    """A5: originals and generated pictures per class."""
    return rebalanced.groupBy(label).agg(
        F.count_if(~F.col("generated")).alias("originals"),
        F.count_if(F.col("generated")).alias("generated"))


def attach_pixels(drawn: DataFrame, images: DataFrame, label: str = "label", name: str = "name",
                  pixels: str = "pixels") -> DataFrame:
    """Join the drawn sources to their pixels.

    A source with more than ``PER_COPY`` draws is copied, so that its draws meet
    its pixels in several tasks."""
    drawn = written(drawn)
    counts = drawn.groupBy(label, "source").agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.filter(F.col("__n") > PER_COPY).select(label, "source", F.ceil(F.col("__n") / PER_COPY).cast("bigint").alias("__groups"))
    one = F.coalesce("__groups", F.lit(1).cast("bigint"))
    rows = drawn.join(hot, [label, "source"], "left").withColumn("__copy", F.pmod(F.xxhash64(name), one)).drop("__groups")
    src = images.select(label, F.col(name).alias("source"), pixels).join(hot, [label, "source"], "left")
    src = src.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), one - 1))).drop("__groups")
    return _spread(rows, [label, "source", "__copy"], drawn.count()).join(src, [label, "source", "__copy"]).drop("__copy")


__all__ = ["TARGET", "class_deficits", "rank_originals", "cap_per_class", "draw_sources", "rebalance",
           "generation_report", "attach_pixels", "rebalance_images"]


def rebalance_images(images: DataFrame, height: int, width: int, channels: int, target: int = TARGET,
                     seed: int = DEFAULT_SEED, labels: DataFrame | None = None, label: str = "label",
                     name: str = "name", pixels: str = "pixels", steps=None) -> DataFrame:
    """U1 + G1: the rebalanced picture set with pixels; originals keep theirs,
    generated pictures are augmented from their drawn source (equi-join on the
    source name)."""
    from tessera.operators.augment import augment

    px = images.select(label, name, pixels)
    orig = cap_per_class(px, target, seed, label, name)
    plan = rebalance(images.select(label, name), target, seed, labels, label, name)
    drawn = attach_pixels(plan.filter("generated"), px, label, name, pixels)
    gen = augment(drawn, height, width, channels, steps, seed,
                  key=name, pixels=pixels, keep=(label, "source", "generated"))
    return orig.select(label, name, F.col(name).alias("source"), F.lit(False).alias("generated"),
                       F.col(pixels).cast("array<float>").alias(pixels)) \
        .unionByName(gen.select(label, name, "source", "generated", pixels))
