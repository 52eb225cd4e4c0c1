"""Mixing sources to target weights, by hash-threshold histograms.

A document's place is a hash of its id and text.  A source whose target is c
whole passes and a bit takes every document c times, and those below a
threshold once more: budgets are nested, as a document of one more pass is in
all passes before it.  The threshold needs no sort: sizes are summed by source
and bucket (the next bits of the hash), the bucket in which the running sum
passes the budget is the boundary, and only its rows are split by their next
bits, until a boundary bucket holds one document.  The last document is taken
when that brings the sum nearer to the budget.

All work on documents is one pass for sizes and hashes, map-side combined sums,
and joins with a table of one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialise
from tessera.operators.ordering import sorted_index

#: Weights of the sources in order of their names, again and again; no document is taken more often than LIMIT times.
WEIGHTS, LIMIT = (1, 2, 3), 3
#: Bits of the hash (15 hexadecimal digits), and bits of one histogram.
BITS, STEP = 60, 12


def word_count(text: Column) -> Column:
    """Runs of non-space (ASCII white space); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place(id_col: Column, text: Column) -> Column:
    """A number below 2**60 from the document's id and text."""
    digest = F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size and target (double) from source and source_size.

    Sources by code point, null last, weigh ``weights`` in turn and share the
    sum of all sizes; a target stops at ``limit`` times its source's size and
    what is above it is shared anew by weight, until no target is above.  The
    last share is one fraction, found by exact whole numbers.
    """
    placed = sorted_index(sources, [F.col("source").asc_nulls_last()], "at")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    wide = "decimal(38,0)"
    placed = placed.select("source", "source_size", weight.cast("bigint").alias("weight"), (F.col("source_size") * limit).alias("most"))
    total, free = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    used, seen = 0, None
    while (used, free) != seen:  # what is above only grows
        seen = (used, free)
        above = F.col("most").cast(wide) * F.lit(free) < F.col("weight").cast(wide) * F.lit(total - used)
        used, free = placed.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)),
                                F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
    share = (F.col("weight").cast(wide) * F.lit(total - used)).cast("double") / F.lit(float(free or 1))
    return placed.select("source", "source_size", F.when(above, F.col("most").cast("double")).otherwise(share).alias("target"))


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["source"].eqNullSafe(right["source"])


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(source, below)``: rows of the source with a hash under ``below`` have a sum of sizes near ``budget``.

    ``rows`` has source, size and hash; ``budgets`` has source and budget, at
    least 0 and less than the source's sum.  Rows with one hash stay together.
    A source with a budget of 0 is not listed.
    """
    done = None
    state = budgets.where("budget > 0").select("source", "budget", F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("prefix"))
    for bits in range(STEP, BITS + 1, STEP):
        shift = BITS - bits
        if bits > STEP:  # only the boundary's rows go on
            rows = rows.join(state, _same(rows, state) & (F.shiftright(rows["hash"], shift + STEP) == state["prefix"]), "left_semi")
            rows = materialise(rows, "mixing")
        sums = (rows.groupBy("source", F.shiftright("hash", shift).alias("bucket"))
                .agg(F.sum("size").cast("double").alias("size"), F.count(F.lit(1)).alias("n")))
        joined = sums.join(state, _same(sums, state)).select(sums["source"], "bucket", "size", "n", "budget", "sum")
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        cut = (joined.withColumn("sum", F.col("sum") + F.coalesce(F.sum("size").over(before), F.lit(0.0)))
               .where((F.col("sum") < F.col("budget")) & (F.col("sum") + F.col("size") >= F.col("budget"))))
        cut = materialise(cut, "mixing")
        last = (F.col("n") == 1) | F.lit(bits == BITS)
        nearer = F.col("sum") + F.col("size") - F.col("budget") < F.col("budget") - F.col("sum")
        found = cut.where(last).select("source", F.shiftleft(F.col("bucket") + nearer.cast("bigint"), shift).alias("below"))
        done = found if done is None else done.unionByName(found)
        state = cut.where(~last).select("source", "budget", "sum", F.col("bucket").alias("prefix"))
        if bits < BITS and state.isEmpty():
            break
    return done


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Per row: id_col, source, size, source_size, target, copies (0 to ``limit``) and taken (copies * size).

    ``targets`` says what a source's sum of taken words comes near to: the
    difference is at most half of the size of the document at the threshold.
    Words are runs of non-space; a null or empty text has none and is taken as
    its place says, for 0 words.  A null source is a source of its own.  Rows
    with equal id and text share a place and are taken equally often.  Reruns
    agree: nothing depends on partitions or the order of rows.  Other columns
    are not read.  No rows give none.
    """
    i, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = materialise(docs.select(i.alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"), place(i, text).alias("hash")), "mixing")
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    wanted = materialise(wanted.withColumn("passes", passes.cast("bigint"))
                         .withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")), "mixing")
    found = thresholds(rows.drop("id"), wanted.select("source", "budget"))
    plan = wanted.join(found, _same(wanted, found), "left").select(wanted["source"], "source_size", "target", "passes", F.coalesce("below", F.lit(0)).alias("below"))
    plan = materialise(plan, "mixing")
    copies = F.col("passes") + (F.col("hash") < F.col("below")).cast("bigint")
    return (rows.join(plan, _same(rows, plan)).select(F.col("id").alias(id_col), rows["source"], "size", "source_size", "target", copies.alias("copies"))
            .withColumn("taken", F.col("copies") * F.col("size")))
