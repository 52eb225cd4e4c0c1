"""As-of join of two tables of any size.

Every row of the left table meets the latest row of the right table at or
before it.  Both sides are one table in the order of (group, key), right rows
before left rows of one key, and the right values are carried forward: no range
is spelled out, no side is broadcast, and a group that holds most rows is many
ranges (see ``ordering.carry_forward``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import carry_forward


def asof_join(left: DataFrame, right: DataFrame, on: str, values: Sequence[str], by: Sequence[str] = (),
              tie: str | None = None, right_on: str | None = None) -> DataFrame:
    """``left`` with the ``values`` of the right row with the greatest ``on`` not after its own.

    ``by`` columns must be equal; null ``on`` or ``by`` match nothing, and a left
    row without a match has null values.  Of right rows with one key the one
    with the greatest ``tie`` counts (without ``tie``: the greatest values).
    """
    clash = {c.lower() for c in left.columns} & {v.lower() for v in values}
    if clash:
        raise ValueError(f"left already has {sorted(clash)}")
    by, right_on = list(by), right_on or on
    key = left.schema[on].dataType
    group = [f"__g{i}" for i in range(len(by))]
    found = F.struct(*[F.col(f"`{v}`") for v in values])
    rank = F.col(f"`{tie}`") if tie else found
    steps = right.filter(F.col(f"`{right_on}`").isNotNull())
    for b in by:
        steps = steps.filter(F.col(f"`{b}`").isNotNull())
    steps = steps.select(*[F.col(f"`{b}`").cast(left.schema[b].dataType).alias(g) for b, g in zip(by, group)],
                         F.col(f"`{right_on}`").cast(key).alias("__key"), F.lit(1).alias("__side"), rank.alias("__tie"),
                         F.lit(0).cast("bigint").alias("__spread"), found.alias("__step"))
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    # the row's hash keeps rows of one key from meeting in one range
    rows = left.select(*[F.col(f"`{b}`").alias(g) for b, g in zip(by, group)], F.col(f"`{on}`").alias("__key"),
                       F.lit(2).alias("__side"), F.lit(None).cast(steps.schema["__tie"].dataType).alias("__tie"),
                       F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]).alias("__spread"),
                       F.lit(None).cast(steps.schema["__step"].dataType).alias("__step"), whole.alias("__row"))
    both = steps.withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType)).unionByName(rows)
    carried = carry_forward(both, "__step", "__found", ["__key", "__side", "__tie", "__spread"], group)
    hit = carried.filter(F.col("__side") == 2).select("__row.*", F.when(F.col("__key").isNotNull(), F.col("__found")).alias("__found"))
    return hit.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col("__found")[v].alias(v) for v in values])
