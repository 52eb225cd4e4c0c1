import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordering
from tessera.operators.asof import asof_join


def brute(left, right):
    out = []
    for i, g, t in left:
        best = max(((rt, k, v) for rg, rt, k, v in right if rg == g and rt is not None and g is not None and t is not None and rt <= t), default=None)
        out.append((i, g, t, *(best[1:] if best else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,n,m", [(1, 300, 200), (2, 50, 0), (3, 0, 20), (4, 2000, 5)])
def test_equals_brute_force(spark, seed, n, m):
    rng = random.Random(seed)
    group = lambda: rng.choice(("hot", "hot", "a", "b", "none", None))
    left = [(i, group(), rng.choice((None, rng.randrange(60), rng.randrange(60), 30))) for i in range(n)]
    right = [(rng.choice(("hot", "a", "c", None)), rng.choice((None, *[rng.randrange(60)] * 9)), k, float(k)) for k in range(m)]
    d = asof_join(spark.createDataFrame(left, "id int, grp string, at int").repartition(3),
                  spark.createDataFrame(right, "grp string, at bigint, k int, price double"), "at", ["k", "price"], by=["grp"], tie="k")
    assert d.columns == ["id", "grp", "at", "k", "price"]
    assert sorted([tuple(r) for r in d.collect()], key=str) == brute(left, right)


def test_without_groups_and_clashing_names(spark):
    left = spark.createDataFrame([(5, "x"), (10, "y"), (99, "z")], "at int, lr string")
    steps = spark.createDataFrame([(10, 0.1), (10, 0.3), (50, 0.2)], "at int, rate double")
    got = {r["at"]: r["rate"] for r in asof_join(left, steps, "at", ["rate"]).collect()}
    assert got == {5: None, 10: 0.3, 99: 0.2}
    with pytest.raises(ValueError, match="already"):
        asof_join(left, steps.withColumnRenamed("rate", "LR"), "at", ["LR"])


def test_values_are_carried_over_empty_ranges_and_one_key_is_split(spark):
    """A step in the first range reaches rows of all later ones, also when most rows have one key."""
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(2500).alias("at"))
    steps = spark.createDataFrame([(0, "first")], "at bigint, v string")
    out = asof_join(left, steps, "at", ["v"])
    assert out.filter("v = 'first'").count() == 5000
    window_inputs = ordering.carry_forward(left.withColumn("v", F.lit(None).cast("string")), "v", "o", ["at", "id"])
    assert window_inputs.filter("o IS NOT NULL").count() == 0
