import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.ordering import sorted_index


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_sorted_index_is_the_place_in_order(spark, n):
    rng = random.Random(n)
    keys = list({(rng.choice(("", "a", "é", None)), rng.randrange(10**6)) for _ in range(n)})
    d = spark.createDataFrame(keys, "s string, i int").repartition(5)
    got = sorted_index(d, [F.col("s").asc_nulls_last(), F.col("i").desc()], "at").collect()
    expected = sorted(keys, key=lambda k: (k[0] is None, (k[0] or "").encode(), -k[1]))
    assert [(r.s, r.i) for r in sorted(got, key=lambda r: r["at"])] == expected
    assert sorted(r["at"] for r in got) == list(range(len(keys)))


def test_sorted_index_has_no_window(spark):
    assert "Window" not in sorted_index(spark.range(10), ["id"])._jdf.queryExecution().toString()
