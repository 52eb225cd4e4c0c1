import math
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import mcxent, mcxent_logits, round_array, softmax


def test_softmax_and_cross_entropy_by_one_fold(spark):
    rows = [(0, [1.0, 2.0, 3.0], 2), (1, [1000.0, -1000.0, 999.0], 1), (2, [-5.5], 0), (3, [3.0, 3.0, 1.0, 7.5, -2.0], 3)]
    d = spark.createDataFrame(rows, "id int, z array<double>, label int")
    for r in d.select("*", softmax("z").alias("p"), mcxent_logits("z", "label").alias("loss"), mcxent(softmax("z"), "label").alias("plain")).collect():
        m = max(r.z)
        e = [math.exp(x - m) for x in r.z]
        assert r.p == pytest.approx([x / sum(e) for x in e])
        assert r.loss == pytest.approx(m + math.log(sum(e)) - r.z[r.label])
        if r.id != 1:  # the probability itself is zero there
            assert r.loss == pytest.approx(r.plain)


def test_softmax_of_empty_and_null(spark):
    d = spark.createDataFrame([(0, []), (1, None), (2, [1.0, None])], "id int, z array<double>")
    got = {r.id: r.p for r in d.select("id", softmax("z").alias("p")).collect()}
    assert got == {0: [], 1: None, 2: [None, None]}


def test_softmax_time_is_linear(spark):
    def took(n):
        d = spark.range(300).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i * 37 % 11).cast("double")).alias("z"))
        start = time.time()
        d.select(F.sum(F.element_at(softmax("z"), 1))).collect()
        return time.time() - start
    took(8)
    assert took(2048) < 20  # minutes when maximum and sum are found again for each value


def test_rounding_has_one_zero(spark):
    r = spark.range(1).select(round_array(F.array(F.lit(-1e-9), F.lit(1e-9)), 6).alias("v")).first()
    assert [math.copysign(1, x) for x in r.v] == [1, 1]
