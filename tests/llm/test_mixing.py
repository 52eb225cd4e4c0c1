import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as M


def brute_targets(sizes, weights=(1, 2, 3), limit=3):
    """sizes: {source: size}; shares fixed at the limit one after another, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: Fraction(rest * weight[s], w) for s in free}
        above = [s for s in free if share[s] > limit * sizes[s]]
        if not above:
            return {**{s: Fraction(x) for s, x in fixed.items()}, **share}
        fixed.update({s: limit * sizes[s] for s in above})


def brute(rows, weights=(1, 2, 3), limit=3):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0d]+", t or "")), int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)) for i, t, s in rows]
    sizes = {}
    for _, s, n, _ in docs:
        sizes[s] = sizes.get(s, 0) + n
    target, out = brute_targets(sizes, weights, limit), []
    for s, size in sizes.items():
        passes = target[s] // size if size else 0
        budget, got, extra = target[s] - passes * size, 0, set()
        own = [d for d in docs if d[1] == s]
        for h in sorted({d[3] for d in own}):
            n = sum(d[2] for d in own if d[3] == h)
            if got + n <= budget or (got < budget and got + n - budget < budget - got):
                extra.add(h)
            if got + n > budget:
                break
            got += n
        out += [(i, n, size, float(target[s]), n * (int(passes) + (h in extra))) for i, _, n, h in own]
    return sorted(out, key=str)


def rounded(rows):
    return sorted([(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in rows], key=str)


@pytest.mark.parametrize("seed,step", [(1, 12), (2, 4), (3, 2)])
def test_matches_brute_force(spark, monkeypatch, seed, step):
    monkeypatch.setattr(M, "STEP", step)
    rng = random.Random(seed)
    names = ["a", "B", "ä", "z", None, "", "\U0001f600", "￿"]
    rows = [(rng.choice((i, i, 5, None)), " ".join(["w"] * rng.choice((0, 1, 3, 50, 400))) if rng.random() < 0.9 else None,
             rng.choices(names, weights=(60, 20, 10, 5, 5, 3, 2, 1))[0]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    expected = [(*x[:3], round(x[3], 6), x[4]) for x in brute(rows)]
    assert rounded(M.mix(d).collect()) == expected
    assert rounded(M.mix(d.repartition(7, F.rand(seed))).collect()) == expected


def test_targets_stop_at_the_limit(spark):
    sizes = {"a": 1, "b": 10, "c": 1000, "d": 5, "e": 700, "f": 0, None: 300}
    d = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in M.targets(d).collect()}
    assert got == pytest.approx({s: float(x) for s, x in brute_targets(sizes).items()})
    assert got["a"] == 3 and got["f"] == 0 and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_taken_comes_near_the_target(spark):
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + cast(id % 30 AS int))").alias("text"),
                                  F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    rows = M.mix(d).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    for r in rows:
        assert abs(r.taken - r.target) <= 15 and r.most <= 3


def test_edge_rows(spark, corpus, empty):
    rows = [(r.doc_id, r.text, r.source) for r in corpus.collect()]
    assert rounded(M.mix(corpus).collect()) == [(*x[:3], round(x[3], 6), x[4]) for x in brute(rows)]
    assert M.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert rounded(M.mix(blank).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_no_sort_of_documents_and_no_python(spark, corpus):
    plan = M.mix(corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "RangePartitioning" not in plan
