from pyspark.sql import functions as F

from tessera.operators import rebalance as R


def imgs(spark, sizes):
    rows = [(lab, f"{lab}{i}") for lab, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "label string, name string")


def test_every_class_reaches_target(spark):
    df = imgs(spark, {"a": 2, "b": 5, "c": 9})
    labels = spark.createDataFrame([("a",), ("b",), ("c",), ("empty",)], "label string")
    out = R.rebalance(df, target=5, labels=labels)
    counts = {r["label"]: r["n"] for r in out.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {"a": 5, "b": 5, "c": 5}
    rep = {r["label"]: (r["originals"], r["generated"]) for r in R.generation_report(out).collect()}
    assert rep == {"a": (2, 3), "b": (5, 0), "c": (5, 0)}
    d = {r["label"]: (r["have"], r["to_generate"]) for r in R.class_deficits(df, 5, labels).collect()}
    assert d == {"a": (2, 3), "b": (5, 0), "c": (9, 0), "empty": (0, 5)}
    # generated rows name a real original of their own class
    gen = out.filter("generated").collect()
    assert all(r["source"].startswith(r["label"]) for r in gen)


def test_cap_is_seeded_subset(spark):
    df = imgs(spark, {"a": 50})
    a = {r["name"] for r in R.cap_per_class(df, 10, seed=1).collect()}
    b = {r["name"] for r in R.cap_per_class(df, 10, seed=1).collect()}
    assert a == b and len(a) == 10


def test_rebalance_images_shapes(spark):
    rows = [("a", f"a{i}", [float(i)] * 16) for i in range(3)] + [("b", "b0", [1.0] * 16)]
    df = spark.createDataFrame(rows, "label string, name string, pixels array<double>")
    out = R.rebalance_images(df, 4, 4, 1, target=4).collect()
    assert len(out) == 8 and all(len(r["pixels"]) == 16 for r in out)


def test_draws_from_one_picture_are_spread(spark):
    df = imgs(spark, {"one": 1, "many": 500})
    out = R.draw_sources(df, R.class_deficits(df, 80_000))
    rows = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count_if(F.col("label") == "one").alias("n")).collect()
    n = [r["n"] for r in rows if r["n"]]
    assert sum(n) == 79_999 and len(n) >= 8 and max(n) < 80_000 / 3
    plain = {(r["label"], r["draw_no"]): r["source"] for r in out.filter("draw_no % 97 = 0").collect()}
    assert {s for (lab, _), s in plain.items() if lab == "one"} == {"one0"} and len({s for (lab, _), s in plain.items() if lab == "many"}) > 300
    assert out.groupBy("label").agg(F.countDistinct("draw_no").alias("n"), F.max("draw_no").alias("m")).filter("n <> m").count() == 0


def test_pixels_meet_the_draws_of_a_hot_source_in_several_tasks(spark):
    df = spark.createDataFrame([("one", "a", [1.0] * 4), ("two", "b", [2.0] * 4), ("two", "c", [3.0] * 4)], "label string, name string, pixels array<double>")
    plan = R.rebalance(df.select("label", "name"), 20_000).filter("generated")
    out = R.attach_pixels(plan, df)
    rows = out.groupBy(F.spark_partition_id().alias("task"), "label").agg(F.count("*").alias("n")).collect()
    hot = [r["n"] for r in rows if r["label"] == "one"]
    assert sum(hot) == 19_999 and len(hot) >= 3
    wrong = out.filter(F.element_at("pixels", 1) != F.expr("CASE source WHEN 'a' THEN 1.0 WHEN 'b' THEN 2.0 ELSE 3.0 END"))
    assert wrong.count() == 0 and out.count() == 19_999 + 19_998
