import pytest
from pyspark.sql import functions as F

from tessera.operators import prepare


def images(spark, sizes):
    rows = []
    i = 0
    for lab, n in sizes.items():
        for _ in range(n):
            rows.append((i, lab, [float(i)]))
            i += 1
    return spark.createDataFrame(rows, "id long, label string, pixels array<double>")


@pytest.mark.parametrize("sizes", [{"a": 5}, {"a": 7, "b": 3, "c": 4}, {"a": 4, "b": 4}, {"x": 23, "y": 30}])
def test_balance_split_batches(spark, sizes):
    df = images(spark, sizes)
    bal_df, bal = prepare.balance_classes(df, "label", "id", train=80, test=20)
    rows = bal_df.collect()
    m = min(sizes.values())
    assert bal.per_class == m and bal.n_classes == len(sizes)
    assert sorted(r["pos"] for r in rows) == list(range(m * len(sizes)))
    per = {}
    for r in rows:
        per[r["label"]] = per.get(r["label"], 0) + 1
    assert set(per.values()) == {m}
    s = prepare.assign_batches(prepare.split_train_test(bal_df, bal), 3).collect()
    train = [r for r in s if r["split"] == "train"]
    assert len(train) == int(0.8 * m * len(sizes) + 0.5)
    for split in ("train", "test"):
        part = sorted(r["split_pos"] for r in s if r["split"] == split)
        assert part == list(range(len(part)))
        counts = {}
        for r in s:
            if r["split"] == split:
                counts[r["batch_id"]] = counts.get(r["batch_id"], 0) + 1
        if counts:
            last = max(counts)
            assert all(v == 3 for k, v in counts.items() if k != last) and counts[last] <= 3


def test_balance_is_seeded(spark):
    df = images(spark, {"a": 10, "b": 12})
    a = sorted(tuple(r) for r in prepare.balance_classes(df, seed=1)[0].select("id", "pos").collect())
    b = sorted(tuple(r) for r in prepare.balance_classes(df, seed=1)[0].select("id", "pos").collect())
    c = sorted(tuple(r) for r in prepare.balance_classes(df, seed=2)[0].select("id", "pos").collect())
    assert a == b and a != c


def test_one_hot_out_of_range_raises(spark):
    from tessera.functions.columns import one_hot
    df = spark.createDataFrame([(0,), (2,)], "label int")
    with pytest.raises(Exception, match="label out of range"):
        df.select(one_hot("label", 2)).collect()
    assert df.filter("label = 0").select(one_hot("label", 2).alias("o")).first()["o"] == [1.0, 0.0]


def test_min_max_and_labels(spark):
    df = spark.createDataFrame([(1, [0.0, 2.0]), (2, [4.0, 1.0])], "id int, features array<double>")
    st = prepare.fit_min_max(df)
    out = {r["id"]: r["features"] for r in prepare.apply_min_max(df, st).collect()}
    assert out == {1: [0.0, 0.5], 2: [1.0, 0.25]}
    files = spark.createDataFrame([("/d/cat/1.jpg",), ("/d/dog/2.png",)], "path string")
    labs = prepare.index_labels(prepare.with_labels(files)).collect()
    assert {(r["label"], r["label_idx"]) for r in labs} == {("cat", 0), ("dog", 1)}
