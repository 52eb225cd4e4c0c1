"""Property tests (hypothesis) on small generated frames."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import evaluate as EV
from tessera.operators import prepare
from tessera.operators import rebalance as R

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

class_sizes = st.dictionaries(st.sampled_from(["a", "b", "c", "d"]), st.integers(1, 12), min_size=1)


@SETTINGS
@given(sizes=class_sizes, train=st.integers(1, 99), batch=st.integers(1, 7))
def test_balance_split_properties(spark, sizes, train, batch):
    rows = [(i, lab, [0.0]) for i, (lab, _) in enumerate((l, k) for l, n in sizes.items() for k in range(n))]
    df = spark.createDataFrame(rows, "id long, label string, pixels array<double>")
    b, bal = prepare.balance_classes(df, train=train, test=100 - train)
    s = prepare.assign_batches(prepare.split_train_test(b, bal), batch).collect()
    m = min(sizes.values())
    ids = [r["id"] for r in s]
    assert len(ids) == len(set(ids)) == m * len(sizes)                    # disjoint and complete
    assert sum(r["split"] == "train" for r in s) == bal.n_train
    for lab in sizes:
        assert sum(r["label"] == lab for r in s) == m                     # equal class counts
    for split in ("train", "test"):
        sizes_b = {}
        for r in s:
            if r["split"] == split:
                sizes_b[r["batch_id"]] = sizes_b.get(r["batch_id"], 0) + 1
        if sizes_b:
            assert sorted(sizes_b) == list(range(len(sizes_b)))
            assert all(v == batch for k, v in sizes_b.items() if k < max(sizes_b))


@SETTINGS
@given(sizes=class_sizes, target=st.integers(1, 15))
def test_rebalance_exact_target(spark, sizes, target):
    rows = [(lab, f"{lab}{k}") for lab, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "label string, name string")
    out = R.rebalance(df, target=target).collect()
    for lab in sizes:
        assert sum(r["label"] == lab for r in out) == target
    names = {r["name"] for r in out}
    assert len(names) == len(out)


@SETTINGS
@given(pairs=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=30))
def test_metrics_in_unit_interval(spark, pairs):
    df = spark.createDataFrame(pairs, "actual int, predicted int")
    for r in EV.class_metrics(EV.confusion_matrix(df)).collect():
        for c in ("precision", "recall", "f1"):
            assert r[c] is None or 0.0 <= r[c] <= 1.0
    acc = EV.classification_metrics(EV.confusion_matrix(df)).first()["accuracy"]
    assert abs(acc - sum(a == p for a, p in pairs) / len(pairs)) < 1e-12
