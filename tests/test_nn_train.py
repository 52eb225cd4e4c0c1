import numpy as np
from pyspark.sql import functions as F

from tessera.operators import nn, train as TR


def test_gradient_check():
    rng = np.random.default_rng(0)
    layers = [{"type": "conv", "out": 2, "k": 3}, {"type": "pool", "k": 2},
              {"type": "dense", "out": 4}, {"type": "output", "out": 3}]
    shape = (6, 6, 1)
    params = {(l, n): rng.normal(size=s) * 0.5 for l, n, s, _ in nn.param_specs(layers, shape)}
    x = rng.normal(size=(4, 36))
    y = np.eye(3)[rng.integers(0, 3, 4)]

    def loss(p):
        pr = nn.forward(p, layers, shape, x)
        return -np.mean(np.sum(y * np.log(pr), 1)) + 0.5 * 0.01 * sum((v ** 2).sum() for (l, n), v in p.items() if n == "W")

    pr, cache = nn.forward(params, layers, shape, x, keep=True)
    g = nn.backward(params, layers, cache, pr, y, l2=0.01)
    for k, v in params.items():
        for _ in range(3):
            idx = tuple(rng.integers(0, s) for s in v.shape)
            v[idx] += 1e-6
            l1 = loss(params)
            v[idx] -= 2e-6
            l2 = loss(params)
            v[idx] += 1e-6
            assert abs((l1 - l2) / 2e-6 - g[k][idx]) < 1e-6


def test_conv_matches_naive():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 5, 5, 2))
    W = rng.normal(size=(3, 2, 3, 3))
    b = rng.normal(size=3)
    out = nn.conv_forward(x, W, b)
    for n in range(2):
        for r in range(3):
            for c in range(3):
                for f in range(3):
                    ref = b[f] + sum(W[f, ch, i, j] * x[n, r + i, c + j, ch]
                                     for ch in range(2) for i in range(3) for j in range(3))
                    assert abs(out[n, r, c, f] - ref) < 1e-9


def _samples(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lab = i % 2
        x = rng.normal(size=4) + (3.0 if lab else -3.0)
        rows.append((i, x.tolist(), [1.0 - lab, float(lab)], lab))
    return spark.createDataFrame(rows, "id long, features array<double>, onehot array<double>, label int")


def test_one_worker_equals_sequential_adam(spark, tmp_shared):
    layers = [{"type": "output", "out": 2}]
    shape = (1, 1, 4)
    df = _samples(spark, 40)
    p0 = {(0, "W"): np.zeros((2, 4)), (0, "b"): np.zeros(2)}
    params, stats = TR.train(df, layers, shape, batch=10, averaging_frequency=2, workers=1,
                             params=p0, l2=0.0, lr_schedule=[], base_lr=0.05, stage_dir=tmp_shared("t1"),
                             dtype="float64")
    # replay the same order on the driver
    order = TR.assign_rounds(df, 1, 10, 2, 0).orderBy("wrn").toPandas()
    p = {k: v.copy() for k, v in p0.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    for it, start in enumerate(range(0, 40, 10)):
        g = order.iloc[start:start + 10]
        x = np.stack(g["features"].map(np.asarray))
        y = np.stack(g["onehot"].map(np.asarray))
        pr, cache = nn.forward(p, layers, shape, x, keep=True)
        gr = nn.backward(p, layers, cache, pr, y)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * gr[k]
            v2[k] = 0.999 * v2[k] + 0.001 * gr[k] ** 2
            p[k] = p[k] - 0.05 * (m[k] / (1 - 0.9 ** (it + 1))) / (np.sqrt(v2[k] / (1 - 0.999 ** (it + 1))) + 1e-8)
    for k in p:
        assert np.allclose(params[k], p[k], atol=1e-10)
    assert stats.count() == 4


def test_loss_falls_and_eval(spark, tmp_shared):
    layers = [{"type": "dense", "out": 4}, {"type": "output", "out": 2}]
    df = _samples(spark, 200)
    params, stats = TR.train(df, layers, (1, 1, 4), batch=10, averaging_frequency=2, workers=3, epochs=2,
                             lr_schedule=[], base_lr=0.05, stage_dir=tmp_shared("t2"))
    s = stats.orderBy("iteration").toPandas()
    assert s["score"].iloc[-5:].mean() < s["score"].iloc[:5].mean()
    pred = TR.evaluate_model(df, layers, params, (1, 1, 4))
    acc = pred.filter(F.col("actual") == F.col("predicted")).count() / 200
    assert acc > 0.9


def test_average_and_lr(spark):
    rows = [(0, 0, "W", 0, [1.0, 2.0]), (1, 0, "W", 0, [3.0, 6.0]), (0, 1, "b", 0, [5.0])]
    df = spark.createDataFrame(rows, "worker int, layer int, name string, chunk int, values array<double>")
    avg = {(r["layer"], r["name"]): r["values"] for r in TR.average_parameters(df).collect()}
    assert avg == {(0, "W"): [2.0, 4.0], (1, "b"): [5.0]}
    weighted = spark.createDataFrame([(*r, n) for r, n in zip(rows, (1, 3, 7))], "worker int, layer int, name string, chunk int, values array<double>, n long")
    avg = {(r["layer"], r["name"]): r["values"] for r in TR.average_parameters(weighted, weighted=True).collect()}
    assert avg == {(0, "W"): [2.5, 5.0], (1, "b"): [5.0]}
    it = spark.createDataFrame([(99,), (100,), (0,), (399,)], "iteration long")
    lr = {r["iteration"]: r["lr"] for r in
          TR.lookup_lr(it, TR.schedule_frame(spark, TR.LR_SCHEDULE_CPU)).collect()}
    assert lr == {99: 0.01, 100: 0.008, 0: 0.01, 399: 0.003}
    col = {r["iteration"]: r["lr"] for r in it.select("iteration", TR.lr_at("iteration", TR.LR_SCHEDULE_GPU).alias("lr")).collect()}
    assert col == {99: 0.0005, 100: 0.0001, 0: 0.003, 399: 0.0001}


def test_init_parameters_he_scale(spark):
    layers = [{"type": "dense", "out": 50}]
    p = nn.init_parameters(spark, layers, (1, 1, 200), seed=5)
    w = np.array([r["value"] for r in p.filter("name = 'W'").collect()])
    assert len(w) == 10000 and abs(w.std() - np.sqrt(2 / 200)) < 0.01 and abs(w.mean()) < 0.01
    assert nn.count_parameters(nn.CLASSIFIER_LAYERS, (32, 32, 3)) == 1_780_882


def test_w_workers_frequency_one_is_mean_of_single_steps(spark, tmp_shared):
    """One round (batch larger than any worker's rows), plain SGD from zero:
    the averaged parameters are the mean of the workers' single steps."""
    layers = [{"type": "output", "out": 2}]
    shape = (1, 1, 4)
    df = _samples(spark, 30, seed=4)
    p0 = {(0, "W"): np.zeros((2, 4)), (0, "b"): np.zeros(2)}
    params, stats = TR.train(df, layers, shape, batch=100, averaging_frequency=1, workers=3, params=p0,
                             l2=0.0, lr_schedule=[], base_lr=0.1, updater="sgd", stage_dir=tmp_shared("t3"),
                             dtype="float64")
    rows = TR.assign_rounds(df, 3, 100, 1, 0).toPandas()
    assert rows["round"].max() == 0
    singles = []
    for _, g in rows.groupby("worker"):
        x = np.stack(g["features"].map(np.asarray))
        y = np.stack(g["onehot"].map(np.asarray))
        pr, cache = nn.forward(p0, layers, shape, x, keep=True)
        gr = nn.backward(p0, layers, cache, pr, y)
        singles.append({k: p0[k] - 0.1 * gr[k] for k in p0})
    for k in p0:
        assert np.allclose(params[k], np.mean([s_[k] for s_ in singles], axis=0), atol=1e-12)
    assert stats.count() == rows["worker"].nunique()


def test_init_chunks_equal_rows(spark):
    layers = [{"type": "conv", "out": 3, "k": 3}, {"type": "output", "out": 2}]
    a = nn.parameters_to_numpy(nn.init_parameters(spark, layers, (5, 5, 2), seed=9), layers, (5, 5, 2))
    b = nn.parameters_to_numpy(nn.init_parameter_chunks(spark, layers, (5, 5, 2), seed=9, chunk=7), layers, (5, 5, 2))
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)


def _replay(order, p, layers, shape, workers, batch, frequency, lr):
    """Rounds of parameter and moment averaging, one worker after the other."""
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    for r in range(int(order["round"].max()) + 1):
        ends = []
        for _, rows in order[order["round"] == r].groupby("worker"):
            state = [{k: a.copy() for k, a in s.items()} for s in (p, m, v2)]
            for mb, g in rows.sort_values("wrn").groupby("mb"):
                x, y = np.stack(g["features"].map(np.asarray)), np.stack(g["onehot"].map(np.asarray))
                pr, cache = nn.forward(state[0], layers, shape, x, keep=True)
                gr = nn.backward(state[0], layers, cache, pr, y)
                t = r * frequency + mb + 1
                for k in p:
                    state[1][k] = 0.9 * state[1][k] + 0.1 * gr[k]
                    state[2][k] = 0.999 * state[2][k] + 0.001 * gr[k] ** 2
                    state[0][k] = state[0][k] - lr * (state[1][k] / (1 - 0.9 ** t)) / (np.sqrt(state[2][k] / (1 - 0.999 ** t)) + 1e-8)
            ends.append(state)
        p, m, v2 = ({k: np.mean([e[i][k] for e in ends], axis=0) for k in p} for i in range(3))
    return p


def test_more_workers_than_slots_average_every_round(spark, tmp_shared):
    """Nine workers on four slots, of unequal rows: some end rounds before the others."""
    layers, shape, df = [{"type": "dense", "out": 3}, {"type": "output", "out": 2}], (1, 1, 4), _samples(spark, 300, seed=2)
    p0 = nn.formula_parameters(layers, shape)
    params, stats = TR.train(df, layers, shape, batch=4, averaging_frequency=2, workers=9, params=p0, l2=0.0,
                             lr_schedule=[], base_lr=0.05, stage_dir=tmp_shared("t9"), dtype="float64")
    order = TR.assign_rounds(df, 9, 4, 2, 0).toPandas()
    assert order.groupby("worker")["round"].max().nunique() > 1
    want = _replay(order, p0, layers, shape, 9, 4, 2, 0.05)
    assert params.keys() == want.keys() and all(np.allclose(params[k], want[k], atol=1e-10) for k in want)
    batches = order.groupby(["worker", "round", "mb"]).size()
    got = {(r["worker"], r["iteration"]): r["n"] for r in stats.collect()}
    assert got == {(w, r * 2 + mb): n for (w, r, mb), n in batches.items()}


def test_jobs_do_not_grow_with_rounds(spark, tmp_shared):
    sc = spark.sparkContext

    def jobs(n):
        sc.setJobGroup(f"train-{n}", "training")
        try:
            _, stats = TR.train(_samples(spark, n), [{"type": "output", "out": 2}], (1, 1, 4), batch=2, averaging_frequency=2,
                                workers=2, stage_dir=tmp_shared(f"jobs-{n}"))
            assert stats.agg(F.sum("n")).first()[0] == n
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        return len(sc.statusTracker().getJobIdsForGroup(f"train-{n}"))

    assert jobs(400) <= jobs(40) + 2


def test_samples_of_unequal_length_raise(spark, tmp_shared):
    import pytest
    df = _samples(spark, 20).withColumn("features", F.when(F.col("id") == 7, F.slice("features", 1, 3)).otherwise(F.col("features")))
    with pytest.raises(Exception, match="arrays of one length"):
        TR.train(df, [{"type": "output", "out": 2}], (1, 1, 4), workers=2, stage_dir=tmp_shared("ragged"))


def test_held_out_rows_of_one_file_are_scored_by_all_slots(spark):
    layers, shape = [{"type": "output", "out": 2}], (1, 1, 4)
    pred = TR.evaluate_model(_samples(spark, 64).coalesce(1), layers, nn.formula_parameters(layers, shape), shape)
    parts = pred.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == spark.sparkContext.defaultParallelism and sum(r["count"] for r in parts) == 64


def test_pool_gradient_goes_to_the_first_maximum():
    x = np.array([[1, 5, 2, 2, 9], [5, 0, 2, 2, 9], [7, 7, 7, 7, 7]], dtype=np.float32).reshape(1, 3, 5, 1)
    y = nn.pool_forward(x)
    assert y.ravel().tolist() == [5, 2]
    d = nn.pool_backward(x, y, np.array([3, 4], dtype=np.float32).reshape(y.shape))
    assert d.reshape(3, 5).tolist() == [[0, 3, 4, 0, 0], [0] * 5, [0] * 5] and d.dtype == np.float32


def test_first_layer_makes_no_input_gradient(monkeypatch):
    """Nobody reads the gradient of the pictures themselves."""
    asked = []
    whole = nn.conv_backward
    monkeypatch.setattr(nn, "conv_backward", lambda *a, **b: asked.append(b.get("inputs", True)) or whole(*a, **b))
    layers, shape = [{"type": "conv", "out": 2, "k": 3}, {"type": "conv", "out": 2, "k": 3}, {"type": "output", "out": 2}], (6, 6, 1)
    p = nn.formula_parameters(layers, shape)
    pr, cache = nn.forward(p, layers, shape, np.arange(72.0).reshape(2, 36) / 72, keep=True)
    grads = nn.backward(p, layers, cache, pr, np.eye(2))
    assert asked == [True, False] and grads.keys() == p.keys()


def test_classifier_decodes_pictures_once(spark, tmp_path, monkeypatch):
    from tessera.plans import catalog
    rows = [(i, [float(i % 7 - 3) / 4] * 64, i % 2) for i in range(6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))

    class Seen(Exception):
        pass

    def stop(images, **_):
        raise Seen(images)
    monkeypatch.setattr(catalog.prepare, "prepare_samples", stop)
    try:
        catalog.QUERIES["train_classifier"](spark, str(tmp_path))
    except Seen as e:
        images = e.args[0]
    assert images.count() == 6
    assert "InPandas" not in images._jdf.queryExecution().executedPlan().toString()


def test_convolution_in_blocks_keeps_memory_and_results(monkeypatch):
    rng = np.random.default_rng(1)
    x, W, b = rng.normal(size=(7, 9, 8, 3)), rng.normal(size=(5, 3, 3, 3)), rng.normal(size=5)
    y = nn.conv_forward(x, W, b)
    grads = nn.conv_backward(x, W, y)
    made = []
    windows = nn._windows
    monkeypatch.setattr(nn, "_windows", lambda *a: made.append(windows(*a)) or made[-1])
    monkeypatch.setattr(nn, "WINDOW_BYTES", 2 * 7 * 6 * 27 * 8)  # two pictures
    assert np.allclose(nn.conv_forward(x, W, b), y, atol=1e-12)
    assert all(np.allclose(p, q, atol=1e-12) for p, q in zip(nn.conv_backward(x, W, y), grads))
    assert len(made) == 8 and max(m.nbytes for m in made) <= nn.WINDOW_BYTES
