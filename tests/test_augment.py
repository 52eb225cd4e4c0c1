import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_unit
from tessera.operators import augment as AUG

ONE = 65536


def mixed(img, y, x, last_y, last_x):
    """One pixel (all channels) at a position in 2**-16, by whole numbers."""
    y0, x0, fy, fx = y // ONE, x // ONE, y % ONE, x % ONE
    y1, x1 = min(y0 + 1, last_y), min(x0 + 1, last_x)
    return (img[y0, x0] * ((ONE - fy) * (ONE - fx)) + img[y0, x1] * ((ONE - fy) * fx) + img[y1, x0] * (fy * (ONE - fx)) + img[y1, x1] * (fy * fx)) / ONE**2


def single(img, st, u):
    """One step on one picture, pixel by pixel."""
    h, w = img.shape[:2]
    op = st["op"]
    if op == "flip_left_right" or (op == "flip_random" and u[1] < 0.5):
        return img[:, ::-1]
    if op in ("flip_top_bottom", "flip_random"):
        return img[::-1]
    if op in ("rotate180", "rotate270", "rotate_random_90"):
        return np.rot90(img, {"rotate180": 2, "rotate270": 3}.get(op, 1 + int(u[1] * 3)))
    fixed = lambda x: math.floor(x * ONE + 0.5)
    clip = lambda x, hi: min(max(x, 0), hi * ONE)
    out = np.empty_like(img)
    if op == "crop_random":
        ch, cw = max(1, int(h * math.sqrt(st["area"]))), max(1, int(w * math.sqrt(st["area"])))
        top, left = int(u[1] * (h - ch + 1)), int(u[2] * (w - cw + 1))
        for r in range(h):
            for c in range(w):
                y = clip(((2 * r + 1) * ch - h) * ONE // (2 * h), ch - 1) + top * ONE
                x = clip(((2 * c + 1) * cw - w) * ONE // (2 * w), cw - 1) + left * ONE
                out[r, c] = mixed(img, y, x, top + ch - 1, left + cw - 1)
        return out
    if op == "zoom":
        k = fixed(1 / (st["lo"] + u[1] * (st["hi"] - st["lo"])))
        m = (k, 0, 0, k)
    else:
        angle = math.radians(-st["left"] + u[1] * (st["left"] + st["right"]))
        if op == "rotate":
            m = (fixed(math.cos(angle)), -fixed(math.sin(angle)), fixed(math.sin(angle)), fixed(math.cos(angle)))
        else:
            t = fixed(math.tan(angle))
            m = (ONE, 0, t, ONE) if u[2] < 0.5 else (ONE, t, 0, ONE)
    for r in range(h):
        for c in range(w):
            dy, dx = 2 * r - (h - 1), 2 * c - (w - 1)
            out[r, c] = mixed(img, clip(((h - 1) * ONE + m[0] * dy + m[1] * dx) // 2, h - 1), clip(((w - 1) * ONE + m[2] * dy + m[3] * dx) // 2, w - 1), h - 1, w - 1)
    return out


def pipeline(img, steps, draws):
    for st, u in zip(steps, draws):
        if u[0] < st["p"]:
            img = single(img, st, u)
    return img


def test_batched_equals_single_pictures():
    rng = np.random.default_rng(5)
    for shape in [(8, 8, 1), (6, 6, 3), (4, 7, 2), (1, 1, 1)]:
        steps = [s for s in AUG.DEFAULT_STEPS if shape[0] == shape[1] or s["op"] not in AUG.QUARTERS]
        imgs = rng.normal(size=(40, *shape))
        draws = rng.random(size=(40, len(steps), AUG.N_DRAWS))
        batch = AUG.apply_steps_batch(imgs, steps, draws)
        for i in range(40):
            assert np.array_equal(batch[i], pipeline(imgs[i], steps, draws[i])), (shape, i)


def test_resampling_keeps_a_constant_picture_and_the_middle():
    u = np.random.default_rng(1).random((20, AUG.N_DRAWS))
    for st in AUG.DEFAULT_STEPS:
        assert np.allclose(AUG.batch_step(np.full((20, 9, 9, 1), 3.5), st, u), 3.5)
    imgs = np.random.default_rng(2).normal(size=(20, 9, 9, 1))
    for op in ("rotate", "shear", "zoom"):
        st = next(s for s in AUG.DEFAULT_STEPS if s["op"] == op)
        assert np.array_equal(AUG.batch_step(imgs, st, u)[:, 4, 4], imgs[:, 4, 4])


def test_quarter_turn_of_a_picture_that_is_not_square_raises(spark):
    img, u = np.zeros((1, 4, 7, 2)), np.zeros((1, AUG.N_DRAWS))
    with pytest.raises(ValueError, match="square"):
        AUG.batch_step(img, {"op": "rotate270"}, u)
    assert AUG.batch_step(img, {"op": "rotate180"}, u).shape == (1, 4, 7, 2)
    df = spark.createDataFrame([(1, [0.0] * 6)], "id long, pixels array<double>")
    with pytest.raises(ValueError, match="square"):
        AUG.augment(df, 2, 3, 1)


@pytest.mark.parametrize("shape", [(4, 4, 2), (2, 3, 3), (1, 5, 1)])
def test_composed_symmetries_equal_the_steps_one_by_one(spark, shape):
    h, w, c = shape
    rng = np.random.default_rng(h)
    ops = sorted(AUG.SYMMETRIES - (AUG.QUARTERS if h != w else set()))
    steps = [{"op": ops[i], "p": 0.6} for i in rng.integers(0, len(ops), 9)]
    imgs = {i: rng.integers(0, 255, h * w * c).astype(float).tolist() for i in range(60)}
    df = spark.createDataFrame(list(imgs.items()), "id long, pixels array<double>")
    out = AUG.augment(df, h, w, c, steps, seed=7)
    assert "Python" not in out._jdf.queryExecution().toString()
    draws = df.select("id", F.array(*[hash_unit(7, "id", F.lit(s), F.lit(k)) for s in range(len(steps)) for k in range(3)]).alias("u"))
    u = {r.id: np.array(r.u).reshape(-1, 3) for r in draws.collect()}
    for r in out.collect():
        assert r.pixels == pipeline(np.array(imgs[r.id]).reshape(shape), steps, u[r.id]).ravel().tolist()


def test_seeded(spark):
    df = spark.createDataFrame([(i, [float(i)] * 16) for i in range(20)], "id long, pixels array<double>")
    a = {r["id"]: r["pixels"] for r in AUG.augment(df, 4, 4, 1, seed=3).collect()}
    b = {r["id"]: r["pixels"] for r in AUG.augment(df.repartition(3), 4, 4, 1, seed=3).collect()}
    assert a == b and len(a) == 20
