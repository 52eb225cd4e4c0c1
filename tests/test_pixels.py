import numpy as np
import pytest

from tessera.functions import pixels as PX


@pytest.fixture(scope="module")
def img_df(spark):
    rng = np.random.default_rng(1)
    arrs = [rng.integers(0, 255, size=2 * 3 * 3).astype(float).tolist() for _ in range(4)]
    return spark.createDataFrame([(i, a) for i, a in enumerate(arrs)], "id int, px array<double>"), arrs


def test_against_numpy(spark, img_df):
    df, arrs = img_df
    h, w, c = 2, 3, 3
    cases = {
        "lr": (PX.flip_left_right("px", h, w, c), lambda a: a[:, ::-1]),
        "tb": (PX.flip_top_bottom("px", h, w, c), lambda a: a[::-1]),
        "180": (PX.rotate180("px", h, w, c), lambda a: np.rot90(a, 2)),
        "90": (PX.rotate90("px", h, w, c), lambda a: np.rot90(a, 1)),
        "270": (PX.rotate270("px", h, w, c), lambda a: np.rot90(a, 3)),
    }
    for name, (col, ref) in cases.items():
        got = {r["id"]: r["o"] for r in df.select("id", col.alias("o")).collect()}
        for i, a in enumerate(arrs):
            assert got[i] == ref(np.array(a).reshape(h, w, c)).ravel().tolist(), name


def test_flip_inverse_and_four_turns(spark, img_df):
    df, arrs = img_df
    twice = df.select("id", PX.flip_left_right(PX.flip_left_right("px", 2, 3, 3), 2, 3, 3).alias("o"))
    assert {r["id"]: r["o"] for r in twice.collect()} == dict(enumerate(arrs))
    sq = df.sparkSession.createDataFrame([(0, list(map(float, range(9))))], "id int, px array<double>")
    c = PX.rotate90("px", 3, 3, 1)
    for _ in range(3):
        c = PX.rotate90(c, 3, 3, 1)
    assert sq.select(c.alias("o")).first()["o"] == list(map(float, range(9)))
