import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import extract
from tessera.sources import bson as B
from tessera.sources.fs import write_bytes


def test_bson_hand_built(spark, tmp_shared):
    path = tmp_shared("bson")
    docs = [{"_id": 10, "category_id": 1000012, "imgs": [{"picture": b"\xff\xd8x"}, {"picture": b"y"}]},
            {"_id": 11, "category_id": 1000012, "imgs": [{"picture": b"z"}]},
            {"_id": 12, "category_id": 7, "imgs": []}]
    write_bytes(f"{path}/a.bson", b"".join(B.encode_document(d) for d in docs[:2]))
    write_bytes(f"{path}/b.bson", B.encode_document(docs[2]))
    recs = B.read_bson(spark, path, range_bytes=16).orderBy("pos")
    rows = recs.collect()
    assert [(r["_id"], r["category_id"], r["pos"]) for r in rows] == [("10", "1000012", 0), ("11", "1000012", 1), ("12", "7", 2)]
    good = extract.parse_records(recs.filter("pos < 2")).orderBy("pos").collect()
    assert bytes(good[0]["picture"]) == b"\xff\xd8x"
    with pytest.raises(Exception, match="record without pictures"):
        extract.parse_records(recs).collect()


def test_bson_split_inside_a_file(spark, tmp_shared):
    path = tmp_shared("bson")
    docs = [{"_id": i, "category_id": i % 5, "imgs": [{"picture": bytes([i % 256]) * (i % 300)}], "when": i} for i in range(700)]
    write_bytes(f"{path}/a.bson", b"".join(map(B.encode_document, docs)))
    write_bytes(f"{path}/_temporary/0/x.bson", b"junk")
    for size in (64, 1000, 50_000, 1 << 20):
        plan = B.plan_ranges(spark, path, size)
        assert all(r["file"].startswith("file:") for r in plan) and (size > 50_000) == (len(plan) == 1)
        rows = B.read_bson(spark, path, range_bytes=size).select("_id", "pos").collect() if size > 500 else []
        assert sorted((r["pos"], int(r["_id"])) for r in rows) == [(i, i) for i in range(700)][:len(rows) or 0]
        assert plan[0]["start"] == 0 and all(a["end"] == b["start"] for a, b in zip(plan, plan[1:]))


def test_broken_bson_raises(spark, tmp_shared):
    good = [B.encode_document({"_id": i, "category_id": 1, "imgs": [{"picture": b"x" * 50}]}) for i in range(40)]
    cases = {"junk": b"".join(good) + b"\x00\x00", "cut": b"".join(good)[:-3],
             "length": good[0] + b"\x02\x00\x00\x00" + b"".join(good[1:])}
    for name, data in cases.items():
        for size in (200, 1 << 20):
            path = tmp_shared(f"bson-{name}")
            write_bytes(f"{path}/a.bson", data)
            with pytest.raises(Exception, match="a.bson.*byte"):
                B.read_bson(spark, path, range_bytes=size).collect()


def misleading(inner_docs):
    """Records whose pictures are chains of documents themselves, longer than several ranges."""
    out = []
    for i in range(60):
        inner = b"".join(B.encode_document({"_id": j, "x": "y" * (j % 7)}) for j in range(inner_docs if i % 3 == 0 else 3))
        out.append(B.encode_document({"_id": i, "category_id": 1, "imgs": [{"picture": inner}]}))
    return b"".join(out)


@pytest.mark.parametrize("size", [100, 700, 5000])
def test_misleading_bytes_are_planned_in_tasks(spark, tmp_shared, monkeypatch, size):
    path = tmp_shared("bson")
    data = misleading(300 if size > 100 else 40)
    write_bytes(f"{path}/a.bson", data)
    write_bytes(f"{path}/b.bson", misleading(5))
    write_bytes(f"{path}/empty.bson", b"")

    def no_file(name):
        raise AssertionError(f"the driver opens {name}")
    with monkeypatch.context() as m:
        m.setattr(B, "filesystem", no_file)  # tasks import their own
        plan = B.plan_ranges(spark, path, size)
    assert [p["start"] for p in plan if p["file"].endswith("a.bson")][0] == 0
    at, first, starts = 0, {}, set()
    for k in range(60):
        starts.add(at)
        first[at] = k
        at += int.from_bytes(data[at:at + 4], "little")
    for p in plan:
        if p["file"].endswith("a.bson"):
            assert p["start"] in starts and p["first"] == first[p["start"]]
    whole = [p for p in plan if p["file"].endswith("a.bson")]
    assert whole[-1]["end"] == len(data) and all(x["end"] == y["start"] for x, y in zip(whole, whole[1:]))
    if size > 100:
        rows = B.read_bson(spark, path, range_bytes=size).select("_id", "pos").collect()
        assert sorted((r["pos"], int(r["_id"])) for r in rows) == [(i, i % 60) for i in range(120)]


def test_undecodable_pictures_and_luminance(spark, tmp_shared):
    from tessera.sources.images import load_images, png_bytes
    path = tmp_shared("img")
    write_bytes(f"{path}/a/1.png", png_bytes(np.full((2, 2), 7, np.uint8)))
    write_bytes(f"{path}/a/2.ppm", b"P6\n1 1\n255\n" + b"abc")
    write_bytes(f"{path}/a/3.png", b"broken")
    with pytest.raises(Exception, match="cannot|can be decoded"):
        load_images(spark, path, 2, 2, 1).collect()
    rows = {r["path"][-5:]: r["pixels"] for r in load_images(spark, path, 2, 2, 1, invalid="null").collect()}
    assert rows == {"1.png": [7] * 4, "2.ppm": None, "3.png": None}
    color = bytes([0x89]) + png_bytes(np.zeros((1, 1), np.uint8))[1:]
    assert color.startswith(b"\x89PNG")


def test_png_load_and_scan(spark, tmp_shared):
    from tessera.sources.images import load_images, png_bytes, scan_images
    path = tmp_shared("img")
    g = (np.arange(16).reshape(4, 4) * 10).astype(np.uint8)
    write_bytes(f"{path}/cat/1.png", png_bytes(g))
    write_bytes(f"{path}/dog/2.png", png_bytes(g[::-1].copy()))
    write_bytes(f"{path}/dog/notes.txt", b"x")
    files = scan_images(spark, path).collect()
    assert sorted(r["label"] for r in files) == ["cat", "dog"]
    imgs = {r["label"]: r["pixels"] for r in load_images(spark, path, 4, 4, 3).collect()}
    assert imgs["cat"][:3] == [0, 0, 0] and imgs["cat"][-3:] == [150, 150, 150]
    assert len(imgs["dog"]) == 48


def test_gpu_log_text_order(spark, tmp_shared):
    from tessera.sources.textlog import read_gpu_log, write_lines
    n = 5000
    df = spark.range(n).select(F.col("id").alias("line_no"), F.col("id").cast("string").alias("value"))
    path = write_lines(df, tmp_shared("log"), parts=7)
    got = read_gpu_log(spark, path).orderBy("line_no").collect()
    assert [int(r["value"]) for r in got] == list(range(n))
    assert [r["line_no"] for r in got] == list(range(n))


def test_sinks(spark, tmp_shared):
    from tessera.sources.sinks import write_by_category, write_report
    pics = spark.createDataFrame([(1, "5.jpg", b"ab"), (2, "6.jpg", b"cd")],
                                 "category_id int, name string, picture binary")
    p = write_by_category(pics, tmp_shared("cat"), fmt="files")
    with open(f"{p}/2/6.jpg".replace("file:", ""), "rb") as f:
        assert f.read() == b"cd"
    q = write_by_category(pics, tmp_shared("catpq"))
    assert spark.read.parquet(q).filter("category_id = 1").first()["name"] == "5.jpg"
    lines = spark.createDataFrame([("cates", 1, 0, "1,2"), ("ids", 4, 9, "4,9"), ("ids", 4, 7, "4,7"), ("ids", 3, 8, "3,8")],
                                  "report string, category_id int, seq long, line string")
    r = write_report(lines, tmp_shared("rep"))
    assert spark.read.text(f"{r}/report=cates").first()["value"] == "1,2"
    assert [x["value"] for x in spark.read.text(f"{r}/report=ids").collect()] == ["3,8", "4,7", "4,9"]


def test_dataset_roundtrip_and_split_pruning(spark, tmp_shared):
    from tessera.operators import prepare
    from tessera.sources.dataset import read_dataset, write_dataset
    rows = [(i, i % 3, [float(i)] * 4) for i in range(30)]
    imgs = spark.createDataFrame(rows, "id long, label int, pixels array<float>")
    samples, bal = prepare.prepare_samples(imgs, batch=4)
    path = write_dataset(samples, tmp_shared("ds"), parts=3)
    back = read_dataset(spark, path, split="test")
    assert back.count() == bal.n - bal.n_train
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "split" in plan
    assert read_dataset(spark, path).count() == bal.n


def test_write_rebalanced(spark, tmp_shared):
    from tessera.operators import rebalance as R
    from tessera.sources.sinks import write_rebalanced
    rows = [("a", f"a{i}", [float(i)] * 4) for i in range(3)] + [("b", "b0", [2.0] * 4)]
    df = spark.createDataFrame(rows, "label string, name string, pixels array<double>")
    p = write_rebalanced(R.rebalance_images(df, 2, 2, 1, target=3), tmp_shared("rb"))
    back = spark.read.parquet(p)
    assert back.count() == 6 and back.filter("label = 'b' AND generated").count() == 2
