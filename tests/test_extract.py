import pytest
from pyspark.sql import functions as F

from tessera.operators import extract

SCHEMA = "_id string, category_id string, imgs array<struct<picture:binary>>, pos long"


def recs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_first_picture_wins_and_names(spark):
    df = recs(spark, [("7", "3", [(b"a",), (b"b",)], 0)])
    r = extract.parse_records(df).first()
    assert (r["_id"], r["category_id"], r["name"], bytes(r["picture"])) == (7, 3, "7.jpg", b"a")


def test_empty_pictures_raise(spark):
    with pytest.raises(Exception, match="record without pictures"):
        extract.parse_records(recs(spark, [("1", "2", [], 0)])).collect()


def test_non_numeric_category_raises(spark):
    with pytest.raises(Exception, match="not an integer"):
        extract.parse_records(recs(spark, [("1", "x", [(b"a",)], 0)])).collect()


@pytest.mark.parametrize("bad", [None, " 12 ", "1.0", "", "99999999999"])
def test_what_parse_int_refuses_raises(spark, bad):
    with pytest.raises(Exception, match="not an integer"):
        extract.parse_records(recs(spark, [(bad, "2", [(b"a",)], 0)])).collect()


def test_name_is_the_raw_id(spark):
    r = extract.parse_records(recs(spark, [("007", "+2", [(b"a",)], 0)])).first()
    assert (r["_id"], r["category_id"], r["name"]) == (7, 2, "007.jpg")


def test_duplicates_counted_twice_one_kept(spark):
    df = extract.parse_records(recs(spark, [("1", "2", [(b"a",)], 0), ("1", "2", [(b"b",)], 1),
                                            ("5", "2", [(b"c",)], 2)]))
    assert extract.category_counts(df).first()["n"] == 3
    last = {r["_id"]: bytes(r["picture"]) for r in extract.last_per_id(df).collect()}
    assert last == {1: b"b", 5: b"c"}
    ids = extract.category_ids(df).orderBy("category_id", "pos").collect()
    assert [tuple(r) for r in ids] == [(2, 0, 1), (2, 1, 1), (2, 2, 5)]
    t = extract.totals(df).first()
    assert (t["n_pictures"], t["n_categories"]) == (3, 1)


@pytest.mark.parametrize("n", [0, 1, 10_000, 10_001])
def test_progress_rows(spark, n):
    df = spark.range(n).select(F.col("id").alias("pos"), (F.col("id") % 7).cast("int").alias("category_id"))
    rows = sorted(tuple(r) for r in extract.progress(df, every=10_000).collect())
    expected = []
    for k in range(0, n, 10_000):
        expected.append((k, k, min(k, 7)))
    assert rows == expected


def test_report_lines(spark):
    df = extract.parse_records(recs(spark, [("1", "2", [(b"a",)], 0), ("3", "4", [(b"b",)], 1)]))
    lines = {(r["report"], r["line"]) for r in extract.report_lines(df).collect()}
    assert ("count", "number of pictures: 2, number of category: 2") in lines
    assert ("cates", "2,1") in lines and ("ids", "4,3") in lines


def test_progress_with_gaps_in_pos(spark):
    df = spark.range(25).select((F.col("id") * 3 + 5).alias("pos"), (F.col("id") % 4).cast("int").alias("category_id"))
    rows = sorted(tuple(r) for r in extract.progress(df, every=10, dense_pos=False, pos_bucket=16).collect())
    assert rows == [(0, 0, 0), (10, 10, 4), (20, 20, 4)]
