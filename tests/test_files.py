import glob
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.sources.files import StagedFilesWriter, write_files


def files(path):
    return sorted(os.path.relpath(f, path) for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f))


def rows(spark, n, bad=None):
    name = F.concat(F.col("id").cast("string"), F.lit(".bin"))
    data = F.encode(F.concat(F.lit("data"), F.col("id")), "utf-8")
    if bad is not None:
        data = F.when(F.col("id") == bad, F.lit(None)).otherwise(data)
    return spark.range(0, n, 1, 4).select((F.col("id") % 3).alias("folder"), name.alias("name"), data.alias("data"))


def test_all_rows_become_files(spark, tmp_shared):
    path = tmp_shared("files")
    write_files(rows(spark, 50), path)
    assert files(path) == sorted([f"{i % 3}/{i}.bin" for i in range(50)] + ["_SUCCESS"])
    assert open(f"{path}/1/7.bin", "rb").read() == b"data7"
    assert not glob.glob(f"{path}.staging*")
    with pytest.raises(ValueError, match="already"):
        write_files(rows(spark, 1), path)
    write_files(rows(spark, 2), path, mode="overwrite")
    assert files(path) == ["0/0.bin", "1/1.bin", "_SUCCESS"]
    write_files(rows(spark, 0), tmp_shared("none"))


def test_a_task_that_fails_half_way_leaves_no_file(spark, tmp_shared):
    path = tmp_shared("files")
    write_files(rows(spark, 3), path)
    for mode, target in (("error", tmp_shared("fresh")), ("overwrite", path)):
        with pytest.raises(Exception, match="no file can be written"):
            write_files(rows(spark, 400, bad=399), target, mode=mode)
        assert not glob.glob(f"{target}.staging*")
    assert not os.path.exists(target) or files(path) == ["0/0.bin", "1/1.bin", "2/2.bin", "_SUCCESS"]


def test_an_attempt_that_ran_twice_counts_once(spark, tmp_shared):
    staging = tmp_shared("staging")
    batch = pa.record_batch({"folder": ["a", "a"], "name": ["1", "2"], "data": [b"x", b"y"]})
    writer = StagedFilesWriter(staging)
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.folder != kept.folder
    writer.commit([kept])
    from tessera.sources import files as module
    base = tmp_shared("out")
    os.makedirs(base)
    assert module._publish(spark, staging, base) == 2 and files(base) == ["a/1", "a/2"]
    assert module._publish(spark, staging, base) == 2 and files(base) == ["a/1", "a/2"]  # moved already: nothing to do
    writer.abort([])
    assert not os.path.exists(staging)


def test_two_rows_with_one_name_raise(spark, tmp_shared):
    with pytest.raises(Exception, match="already"):
        write_files(rows(spark, 2).unionByName(rows(spark, 2)), tmp_shared("twice"))
