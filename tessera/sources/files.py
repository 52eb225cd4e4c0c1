"""A file per row, written all or not at all (S7, S9 and picture fixtures).

1. Tasks write rows ``(folder, name, data)`` through a Python Data Source
   *writer* into a staging folder beside the target, each attempt into a folder
   of its own.  Its commit lists the folders of the attempts that count (one
   line a task); its abort removes the staging folder.  A task that fails
   half-way or runs twice leaves nothing that is read.
2. Files of committed attempts are moved to ``<path>/<folder>/<name>`` by a
   Spark job, one committed folder a row.  A move that was done is not there to
   be done again, so lost executors and retries do no harm.  ``_SUCCESS`` is
   written last.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessera.sources.fs import filesystem, qualify, write_bytes

COMMITTED = "_committed.json"


@dataclass
class _Attempt(WriterCommitMessage):
    folder: str
    files: int


class StagedFilesWriter(DataSourceArrowWriter):
    """Writes each attempt's files below ``<staging>/<attempt>/``."""

    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator) -> _Attempt:
        task = TaskContext.get()
        attempt = f"{task.partitionId():05d}-{task.taskAttemptId()}" if task else uuid.uuid4().hex
        n = 0
        try:
            for batch in iterator:
                for folder, name, data in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "data")), strict=True):
                    if not folder or not name or data is None or "/" in name or name[0] in "._":
                        raise ValueError(f"no file can be written for folder {folder!r}, name {name!r}")
                    write_bytes(f"{self.staging}/{attempt}/{folder}/{name}", data)
                    n += 1
        except BaseException:
            _remove(f"{self.staging}/{attempt}")
            raise
        return _Attempt(attempt, n)

    def commit(self, messages) -> None:
        folders = [[m.folder, m.files] for m in messages if m is not None and m.files]
        write_bytes(f"{self.staging}/{COMMITTED}", json.dumps(folders).encode())

    def abort(self, messages) -> None:
        _remove(self.staging)


class StagedFiles(DataSource):
    """``df.write.format("staged_files").option("path", staging)`` for columns folder, name, data."""

    @classmethod
    def name(cls):
        return "staged_files"

    def writer(self, schema, overwrite):
        return StagedFilesWriter(self.options["path"])


def _remove(path: str) -> None:
    fs, p = filesystem(path)
    if fs.get_file_info(p).type == pafs.FileType.Directory:
        fs.delete_dir(p)


def _publish(spark: SparkSession, staging: str, base: str) -> int:
    """Move the committed attempts' files to their places; returns how many there are."""
    fs, p = filesystem(f"{staging}/{COMMITTED}")
    with fs.open_input_stream(p) as f:
        folders = json.loads(f.read())
    if not folders:
        return 0

    def move(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            n = 0
            for folder in pdf["folder"]:
                fs, root = filesystem(f"{staging}/{folder}")
                _, target = filesystem(base)
                for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
                    if info.type != pafs.FileType.File:
                        continue
                    to = f"{target}/{info.path[len(root):].lstrip('/')}"
                    if fs.get_file_info(to).type != pafs.FileType.NotFound:
                        raise ValueError(f"{to} is there already: two rows have one folder and name")
                    fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
                    fs.move(info.path, to)
                    n += 1
            yield pd.DataFrame({"n": [n]})

    tasks = min(len(folders), 4 * spark.sparkContext.defaultParallelism)
    spark.createDataFrame(folders, "folder string, files long").repartition(tasks).mapInPandas(move, "n long").agg({"n": "sum"}).collect()
    return sum(n for _, n in folders)


def write_files(df: DataFrame, path: str, folder: str = "folder", name: str = "name", data: str = "data", mode: str = "error") -> str:
    """Write every row's bytes as ``<path>/<folder>/<name>``.

    All rows become files, or none does: until every task has succeeded nothing
    shows below ``path``, and an earlier set stays (``mode="overwrite"``
    replaces it then; ``"error"`` raises if there is one).  Two rows with one
    folder and name, an empty or null part of a name, and null bytes raise.  No
    rows give an empty folder.
    """
    if mode not in ("error", "overwrite"):
        raise ValueError(f"mode: {mode}")
    spark = df.sparkSession
    spark.dataSource.register(StagedFiles)
    base = qualify(spark, path).rstrip("/")
    staging = f"{base}.staging-{uuid.uuid4().hex}"
    fs, target = filesystem(base)
    if mode == "error" and fs.get_file_info(target).type != pafs.FileType.NotFound:
        raise ValueError(f"{base} is there already")
    rows = df.selectExpr(f"CAST(`{folder}` AS STRING) AS folder", f"CAST(`{name}` AS STRING) AS name", f"`{data}` AS data")
    try:
        rows.write.format("staged_files").option("path", staging).mode("append").save()
    except BaseException:
        _remove(staging)  # also where the job never came to its abort
        raise
    _remove(base)
    fs.create_dir(target, recursive=True)
    _publish(spark, staging, base)
    write_bytes(f"{base}/_SUCCESS", b"")
    _remove(staging)
    return path


__all__ = ["write_files", "StagedFiles", "StagedFilesWriter"]
