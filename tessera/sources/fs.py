"""Small file-system helpers that work inside tasks (local, HDFS, S3, ... via
pyarrow.fs), so executors read and write shared files themselves."""

from __future__ import annotations

import pyarrow.fs as pafs


def filesystem(path: str):
    """``(filesystem, path inside it)`` for a URI or a local path."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
        return pafs.LocalFileSystem(), path
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def write_bytes(path: str, data: bytes) -> None:
    fs, p = filesystem(path)
    parent = p.rsplit("/", 1)[0]
    if parent:
        fs.create_dir(parent, recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(data)


def qualify(spark, path: str) -> str:
    """``path`` as Spark resolves it: with its scheme, on ``fs.defaultFS`` where it names none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def list_files(spark, path: str, suffix: str = "") -> list[tuple[str, int]]:
    """Qualified names and sizes of the files below ``path``, in name order;
    files and folders that begin with ``_`` or ``.`` are left out."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(p).toString()
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        name = f.getPath().toString()
        inside = name[len(base):].strip("/").split("/")
        if name.endswith(suffix) and not any(x.startswith(("_", ".")) for x in inside):
            found.append((name, f.getLen()))
    return sorted(found)
