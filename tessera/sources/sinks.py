"""Sinks: pictures per category (S7), text reports (S8), rebalanced set."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.sources.files import write_files


def write_by_category(pictures: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Pictures in one folder per category.

    ``pictures`` should be de-duplicated first (``extract.last_per_id``), so
    each ``(category_id, name)`` is written once.  ``fmt="parquet"`` writes
    ``category_id=<k>/`` Parquet folders; ``fmt="files"`` writes the raw
    bytes as ``<path>/<category_id>/<name>``, all files or none.
    """
    if fmt == "parquet":
        # range-partitioned by (category, name): a task's categories are
        # contiguous (files ~ tasks + categories) and a hot category is split
        pictures.select("category_id", "name", "picture").repartitionByRange("category_id", "name") \
            .write.mode(mode).partitionBy("category_id").parquet(path)
        return path
    return write_files(pictures, path, folder="category_id", name="name", data="picture", mode=mode)


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Report lines as text, one folder per report; lines keep the order
    of ``(category_id, seq)`` over its files."""
    (lines.repartitionByRange("report", "category_id", "seq").sortWithinPartitions("report", "category_id", "seq")
     .select("report", "line").write.mode(mode).partitionBy("report").text(path))
    return path


def write_rebalanced(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Originals beside generated pictures, one folder per class
    (range-partitioned by class and name first, so files stay about tasks +
    classes and a hot class is written by several tasks)."""
    df.repartitionByRange("label", "name").write.mode(mode).partitionBy("label").parquet(path)
    return path
