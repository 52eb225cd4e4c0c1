"""BSON product records as a parallel Spark scan.

A dump is a sequence of BSON documents, each starting with its int32 length.
``read_bson`` first plans ranges of whole documents, all of it in tasks:

1. each byte range of about ``range_bytes`` finds every chain of documents that
   begins in its first 16 MB and survives to the range's end.  The true chain is
   among them, and so may be chains through bytes that only look like documents;
2. a chain's end is a place where the next range may begin.  Each such place is
   a node, with the place where its own chain ends and the documents between;
3. the nodes on the path from byte 0 are found by pointer doubling: in every
   round the path's known nodes add the ones twice as far away, with the number
   of documents before them.  So the rounds are the logarithm of the ranges.

A Python Data Source then decodes every range in its own task.  ``pos`` is the
0-based record number over all files in name order.  A broken or cut-off record
raises, naming the file and the byte.
"""

from __future__ import annotations

import json
import struct
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.session import shared_path
from tessera.sources.fs import filesystem, list_files, qualify, write_bytes

RECORD_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("category_id", T.StringType()),
    T.StructField("imgs", T.ArrayType(T.StructType([T.StructField("picture", T.BinaryType())]))),
    T.StructField("pos", T.LongType()),
])

RANGE_BYTES = 256 << 20  # about 400k ranges for 100 TB of dumps

# --- a minimal decoder/encoder for the element types records use -------------------

# Element types without a value: undefined, null, smallest and largest key.
_EMPTY = frozenset([0x06, 0x0A, 0xFF, 0x7F])


def _cstring(b: bytes, i: int) -> tuple[str, int]:
    j = b.index(b"\x00", i)
    return b[i:j].decode("utf-8"), j + 1


def decode_document(b: bytes, i: int = 0) -> tuple[dict, int]:
    """Decode the document at ``i``; returns (dict, index after it)."""
    (n,) = struct.unpack_from("<i", b, i)
    end = i + n
    i += 4
    out = {}
    while i < end - 1:
        t = b[i]
        name, i = _cstring(b, i + 1)
        if t == 0x01:
            out[name] = struct.unpack_from("<d", b, i)[0]; i += 8
        elif t in (0x02, 0x0D, 0x0E):
            (ln,) = struct.unpack_from("<i", b, i)
            out[name] = b[i + 4:i + 4 + ln - 1].decode("utf-8"); i += 4 + ln
        elif t in (0x03, 0x04):
            doc, i = decode_document(b, i)
            out[name] = list(doc.values()) if t == 0x04 else doc
        elif t == 0x05:
            (ln,) = struct.unpack_from("<i", b, i)
            out[name] = bytes(b[i + 5:i + 5 + ln]); i += 5 + ln
        elif t == 0x08:
            out[name] = b[i] != 0; i += 1
        elif t == 0x10:
            out[name] = struct.unpack_from("<i", b, i)[0]; i += 4
        elif t == 0x12:
            out[name] = struct.unpack_from("<q", b, i)[0]; i += 8
        elif t == 0x07:
            out[name] = b[i:i + 12].hex(); i += 12
        elif t in (0x09, 0x11):  # date (milliseconds) and timestamp, as numbers
            out[name] = struct.unpack_from("<q", b, i)[0]; i += 8
        elif t in _EMPTY:
            out[name] = None
        else:
            raise ValueError(f"unsupported BSON element type {t:#x}")
    return out, end


def _enc_value(v) -> tuple[int, bytes]:
    if isinstance(v, bool):
        return 0x08, b"\x01" if v else b"\x00"
    if isinstance(v, int):
        if -2**31 <= v < 2**31:
            return 0x10, struct.pack("<i", v)
        return 0x12, struct.pack("<q", v)
    if isinstance(v, float):
        return 0x01, struct.pack("<d", v)
    if isinstance(v, str):
        s = v.encode("utf-8") + b"\x00"
        return 0x02, struct.pack("<i", len(s)) + s
    if isinstance(v, (bytes, bytearray)):
        return 0x05, struct.pack("<i", len(v)) + b"\x00" + bytes(v)
    if isinstance(v, dict):
        return 0x03, encode_document(v)
    if isinstance(v, (list, tuple)):
        return 0x04, encode_document({str(i): x for i, x in enumerate(v)})
    if v is None:
        return 0x0A, b""
    raise TypeError(type(v))


def encode_document(d: dict) -> bytes:
    body = b"".join(bytes([t]) + k.encode("utf-8") + b"\x00" + data
                    for k, (t, data) in ((k, _enc_value(v)) for k, v in d.items()))
    return struct.pack("<i", len(body) + 5) + body + b"\x00"


# --- planning job: byte ranges per file ----------------------------------------------

# The largest document the format's server accepts, and the element types.
MAX_DOCUMENT = (16 << 20) + (16 << 10)
_TYPES = frozenset([*range(0x01, 0x14), 0x7F, 0xFF])
# Bytes looked through at once for places where a document may begin.
LOOK = 1 << 20


def _length(f, at: int, size: int) -> int | None:
    """Length of the document at ``at``, or None if there can be none."""
    if at + 5 > size:
        return None
    f.seek(at)
    head = f.read(5)
    (n,) = struct.unpack("<i", head[:4])
    if not 5 <= n <= MAX_DOCUMENT or at + n > size or (head[4] not in _TYPES if n > 5 else head[4] != 0):
        return None
    f.seek(at + n - 1)
    return n if f.read(1) == b"\x00" else None


def _plausible(f, start: int, stop: int, size: int) -> Iterator[int]:
    """Bytes from ``start`` to ``stop`` at which a document may begin, by its length and first element type."""
    kind = np.zeros(256, bool)
    kind[list(_TYPES)] = True
    for at in range(start, stop, LOOK):
        n = min(LOOK, stop - at)
        f.seek(at)
        b = np.frombuffer(f.read(min(n + 4, size - at)), np.uint8)
        m = min(n, len(b) - 4)
        if m <= 0:
            return
        length = b[:m].astype(np.int64) | b[1:m + 1].astype(np.int64) << 8 | b[2:m + 2].astype(np.int64) << 16 | b[3:m + 3].astype(np.int64) << 24
        ok = (length >= 5) & (length <= MAX_DOCUMENT) & (at + np.arange(m) + length <= size)
        ok &= np.where(length > 5, kind[b[4:m + 4]], b[4:m + 4] == 0)
        yield from (at + np.flatnonzero(ok)).tolist()


def _chain(f, start: int, stop: int, size: int, known: dict | None = None, upto: int = 0) -> tuple[int, int, bool]:
    """Hop over documents from ``start`` until ``stop``: (end, documents, whether it got there).

    ``known`` tells of places below ``upto`` whose chain is known; new ones are added.
    """
    at, n = start, 0
    while at < stop:
        if known is not None and at < upto:
            if at in known:
                return -1, n, False  # joins a chain that is judged already
            known[at] = True
        m = _length(f, at, size)
        if m is None:
            return at, n, False
        at, n = at + m, n + 1
    return at, n, True


def _chains(path: str, start: int, stop: int, size: int) -> list[tuple[int, int, int]]:
    """``(first, end, documents)`` of chains in a range: one for each place where a chain from its first
    16 MB may leave the range, among them the true chain's."""
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        if start == 0:
            end, n, whole = _chain(f, 0, stop, size)
            return [(0, end, n)] if whole else []
        upto, known, found = min(stop, start + MAX_DOCUMENT), {}, {}
        for first in _plausible(f, start, upto, size):
            if first not in known:
                end, n, whole = _chain(f, first, stop, size, known, upto)
                if whole and end not in found:
                    found[end] = (first, end, n)
        return list(found.values())


def _node(path: str, at: int, stop: int, size: int) -> tuple[int, int, bool]:
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        return _chain(f, at, stop, size)


def _on_path(nodes: DataFrame) -> DataFrame:
    """Nodes ``(fi, at)`` on the path from at = 0, with ``first``, the documents before them in the file.

    ``nodes`` has fi, at, end and n: one successor each.  Pointer doubling: the
    jump of every node goes twice as far each round, and the path's known nodes
    take one jump more.
    """
    spark = nodes.sparkSession
    jumps = nodes.select("fi", "at", F.col("end").alias("to"), "n")
    path = nodes.where("at = 0").select("fi", "at", F.lit(0).cast("bigint").alias("first"))
    known = 0
    while True:
        reach = path.join(jumps, ["fi", "at"]).select("fi", F.col("to").alias("at"), (F.col("first") + F.col("n")).alias("first"))
        reach = reach.join(nodes.select("fi", "at"), ["fi", "at"], "left_semi")
        path = _written(path.unionByName(reach).distinct(), "path")
        count = path.count()
        if count == known:
            return path
        known = count
        after = jumps.select("fi", F.col("at").alias("to"), F.col("to").alias("__to"), F.col("n").alias("__n"))
        jumps = _written(jumps.join(after, ["fi", "to"]).select("fi", "at", F.col("__to").alias("to"), (F.col("n") + F.col("__n")).alias("n")), "jumps")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, "bson-plans", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> list[dict]:
    """Ranges of whole documents with their first record number.

    The driver lists the files and receives one small row a range; it opens no
    file.  A file whose documents do not reach its end raises, with the byte.
    """
    files = list_files(spark, path)
    cuts = [(i, name, a, min(a + range_bytes, size), size) for i, (name, size) in enumerate(files) for a in range(0, size, range_bytes)]
    if not cuts:
        return []
    tasks = min(len(cuts), spark.sparkContext.defaultParallelism * 4)

    def look(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(fi, *x) for fi, name, a, b, size in pdf.itertuples(index=False) for x in _chains(name, a, b, size)]
            yield pd.DataFrame(rows, columns=["fi", "at", "end", "n"])

    def hop(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(fi, at, *_node(name, at, b, size)) for fi, at, name, b, size in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["fi", "at", "end", "n", "whole"])

    listing = _written(spark.createDataFrame(cuts, "fi long, file string, start long, stop long, size long").repartition(tasks), "cuts")
    chains = _written(listing.mapInPandas(look, "fi long, at long, end long, n long"), "chains")
    # a node is a place where a chain ends, and the first byte; most are the first place of a chain too
    places = chains.select("fi", F.col("end").alias("at")).unionByName(spark.range(len(files)).select(F.col("id").alias("fi"), F.lit(0).cast("bigint").alias("at"))).distinct()
    step = F.lit(range_bytes).cast("bigint")
    places = places.withColumn("start", (F.floor(F.col("at") / step) * step).cast("bigint")).join(listing, ["fi", "start"]).where("at < size")
    plain = chains.join(places.select("fi", "at"), ["fi", "at"]).select("fi", "at", "end", "n", F.lit(True).alias("whole"))
    rest = places.join(chains.select("fi", "at"), ["fi", "at"], "left_anti").select("fi", "at", "file", "stop", "size")
    nodes = _written(plain.unionByName(rest.mapInPandas(hop, "fi long, at long, end long, n long, whole boolean")), "nodes")
    whole = nodes.where("whole")
    rows = _on_path(whole).join(whole, ["fi", "at"]).select("fi", "at", "end", "n", "first").orderBy("fi", "at").collect()
    out, ends, number, before = [], {}, 0, -1
    for r in rows:
        if r["fi"] != before:
            before, base = r["fi"], number
        out.append({"file": files[r["fi"]][0], "start": r["at"], "end": r["end"], "first": base + r["first"]})
        number, ends[r["fi"]] = base + r["first"] + r["n"], r["end"]
    for fi, (name, size) in enumerate(files):
        if size and ends.get(fi, 0) != size:
            at = nodes.where((F.col("fi") == fi) & (F.col("at") == ends.get(fi, 0))).first()
            raise ValueError(f"{name}: no BSON document at byte {ends.get(fi, 0) if at is None else at['end']} of {size}")
    return out


# --- the data source -----------------------------------------------------------------

class _Range(InputPartition):
    def __init__(self, file, start, end, first):
        super().__init__(None)
        self.file, self.start, self.end, self.first = file, start, end, first


class _Reader(DataSourceReader):
    """Holds only the path of the range plan: the reader is pickled into
    every task, so the plan itself must not live on it."""

    def __init__(self, options):
        self.plan_path = options.get("plan")

    def partitions(self):
        fs, p = filesystem(self.plan_path)
        with fs.open_input_stream(p) as f:
            ranges = json.loads(f.read().decode("utf-8"))
        return [_Range(r["file"], r["start"], r["end"], r["first"]) for r in ranges]

    def read(self, part: _Range):
        """Decode one byte range; rows leave as Arrow record batches.  The
        range is streamed record by record through a buffered input, so a
        task holds one buffer and one record, not the whole range."""
        import pyarrow as pa

        fs, p = filesystem(part.file)
        ids, cats, imgs, pos = [], [], [], []
        k = part.first
        with fs.open_input_file(p) as raw:
            raw.seek(part.start)
            f = pa.BufferedInputStream(raw, buffer_size=READ_BUFFER)
            at = part.start
            while at + 4 <= part.end:
                head = f.read(4)
                n = struct.unpack("<i", head)[0] if len(head) == 4 else 0
                body = f.read(n - 4) if 5 <= n <= part.end - at else b""
                if len(body) < max(1, n - 4):
                    raise ValueError(f"{part.file}: no BSON document at byte {at}")
                try:
                    d, _ = decode_document(head + body, 0)
                except (ValueError, IndexError, struct.error) as e:
                    raise ValueError(f"{part.file}: broken BSON document at byte {at}: {e}") from e
                at += n
                im = d.get("imgs")
                _id, cat = d.get("_id"), d.get("category_id")
                ids.append(None if _id is None else str(_id))
                cats.append(None if cat is None else str(cat))
                imgs.append(None if im is None else
                            [{"picture": x.get("picture") if isinstance(x, dict) else None} for x in im])
                pos.append(k)
                k += 1
                if len(ids) >= BATCH_ROWS:
                    yield _batch(pa, ids, cats, imgs, pos)
                    ids, cats, imgs, pos = [], [], [], []
        if ids:
            yield _batch(pa, ids, cats, imgs, pos)


BATCH_ROWS = 8192
READ_BUFFER = 8 << 20


def _batch(pa, ids, cats, imgs, pos):
    pic = pa.list_(pa.struct([pa.field("picture", pa.binary())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.string()), pa.array(cats, pa.string()), pa.array(imgs, pic), pa.array(pos, pa.int64())],
        names=["_id", "category_id", "imgs", "pos"])


class BsonDataSource(DataSource):
    """``spark.read.format("bson").option("plan", path)``: decode planned ranges."""

    @classmethod
    def name(cls):
        return "bson"

    def schema(self):
        return RECORD_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_bson(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records ``(_id, category_id, imgs, pos)`` of every dump below ``path``.

    The range plan is written to the shared folder; the data source reads it
    when it lists its partitions."""
    spark.dataSource.register(BsonDataSource)
    ranges = plan_ranges(spark, path, range_bytes)
    plan = shared_path(spark, "bson-plans") + "/ranges.json"
    write_bytes(plan, json.dumps(ranges).encode("utf-8"))
    return spark.read.format("bson").option("plan", plan).load()


def write_bson(records: DataFrame, path: str, order: str = "pos") -> str:
    """Write records as BSON dump files (one per task, named in ``order``), for
    tests and fixtures.  A retried task rewrites the same file."""
    n = max(1, records.rdd.getNumPartitions())
    base = qualify(records.sparkSession, path).rstrip("/")

    def enc(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        chunks, cnt = [], 0
        for pdf in it:
            for _id, cat, imgs in zip(pdf["_id"], pdf["category_id"], pdf["imgs"]):
                pics = [{"picture": bytes(x["picture"]) if x["picture"] is not None else None} for x in imgs]
                chunks.append(encode_document({"_id": int(_id), "category_id": int(cat), "imgs": pics}))
                cnt += 1
        write_bytes(f"{base}/part-{pid:05d}.bson", b"".join(chunks))
        yield pd.DataFrame({"part": [pid], "n": [cnt]})

    (records.repartitionByRange(n, order).sortWithinPartitions(order)
     .select("_id", "category_id", "imgs").mapInPandas(enc, "part int, n long").collect())
    return path


__all__ = ["RECORD_SCHEMA", "read_bson", "write_bson", "plan_ranges", "decode_document", "encode_document",
           "BsonDataSource"]
