"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

Documents are tokenised where they lie.  A document longer than a sequence is
cut into whole sequences and one shorter first piece.  The rest are packed in
blocks of a bounded number of pieces, dealt evenly; inside a block, longest
first, a piece goes to the open bin that leaves the sum over all residual gaps
of (open bins with that gap) squared smallest, and opens a bin only if it fits
in none.  Only lengths travel, never tokens; nothing passes the driver.
"""

from __future__ import annotations

import array
import base64
import json
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

CAPACITY = 2048
#: Pieces packed together by one task.
BLOCK = 50_000
#: Characters tokenised at once, at least; the cut is where a token must start.
PART = 1 << 18
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

_encodings: dict[str, object] = {}
_added: dict[str, dict[str, int]] = {}


def encoding(path: str):
    """The byte-level BPE whose rank file is at ``path``; once in each worker."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=public_tokenizers.PATTERN,
                                             mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def rank_file(name: str = "byte_bpe_50k") -> str:
    """The ranks of the vocabulary ``<name>.json``: the same ids, several times faster to apply."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens of the vocabulary, from the JSON beside its rank file; without it ids would change, so that raises."""
    if path not in _added:
        name = os.path.splitext(path)[0] + ".json"
        with open(name, encoding="utf-8") as f:
            found = json.load(f)["added_tokens"]
        for t in found:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"{name}: added token {t['content']!r} is not matched as it stands")
        _added[path] = {t["content"]: t["id"] for t in found}
    return _added[path]


def token_ids(text: str | None, path: str, end: int = 0, added: dict[str, int] | None = None) -> array.array:
    """The text's ids, then ``end``; null is empty.  Long texts are encoded in parts, with equal ids.

    Where a key of ``added`` stands in the text (the longest, if several do) its
    id is given, and what lies between is encoded by itself; without ``added``
    such strings are text like any other.
    """
    enc, ids, text = encoding(path), array.array("I"), text or ""
    names = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    for k, part in enumerate(names.split(text) if names else [text]):
        if k % 2:
            ids.append(added[part])
            continue
        a = 0
        while a < len(part):
            cut = _CUT.search(part, a + PART) if len(part) - a > PART else None
            b = cut.start() if cut else len(part)
            ids.extend(enc.encode_ordinary(part[a:b] if a or cut else part))
            a = b
    ids.append(end)
    return ids


def spans(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole sequences after a first one that may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def tokenise(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id",
             text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids).

    Added tokens of the vocabulary that stand in a text get their own ids.
    """
    path = path or rank_file()
    kind = f"{id_col} bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), path, added=added_tokens(path))
                raw = memoryview(ids).cast("B")
                for k, (a, n) in enumerate(spans(len(ids), capacity)):
                    rows.append((key, k, a, n, zlib.crc32(raw[4 * a:4 * (a + n)]), list(ids[a:a + n]) if with_ids else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][:5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=[id_col, "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, kind)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length (1 to capacity), longest first.

    Moving a bin from gap g to g - s changes the sum of squares by
    2 (N[g-s] - N[g] + 1), or by 1 - 2 N[s] when it closes the bin.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.int64(1) << 60
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        there = count[s:capacity]
        change = 2 * (count[:capacity - s] - there + 1)
        if len(change):
            change[0] = 1 - 2 * there[0]
            k = int(np.argmin(np.where(there > 0, change, never)))
        if len(change) and there[k]:
            gap = s + k
            count[gap] -= 1
            at = open_bins[gap].pop()
        else:
            gap, at = capacity, made
            made += 1
        bins[i], offsets[i] = at, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_bins[gap - s].append(at)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``pieces`` plus sequence_id and offset.

    Lengths are 1 to ``capacity``.  Rows may repeat: each is placed.  An empty
    table gives no rows.
    """
    rows = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, -(-rows.where(F.col("length") < capacity).count() // block))
    whole = rows.where(F.col("length") == capacity).select(
        *pieces.columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        number = group["block"].to_numpy().astype(np.int64) << np.int64(32)
        return group.drop(columns=["row", "block"]).assign(sequence_id=number + bins, offset=offsets)

    packed = (rows.where(F.col("length") < capacity)
              .withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
              .groupBy("block").applyInPandas(place, schema))
    return whole.unionByName(packed)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, block: int = BLOCK,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``docs`` with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone.  Null ids and repeated rows are
    packed like any other.  Other columns are not read.  No rows, no pieces.
    """
    return pack(tokenise(docs, path, capacity, id_col, text_col), capacity, block)


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, capacity: int = CAPACITY,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(sequence_id, ids)``: the packed sequences themselves; ids of ``docs`` must be unique."""
    ids = tokenise(docs, path, capacity, id_col, text_col, with_ids=True).select(id_col, "piece", "ids")
    placed = ids.join(packed.select(id_col, "piece", "sequence_id", "offset"), [id_col, "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most capacity ids
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
