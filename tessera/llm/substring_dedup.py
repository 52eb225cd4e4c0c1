"""Substring dedup: repeated token windows, found by Rabin-Karp hashes.

Every window of ``size`` consecutive words has a polynomial hash.  Documents
are dealt to blocks of a bounded number of bytes; a block drops its own repeats
and sends each distinct hash once, with the smallest id that has it, to one of
many buckets.  A bucket answers each block with one bit a hash: whether a
smaller id has it elsewhere.  So a passage in a third of all documents costs a
hash for each block, not for each document.  Back in the block, windows whose
hash occurs in a smaller id are marked, and overlapping ones merge into maximal
removal intervals.

The bucket comes from a second, independent polynomial.  Hashes are only
compared inside a bucket of about BUCKET of them, so the chance of a false
repeat is about windows * BUCKET / 2**65, in proportion to the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textarrays import BASE, mix, rolling, slices, words

SIZE = 13
#: Least and most bytes of a block's texts, and bytes of text that fill a bucket.
BLOCK, LARGEST_BLOCK, BUCKET = 4 << 20, 64 << 20, 12 << 20
_BASE2 = np.uint64(0xD6E8FEB86659FD93)


class _Block:
    """The windows of one block: documents in order of (id, text), a null id last."""

    def __init__(self, table: pa.Table, size: int, buckets: int):
        ids = table.column("id").combine_chunks()
        key = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        text = table.column("text").combine_chunks()
        text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
        ties = np.flatnonzero(np.diff(np.sort(key)) == 0)
        order = np.lexsort((np.array([hash_of(x) for x in text], object), key)) if len(ties) else np.argsort(key)
        self.ids, self.key = ids.take(pa.array(order)), key[order]
        self.parts, hashes, owner = [], [], []
        for first, data, off in slices(text.take(pa.array(order))):
            starts, ends, h = words(data)
            cut = np.searchsorted(starts, off)
            self.parts.append((first, data, off, starts, ends, cut))
            hashes.append(h)
            owner.append(np.repeat(np.arange(first, first + len(off) - 1), np.diff(cut)))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        n = max(0, len(h) - size + 1)
        at = np.flatnonzero(self.owner[:n] == self.owner[size - 1:size - 1 + n])
        self.at = at  # first word of every window
        self.unique, first, self.back = np.unique(mix(rolling(h, size, BASE)[at]), return_index=True, return_inverse=True)
        # documents are in order of id, so the first window with a hash is in the smallest id that has it
        self.low = self.key[self.owner[at[first]]] if len(at) else np.zeros(0, np.int64)
        bucket = (mix(rolling(h, size, _BASE2)[at[first]]) % np.uint64(buckets)).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        self.order = np.lexsort((self.low, bucket))  # as sent: by bucket, then id
        self.bucket = bucket[self.order]


def hash_of(x) -> bytes:
    return hashlib.md5((x.as_py() or "").encode()).digest()


def _send(table: pa.Table, size: int, buckets: int) -> pa.Table:
    block, b = table.column("block")[0].as_py(), _Block(table, size, buckets)
    cuts = np.flatnonzero(np.diff(b.bucket, prepend=-1))
    rows = []
    for a, e in zip(cuts, np.append(cuts, len(b.bucket))[1:], strict=True):
        mine = b.order[a:e]
        low, counts = np.unique(b.low[mine], return_counts=True)
        rows.append((int(b.bucket[a]), block, low, counts.astype(np.int32), b.unique[mine].tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "block", "ids", "counts", "hashes"])


def _answer(table: pa.Table) -> pa.Table:
    """For each block with any, the bits of its hashes that occur with a smaller id."""
    hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
    sizes = np.array([len(x) for x in hashes])
    low = np.repeat(table.column("ids").combine_chunks().flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy())
    h = np.concatenate(hashes)
    order = np.argsort(h)
    h = h[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    least = np.minimum.reduceat(low[order], np.flatnonzero(new))
    beaten = np.empty(len(h), bool)
    beaten[order] = low[order] > least[np.cumsum(new) - 1]
    ends = np.cumsum(sizes)
    found = [(i, beaten[e - n:e]) for i, (n, e) in enumerate(zip(sizes, ends, strict=True))]
    found = [(i, np.packbits(x).tobytes()) for i, x in found if x.any()]
    which = pa.array([i for i, _ in found], pa.int64())
    return pa.Table.from_arrays([table.column("block").take(which), table.column("bucket").take(which), pa.array([x for _, x in found], pa.binary())],
                                names=["block", "bucket", "bits"])


def _cut(table: pa.Table, answers: pa.Table, size: int, buckets: int, with_text: bool) -> pa.Table:
    b = _Block(table, size, buckets)
    sent = np.zeros(len(b.order), bool)
    for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        lo, hi = np.searchsorted(b.bucket, [bucket, bucket + 1])
        sent[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    beaten = np.zeros(len(b.unique), bool)
    beaten[b.order] = sent
    if len(b.at):
        gone = beaten[b.back] | (b.key[b.owner[b.at]] > b.low[b.back])
    else:
        gone = np.zeros(0, bool)
    change = np.zeros(len(b.owner) + 1, np.int64)
    np.add.at(change, b.at[gone], 1)
    np.add.at(change, b.at[gone] + size, -1)
    removed = np.cumsum(change[:-1]) > 0
    n_words, n_removed, spans, digests, kept_texts, a = [], [], [], [], [], 0
    for _, data, off, starts, ends, cut in b.parts:
        drop = removed[a:a + len(starts)]
        a += len(starts)
        keep = ~drop
        mark = np.zeros(len(data) + 2, np.int8)
        mark[starts[keep]] += 1
        mark[ends[keep] + 1] -= 1  # a word and the white space after it: every text ends with one
        mask = np.cumsum(mark[:len(data)], dtype=np.int8).astype(bool)
        out = data.copy()
        out[ends] = 0x20
        out = out[mask]
        to = np.concatenate([[0], np.cumsum(mask)])[off]
        for i in range(len(off) - 1):
            lo, hi = cut[i], cut[i + 1]
            text = out[to[i]:max(to[i], to[i + 1] - 1)].tobytes()
            n_words.append(hi - lo), n_removed.append(int(drop[lo:hi].sum()))
            inside = drop[lo:hi]
            if n_removed[-1]:
                e = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(e == 1), np.flatnonzero(e == -1), strict=True)])
            else:
                spans.append([])
            digests.append(hashlib.sha256(text).hexdigest())
            kept_texts.append(text.decode("utf-8", "replace") if with_text else None)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = [b.ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(digests, pa.string())]
    names = ["id", "n_words", "n_removed", "intervals", "kept_sha256"]
    if with_text:
        columns.append(pa.array(kept_texts, pa.string())), names.append("kept")
    return pa.Table.from_arrays(columns, names=names)


def remove_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: id_col, n_words, n_removed, intervals, kept_sha256 (and the kept text).

    Words are runs of non-space (ASCII white space).  A word goes when it lies
    in a window that also starts in a document with a smaller id; ``intervals``
    are the maximal runs of such words, from start up to before end.  Windows
    are judged on the input.  A null or empty text has no words.  A null id
    counts as larger than all others; rows of one id do not remove from one
    another.  Texts shorter than a window stay whole.  No rows give no rows.
    """
    text = docs.select(F.col(id_col).cast("bigint").alias("id"), F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit(" ")).alias("text"))
    total = text.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    block_bytes = min(LARGEST_BLOCK, max(BLOCK, total // 4096))
    blocks, buckets = -(-total // block_bytes), -(-total // BUCKET)
    # a hot id must not fill a block: the text takes part
    dealt = text.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).select("block", "id", "text")
    sent = dealt.groupBy("block").applyInArrow(lambda t: _send(t, size, buckets),
                                               "bucket int, block int, ids array<bigint>, counts array<int>, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "block int, bucket int, bits binary")
    kind = "id bigint, n_words bigint, n_removed bigint, intervals array<struct<start: bigint, end: bigint>>, kept_sha256 string"
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda left, right: _cut(left, right, size, buckets, with_text), kind + ", kept string" * with_text)
    return out.withColumnRenamed("id", id_col)
