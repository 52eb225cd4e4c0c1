"""Periodic runs of words, by seeds and extension along diagonals.

A run of period q and length L equals itself shifted by q over L - q words: a
stretch on diagonal (lag) q.  With L >= max(least, times * q) the stretch has
at least max(least - q, (times - 1) * q) words, so every k-gram index with k
not above that has a seed inside each run.  Periods are taken in octaves
[2**j, 2**(j + 1)), each with its own k, the least overlap that any period of
the octave guarantees.

With times >= 3, k is at least as long as any period of its octave.  Then two
neighbouring occurrences of a k-gram inside a run are exactly its smallest
period apart: a nearer one would give the run a second, smaller period, and by
the theorem of Fine and Wilf their greatest common divisor would be a period
too.  So only neighbouring occurrences are enumerated as pairs, at most one a
word and octave, and none is lost.  A table keeps for each lag how far it has
been covered; a pair inside is not extended again.

k-grams are named, not hashed: names of 2**m-grams are made of pairs of names
of half the length, and a k-gram has the names of the two powers of two that
cover it.  Words whose gram occurs once in a document leave the index.  All
comparisons are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 6, 4
#: Bytes of texts that are indexed together.
BATCH_BYTES = 4 << 20


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct key, and whether the key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    name = np.empty(len(keys), np.int64)
    name[order] = np.cumsum(new) - 1
    last = np.ones(len(keys), bool)
    last[:-1] = new[1:]
    often = np.empty(len(keys), bool)
    often[order] = ~(new & last)
    return name, often


def _paired(at: np.ndarray, name: np.ndarray, gap: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose name and the name ``gap`` words later are both indexed, with a key of the two."""
    dense = np.full(size + gap, -1, np.int64)
    dense[at] = name
    other = dense[at + gap]
    both = other >= 0
    return at[both], name[both] * size + other[both]


def _seeds(ids: np.ndarray, least: int, times: int):
    """For each octave, the first words and lags of neighbouring equal k-grams, in order of lag and place."""
    n = len(ids)
    name, often = _names(ids)
    at, name, length = np.flatnonzero(often), name[often], 1  # grams of `length` words that occur more than once
    octave = 1
    while len(at):
        k = min(max(least - q, (times - 1) * q) for q in range(octave, min(2 * octave, octave + least)))
        while 2 * length <= k and len(at):
            at, key = _paired(at, name, length, n)
            name, often = _names(key)
            at, name, length = at[often], name[often], 2 * length
        if not len(at):
            return
        where, gram = (at, name) if k == length else _paired(at, name, k - length, n)
        order = np.argsort(gram, kind="stable")  # places rise inside a gram
        where, gram = where[order], gram[order]
        lag = np.diff(where)
        near = (gram[1:] == gram[:-1]) & (lag >= octave) & (lag < 2 * octave)
        first, lag = where[:-1][near], lag[near]
        order = np.lexsort((first, lag))
        yield k, first[order], lag[order]
        octave *= 2


def _same(ids: np.ndarray, i: int, lag: int, way: int) -> int:
    """How many words from ``i`` on (way 1), or before it (way -1), equal the words ``lag`` later."""
    total, step, n = 0, 64, len(ids)
    while True:
        step = min(step, n - lag - i - total if way > 0 else i - total)
        if step <= 0:
            return total
        a = i + total if way > 0 else i - total - step
        differ = np.flatnonzero(ids[a:a + step] != ids[a + lag:a + lag + step])
        if len(differ):
            return total + int(differ[0] if way > 0 else step - 1 - differ[-1])
        total, step = total + step, 4 * step


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Runs (start, length, smallest period) of a sequence of word numbers, by start and period.

    A number that separates documents must occur once in the sequence; no run
    covers it.
    """
    found = []
    for k, first, lag in _seeds(ids, least, times):
        covered: dict[int, int] = {}  # lag: the furthest word that an extension has covered
        for i, q in zip(first.tolist(), lag.tolist(), strict=True):
            if i < covered.get(q, -1):
                continue
            right = k + _same(ids, i + k, q, 1)
            covered[q] = i + right
            start = i - _same(ids, i, q, -1)
            length = i + right - start + q
            if length >= max(least, times * q):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _split(column: pa.Array):
    """Batches (words by row, word numbers of all rows with a separator after each, places of the separators)."""
    texts = [(x or "").encode() for x in column.to_pylist()]
    a = 0
    while a < len(texts):
        b = a + 1
        size = len(texts[a])
        while b < len(texts) and size + len(texts[b]) <= BATCH_BYTES:
            size += len(texts[b])
            b += 1
        words = [x.split() for x in texts[a:b]]  # bytes split at ASCII white space
        sizes = np.array([len(w) for w in words], np.int64)
        flat = pa.array([x for w in words for x in w], pa.large_binary())
        ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
        # a word's number tells the document too, so that only repeats inside one document stay in the index
        ids += np.repeat(np.arange(b - a), sizes) * (int(ids.max(initial=0)) + 1)
        ends = np.cumsum(sizes)
        yield words, np.insert(ids, ends, -1 - np.arange(b - a)), ends + np.arange(b - a)
        a = b


def _dropped(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that lie in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _work(batches, least: int, times: int, with_text: bool):
    for batch in batches:
        n_words, spans, digests, texts = [], [], [], []
        for words, ids, ends in _split(batch.column("text")):
            own: list[list] = [[] for _ in words]
            for start, length, q in runs(ids, least, times):
                d = int(np.searchsorted(ends, start))
                own[d].append((start - (int(ends[d - 1]) + 1 if d else 0), length, q))
            for w, found in zip(words, own, strict=True):
                kept = w
                if found:
                    kept = [x for x, gone in zip(w, _dropped(len(w), found).tolist(), strict=True) if not gone]
                text = b" ".join(kept)
                n_words.append(len(w))
                spans.append([{"start": s, "length": x, "period": q} for s, x, q in found])
                digests.append(hashlib.sha256(text).hexdigest())
                texts.append(text.decode("utf-8", "replace") if with_text else None)
        made = {"id": batch.column("id"), "n_words": pa.array(n_words, pa.int64()), "runs": pa.array(spans, RUNS),
                "collapsed_sha256": pa.array(digests, pa.string())}
        if with_text:
            made["collapsed"] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_pydict(made)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES,
              with_text: bool = False) -> DataFrame:
    """Per row: id_col, n_words, runs (start, length, period; by start, then period), collapsed_sha256 (and collapsed).

    Words are runs of non-space (ASCII white space).  A run is a stretch of
    words with smallest period q and length at least max(``least``, ``times`` * q)
    that no neighbouring word extends with that period.  The collapsed text
    leaves out each word that lies in a run after its first q words; the others
    are joined by one space.  A null or empty text has no words and no runs, and
    collapses to the empty text.  Rows are judged one by one, so repeated rows
    and null ids repeat in the result; other columns of ``docs`` are left out;
    no rows give none.  Rows stay where they are: there is no shuffle.
    """
    if times < 3 or least <= times:
        raise ValueError("times must be at least 3, and least more than times")
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = (f"id {d.schema['id'].dataType.simpleString()}, n_words bigint, "
            "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed_sha256 string")
    out = d.mapInArrow(lambda batches: _work(batches, least, times, with_text), kind + ", collapsed string" * with_text)
    return out.withColumnRenamed("id", id_col)


def longest_run(found: DataFrame, runs_col: str = "runs") -> DataFrame:
    """Add n_runs, start, length, period, exponent_milli (of the longest run) and runs_sha256.

    Of runs of one length the one with the smallest start, then period, counts;
    without runs the four are null.
    """
    r = F.col(runs_col)
    first = F.array_min(F.transform(r, lambda x: F.struct((-x["length"]).alias("l"), x["start"].alias("start"), x["period"].alias("period"))))
    listed = F.array_join(F.transform(r, lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    return (found.withColumn("__first", first)
            .withColumn("n_runs", F.size(r).cast("bigint"))
            .withColumn("start", F.col("__first.start")).withColumn("length", -F.col("__first.l")).withColumn("period", F.col("__first.period"))
            .withColumn("exponent_milli", F.expr("(1000 * length) div period"))
            .withColumn("runs_sha256", F.sha2(F.when(F.size(r) > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256))
            .drop("__first"))
