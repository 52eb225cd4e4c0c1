import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations as C
from tessera.llm import quotient_filter as Q

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, first):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i:i + m])] += 1
    out = []
    for lang, counts in f.items():
        cands = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        longer = defaultdict(int)
        for g, a in cands.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        longer[g[i:j]] = max(longer[g[i:j]], a)
        scored = []
        for g, a in cands.items():
            if longer[g] < a:
                score, _, left, right = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (s, a, g, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(rng, n):
    vocab = ["a", "B", "été", "x1", "\x00", "I", "ß"]
    stock = [" ".join(rng.choices(vocab, k=rng.randrange(2, 9))) for _ in range(8)]
    for _ in range(n):
        parts = [rng.choice(stock) if rng.random() < 0.5 else " ".join(rng.choices(vocab, k=rng.randrange(8))) for _ in range(rng.randrange(6))]
        yield rng.choice(("en", "en", "en", "de", "und", None)), rng.choice((" ", ". ", ",", "\n", " \t ")).join(parts) if rng.random() < 0.95 else None


@pytest.mark.parametrize("least,longest,first,block,shard", [(3, 5, 2000, 8 << 20, 1 << 21), (2, 5, 4, 60, 16), (5, 3, 7, 200, 4), (1, 2, 50, 200, 100)])
def test_matches_brute_force(spark, monkeypatch, least, longest, first, block, shard):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "SHARD", shard)
    rows = list(texts(random.Random(least), 250))
    d = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = C.collocations(d, least=least, longest=longest, first=first).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, least, longest, first)


def test_edge_rows(spark, corpus, empty):
    rows = [(r.lang, r.text) for r in corpus.collect()]
    assert sorted(tuple(r) for r in C.collocations(corpus, least=2).collect()) == brute(rows, 2, 5, 2000)
    assert C.collocations(empty).count() == 0
    assert C.collocations(corpus, least=10**6).count() == 0


def test_scores_beyond_64_bits(spark):
    a, left, right, n = 3 * 10**12, 4 * 10**12, 5 * 10**12, 9 * 10**14
    phrases = spark.createDataFrame([([1], left), ([2], right), ([1, 2], a)], "ids array<bigint>, n bigint")
    words = spark.createDataFrame([(1, "en", "x", left), (2, "en", "y", right)], "id bigint, lang string, word string, n bigint")
    got = C.scored_phrases(phrases, words, spark.createDataFrame([("en", n)], "lang string, n bigint")).first()
    assert got.score == 1000 * a * n // (left * right) and (got.a, got.l, got.r) == (a, left, right)


def test_a_phrase_in_all_rows_is_one_entry_a_block(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 2000)
    d = spark.range(2000).select(F.lit("en").alias("lang"), F.lit("always the very same phrase").alias("text"))
    got = C.collocations(d).collect()
    assert [(r.phrase, r.a, r.n) for r in got] == [("always the very same phrase", 2000, 10000)]


@pytest.mark.parametrize("bits,n,shard_bits", [(1, 2, 0), (1, 2, 2), (3, 5, 4), (13, 5, 0), (12, 5, 3), (25, 5, 6), (31, 2, 1), (31, 5, 5), (16, 4, 2)])
def test_filters_lose_nothing(bits, n, shard_bits):
    rng = np.random.default_rng(bits * n)
    columns = [rng.integers(0, min(1 << bits, 40 + (1 << bits) // 3), 3000) for _ in range(n)]
    width = bits * n
    keys = Q.pack(columns, bits)
    spread = Q.permute(keys, width)
    assert all((a == b).all() for a, b in zip(Q.unpack(Q.restore(spread, width), bits, n), columns))
    unique, place = Q.distinct(spread)
    counts = np.bincount(place).astype(np.int64) * rng.choice([1, 254, 255, 256, 10**12], len(unique[0]))
    shards = Q.shard_of(unique[0], width, shard_bits)
    wanted = {}
    for s in np.unique(shards).tolist():
        own = shards == s
        f = Q.QuotientFilter(width, shard_bits, s, [x[own] for x in unique], counts[own])
        back = Q.QuotientFilter.from_bytes(f.to_bytes())
        assert all((a == b).all() for a, b in zip(back.limbs, f.limbs)) and (back.counts == f.counts).all() and back.shard == s
        odd = f.where(np.arange(len(f.counts)) % 2 == 1)
        merged, where = Q.QuotientFilter.merge([f, odd, back])
        assert (merged.counts[::1] == f.counts * 2 + np.where(np.arange(len(f.counts)) % 2 == 1, f.counts, 0)).all()
        assert (where[:len(f.counts)] == np.arange(len(f.counts))).all()
        ids = np.stack(Q.unpack(Q.restore(merged.limbs, width), bits, n), 1)
        for row, c in zip(ids.tolist(), f.counts.tolist()):
            wanted[tuple(row)] = c
    assert len(wanted) == len({tuple(r) for r in zip(*[c.tolist() for c in columns])})


def test_permutation_is_a_bijection_and_spreads():
    for width in (1, 2, 3, 8, 12):
        out = Q.permute([np.arange(1 << width, dtype=np.uint64)], width)[0]
        assert sorted(out.tolist()) == list(range(1 << width))
    packed = Q.permute(Q.pack([np.arange(1 << 16) // 256, np.arange(1 << 16) % 256], 20), 40)[0]
    assert np.bincount(Q.shard_of(packed, 40, 4), minlength=16).max() < 1.2 * (1 << 12)
