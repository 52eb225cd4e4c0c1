import hashlib
import random
import re

import pytest

from tessera.llm import substring_dedup as S


def brute(rows, size):
    first, out = {}, []
    split = [(i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            first[key] = min(first.get(key, float("inf")), float("inf") if i is None else i)
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < (float("inf") if i is None else i):
                gone[k:k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,block,bucket", [(13, 4 << 20, 12 << 20), (4, 300, 200), (2, 2000, 50)])
def test_matches_brute_force(spark, monkeypatch, size, block, bucket):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = random.Random(size)
    vocab = ["a", "bb", "ccc", "Été", "x1", "..."]
    shared = [rng.choices(vocab, k=rng.randrange(1, 40)) for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(4)):
            w += rng.choice(shared) if rng.random() < 0.5 else rng.choices(vocab, k=rng.randrange(30))
        rows.append((rng.choice((i, i, i, 5, None)), rng.choice((" ", "\n", "  \t")).join(w) if rng.random() < 0.95 else None))
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), size, with_text=True).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got], key=str) == brute(rows, size)
    for r in got:
        assert sum(x.end - x.start for x in r.intervals) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.intervals, r.intervals[1:]))


def test_edge_rows(spark, corpus, empty):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    got = S.remove_repeats(corpus).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == [x[:4] for x in brute(rows, 13)]
    assert S.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("texts", [["only three words"] * 2, [None], [None, "", " "], ["a b c", " ".join("abcdefghijklmnop"), " ".join("abcdefghijklmnop")]])
def test_blocks_without_a_window(spark, monkeypatch, texts):
    monkeypatch.setattr(S, "BLOCK", 16)
    rows = list(enumerate(texts))
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == [x[:4] for x in brute(rows, 13)]


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    import numpy as np

    from tessera.llm import textarrays as T
    data = np.frombuffer(("word and another word " * 500).encode(), np.uint8)
    whole = T.words(data)
    monkeypatch.setattr(T, "PIECE", 64)
    for a, b in zip(whole, T.words(data)):
        assert (a == b).all()
    assert len(np.unique(whole[2])) == 3
