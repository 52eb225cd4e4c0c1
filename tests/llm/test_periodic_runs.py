import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import periodic_runs as P


def brute(w, least=6, times=4):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                stretch = w[i:i + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(w, found):
    gone = set()
    for s, n, q in found:
        gone.update(range(s + q, s + n))
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(rng, n):
    for _ in range(n):
        w, vocab = [], "abcde"[:rng.randrange(1, 6)]
        for _ in range(rng.randrange(5)):
            block = rng.choices(vocab, k=rng.randrange(1, 30))
            w += rng.choice((block, block * rng.randrange(1, 9), block * 4 + block[:rng.randrange(len(block))], [rng.choice("xyz")]))
        yield w


@pytest.mark.parametrize("least,times", [(6, 4), (4, 3), (12, 5)])
def test_runs_equal_brute_force(least, times):
    for w in texts(random.Random(least), 1500):
        ids = np.array([ord(x) for x in w] + [-1], np.int64)
        assert P.runs(ids, least, times) == brute(w, least, times), w


def test_nested_and_neighbouring_runs():
    inner = list("aaaaaaab")
    for w in (inner * 4, list("abab" * 3 + "cbcb" * 3), list("abcabcabcabc" + "bcabcabcabca"), ["x"] * 5, ["x"] * 6, list("abababa"), list("abababab")):
        assert P.runs(np.array([ord(x) for x in w] + [-1], np.int64)) == brute(w)


def test_find_runs_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice((i, i, 7, None)), rng.choice((" ", "\n\t", "  ")).join(w) if rng.random() < 0.95 else None) for i, w in enumerate(texts(rng, 300))]
    got = P.longest_run(P.find_runs(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(3), with_text=True)).collect()
    expected = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        found = brute(w)
        first = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = collapse(w, found)
        expected.append((i, len(w), len(found), *(first or (None,) * 3), first and 1000 * first[1] // first[2],
                         hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), kept))
    out = [(r.doc_id, r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256, r.collapsed) for r in got]
    assert sorted(out, key=str) == sorted(expected, key=str)


def test_edge_rows(spark, corpus, empty):
    got = P.longest_run(P.find_runs(corpus)).collect()
    assert len(got) == corpus.count() and all(r.n_runs == 0 and r.start is None for r in got)
    assert {r.doc_id: r.n_words for r in got}[9] == 30000
    assert P.longest_run(P.find_runs(empty)).count() == 0
    with pytest.raises(ValueError):
        P.find_runs(corpus, times=2)


def test_long_texts_of_one_word_and_of_a_hot_gram():
    one = np.append(np.zeros(300_000, np.int64), -1)
    assert P.runs(one) == [(0, 300_000, 1)]
    rng = np.random.default_rng(1)  # the same five words again and again, at distances that never repeat
    parts = []
    for i in range(2000):
        parts += [np.arange(5), 100 + rng.integers(0, 1 << 40, 3 + i % 50)]
    assert P.runs(np.concatenate([*parts, [-1]])) == []
    period = np.arange(60_000)
    assert P.runs(np.concatenate([period] * 5 + [[-1]])) == [(0, 300_000, 60_000)]
