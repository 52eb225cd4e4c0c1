import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import jaccard_join as J
from tessera.llm.components import components


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < size else [tuple(w[i:i + size]) for i in range(len(w) - size + 1)])


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    by = defaultdict(list)
    for i, s in sets.items():
        for t in s:
            by[t].append(i)
    pairs = {(a, b) for g in by.values() for a in g for b in g if a < b}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def texts(seed, n=300):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out)[1].split()
            for _ in range(rng.choice((0, 0, 1, 2, 4, 8))):
                k = rng.randrange(len(w)) if w else 0
                w[k:k + 1] = [rng.choice(vocab)] * rng.choice((0, 1, 2))
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice((0, 1, 2, 5, 30, 120)))]
        if rng.random() < 0.3:
            w = passage + w
        out.append((i * 7 % 1009, " ".join(w)))
    return out


@pytest.mark.parametrize("size,percent,seed", [(3, 90, 1), (5, 80, 2), (3, 50, 3)])
def test_components_match_brute_force(spark, size, percent, seed):
    rows = texts(seed)
    got = J.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, size, percent)
    assert len(got) == len(rows)


def test_edge_rows(corpus, empty):
    got = J.near_groups(corpus).collect()
    assert len(got) == corpus.count()
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[None] is None and comp[2] == 1 and comp[13] == 1
    assert [comp[i] for i in (4, 5, 6, 7, 8, 9, 12)] == [4, 5, 6, 7, 7, 9, 7]
    kept = J.keep_one(corpus)
    assert kept.columns == corpus.columns and 2 not in [r.doc_id for r in kept.collect()]
    assert kept.where("doc_id is null").count() == 2
    assert J.near_groups(empty).count() == 0 and J.keep_one(empty).count() == 0


def test_prefix_choice_is_wide_enough():
    ranks = np.sort(np.random.default_rng(0).integers(0, 60, 500)).astype(np.uint8)
    for n in (1, 2, 9, 10, 11, 100, 500):
        for percent in (50, 80, 90):
            length, asked = J.choose_prefix(ranks[:n], 1.0, percent)
            assert length == n - J.least_shared(n, percent) + asked and 1 <= asked <= min(J.MATCHES, J.least_shared(n, percent))


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    b = np.unique(np.concatenate([a[20:], rng.integers(0, 1 << 63, 15, dtype=np.uint64)]))
    x, y = J.parity_bits(a), J.parity_bits(b)
    assert sum(bin(int(v) & (2**64 - 1)).count("1") for v in x ^ y) <= len(np.setxor1d(a, b))


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (300, 301), (301, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert set(got[i] for i in range(100, 141)) == {100} and got[250] == 7 and got[301] == 300 and 5 not in got
