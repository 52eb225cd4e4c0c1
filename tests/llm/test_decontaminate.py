import random
import re

from tessera.llm import decontaminate as D


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(w):
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = words(text)
        s = shingles(w) | {tuple(w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1)}
        for i, t in items:
            g = shingles(words(t))
            if g and 100 * len(g & s) >= 80 * len(g):
                out.add((d, i, len(g), len(g & s)))
    return out


def make(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice((0, 2, 3, 4, 5, 6, 9, 20, 40, 80))))) for i in range(30)]
    docs = []
    for d in range(200):
        w = rng.choices(vocab, k=rng.choice((0, 2, 30, 400)))
        if rng.random() < 0.7:
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                if part:
                    part[rng.randrange(len(part))] = "changed"
            k = rng.randrange(len(w) + 1)
            w[k:k] = part
        docs.append((d, ", ".join(w).upper() if d % 3 else " ".join(w)))
    return docs, items + [(99, None)]


def test_matches_brute_force(spark):
    for seed in (1, 2):
        docs, items = make(seed)
        a = spark.createDataFrame(docs, "doc_id bigint, text string")
        b = spark.createDataFrame(items, "item_id bigint, text string")
        got = {(r.doc, r.item, r.n_item, r.n_shared) for r in D.containments(a, b).collect()}
        assert got == brute(docs, items) and len(got) > 30
        left = {r.doc_id for r in D.remove_contaminated(a, b).collect()}
        assert left == {d for d, _ in docs} - {x[0] for x in got}


def test_sketch_finds_every_containing_set(spark):
    """Without any 20 % of its shingles an item still has its hits among its sketch."""
    _, items = make(3)
    for r in D.item_sketches(spark.createDataFrame(items, "item_id bigint, text string")).where("n > 0").collect():
        missing = r.n - -(-80 * r.n // 100)
        assert len(r.sketch) == r.n or len(r.sketch) - missing >= r.hits


def test_edge_rows(spark, corpus, empty):
    item = spark.createDataFrame([(1, " ".join(f"WORD{i}" for i in range(20))), (1, " ".join(f"WORD{i}" for i in range(20))), (2, "short text"), (3, None), (4, "")],
                                 "item_id bigint, text string")
    got = {(r.doc, r.item) for r in D.containments(corpus, item).collect()}
    # item 1 in every copy of the base text but the edited one; short items match wherever their words stand
    assert got == {(1, 1), (2, 1), (None, 1), (13, 1), (7, 2), (8, 2), (12, 2)}
    left = D.remove_contaminated(corpus, item)
    assert left.columns == corpus.columns
    assert sorted([str(r.doc_id) for r in left.collect()]) == sorted(map(str, [3, 4, 5, 6, 9, None, 10, 11]))
    assert D.containments(empty, item).count() == 0
    assert D.remove_contaminated(corpus, item.limit(0)).count() == corpus.count()


def test_main_path_is_native(spark, corpus):
    plan = D.remove_contaminated(corpus, spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string"))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


def test_short_items_inside_longer_documents(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "Quick, brown fox jumps"), (3, "quick brown"), (4, "fox jumps quick brown"),
                                  (5, None), (6, "brown")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "quick brown fox jumps"), (2, "Brown!"), (3, "quick brown"), (4, "jumps over the lazy cat")], "item_id bigint, text string")
    got = {(r.doc, r.item) for r in D.containments(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (1, 2), (2, 2), (3, 2), (4, 2), (6, 2), (1, 3), (2, 3), (3, 3), (4, 3)}
