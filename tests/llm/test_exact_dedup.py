import hashlib
import re

from tessera.llm import exact_dedup as E


def brute(rows):
    groups = {}
    for i, r in enumerate(rows):
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "").encode()).hexdigest()
        groups.setdefault(key, []).append((r.doc_id is None, r.doc_id or 0, i))
    out = []
    for key, g in groups.items():
        first = min(g)
        out += [(None if x[0] else x[1], None if first[0] else first[1], len(g), key) for x in g]
    return sorted(out, key=str), len(groups)


def test_decisions_match_brute_force_at_every_split(spark, corpus):
    want, n = brute(corpus.collect())
    for heavy in (1, 1024):
        got = E.decisions(corpus, heavy=heavy).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == want
        assert sum(r.kept for r in got) == n
        kept = E.keep_first(corpus, heavy=heavy)
        assert kept.columns == corpus.columns
        assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([r.doc_id for r in got if r.kept], key=str)


def test_hot_group_is_found_and_settled_on_the_map_side(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text")
    keyed = df.selectExpr("text as digest", "struct(doc_id) as key")
    top = E.heavy_digests(keyed, 8, 64).collect()
    assert [(r.digest, r.size) for r in top if r.digest == "hot"] == [("hot", 1000)]
    assert E.keep_first(df).count() == 2001


def test_empty(empty):
    assert E.decisions(empty).count() == 0 and E.keep_first(empty).count() == 0
