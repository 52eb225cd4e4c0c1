import zlib

import pytest

from tessera.llm import sharding as S


def test_balance_and_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = S.assign(docs, 16).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    loads, home = [0] * 16, {}
    for r in rows:
        loads[r.shard] += r["size"]
        assert home.setdefault(text[r.doc_id], r.shard) == r.shard
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    assert len(rows) == len(text) and max(loads) < 1.02 * min(loads)


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_any_number_of_shards_with_hot_groups(spark, shards):
    docs = spark.range(900).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('h', 40), repeat('x', cast(id % 90 as int)) || id) as text",
                                       "if(id % 3 = 1, 'hot', 's' || id) as source")
    rows = S.numbered(S.assign(docs, shards)).collect()
    assert len(rows) == 900
    loads, hot = [0] * shards, 300 * 41
    for k in range(shards):
        mine = [r for r in rows if r.shard == k]
        loads[k] = sum(r["size"] for r in mine)
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    rest = [x for x in loads if x != hot] or loads  # at 7 shards the hot group is more than one
    assert max(rest) < 1.03 * min(rest) and max(loads) <= max(hot, 1.03 * sum(loads) / shards)


def test_target_bytes(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('y', 20) || id as text")
    total = S.assign(docs, 1).groupBy().sum("size").first()[0]
    sizes = [r[1] for r in S.assign(docs, None, target_bytes=total // 5).groupBy("shard").sum("size").collect()]
    assert len(sizes) in (5, 6) and max(sizes) <= 1.05 * total / len(sizes)


def test_edge_rows(corpus, empty):
    rows = S.numbered(S.assign(corpus, 4)).collect()
    assert len(rows) == corpus.count() and {r.shard for r in rows} <= {0, 1, 2, 3}
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (4, 5)} == {(1, 0)}
    assert S.numbered(S.assign(empty, 4)).count() == 0
