"""Registered queries against their SQL, contracts that SQL can't express, and the pipeline."""

import os
import sys
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.queries import ORACLE, QUERIES
from tessera.plans.tables import TABLES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_oracle import _digest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert _digest(df.columns, [tuple(r) for r in df.collect()]) == _digest(cols, res.fetchall())


def test_op2_learns_nothing_from_held_out(spark, con):
    rows = QUERIES["op2_language_id"](spark, SF).collect()
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_op4_and_op6_cover_every_document(spark, con):
    ids = sorted(x[0] for x in con.execute("SELECT doc_id FROM documents").fetchall())
    pieces = QUERIES["op4_packing"](spark, SF).collect()
    assert sorted({r.doc_id for r in pieces}) == ids
    fill = {}
    for r in pieces:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * -(-sum(fill.values()) // 2048) + 1
    assert sorted(r.doc_id for r in QUERIES["op6_sharding"](spark, SF).collect()) == ids


def test_op5_text_is_the_article(spark, con):
    import html
    import re
    for r in QUERIES["op5_html_extract"](spark, SF).collect():
        page = con.execute("SELECT html FROM pages WHERE page_id = ?", [r.page_id]).fetchone()[0]
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in parts if x)


def test_pipeline_stages(spark, con, corpus):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        assert new.columns == docs.columns and new.join(docs, "doc_id", "left_anti").count() == 0
        seen.append((name, docs.count(), new.count()))
        docs = new
    assert seen[0][2] >= 0.99 * seen[0][1] and seen[1][2] < seen[1][1]
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_edge_rows(spark, corpus, empty):
    for frame in (corpus.withColumn("a.b", F.lit(1)), empty):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
            assert docs.columns == frame.columns
        corpus_pipeline.pack(spark, docs, SF).count()


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op3_decontaminate", "op10_url_reputation", "op13_mixing"])
def test_native_queries_run_no_python(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
