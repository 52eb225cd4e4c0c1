import random
import zlib
from array import array

import numpy as np
import pytest

from tessera.llm import packing as P


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_ids_are_those_of_the_json_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["", " ", "a", "Été  naïve x\n\n y\t", "<|endoftext|> 12345 don't", "a" * 3000,
             " ".join("".join(rng.choices("abcdéñ ,.1\n", k=9)) for _ in range(4000))]
    old, P.PART = P.PART, 1000
    try:
        for x in texts:
            assert list(P.token_ids(x, P.rank_file()))[:-1] == t.encode(x, add_special_tokens=False).ids
    finally:
        P.PART = old


def test_added_tokens_have_their_own_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|endoftext|", " ", "\n", "a", " 12", "é", "don't", "  "]
    texts = ["a <|endoftext|> 12", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "plain text",
             "word " * 900 + "<|endoftext|>" + " word" * 900, *("".join(rng.choices(parts, k=12)) for _ in range(300))]
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 1105]
    old, P.PART = P.PART, 1000
    try:
        for i, x in enumerate(texts):
            assert list(P.token_ids(x, P.rank_file(), added=P.added_tokens(P.rank_file())))[:-1] == want[i]
    finally:
        P.PART = old
    docs = spark.createDataFrame(list(enumerate(texts[:4])), "doc_id bigint, text string")
    rows = P.pack_documents(docs).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == {
        i: (len(want[i]) + 1, zlib.crc32(array("I", [*want[i], 0]).tobytes())) for i in range(4)}


def test_pieces_cover_documents(corpus):
    rows = P.pack_documents(corpus, capacity=64).collect()
    check(rows, 64)
    texts = [(r.doc_id, r.text) for r in corpus.collect()]
    want = []
    for key, text in texts:
        ids = P.token_ids(text, P.rank_file())
        first = len(ids) % 64 or 64 if len(ids) > 64 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(key, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == sorted(want, key=str)


def test_sequences_round_trip(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i % 50)) for i in range(120)], "doc_id bigint, text string")
    packed = P.pack_documents(docs, capacity=100).cache()
    ids = {r.sequence_id: r.ids for r in P.sequences(docs, packed, capacity=100).collect()}
    for r in packed.collect():
        part = ids[r.sequence_id][r.offset:r.offset + r.length]
        assert zlib.crc32(array("I", part).tobytes()) == r.ids_crc32


@pytest.mark.parametrize("seed", range(3))
def test_sum_of_squares_choice_and_density(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 800)
    bins, offsets = P.sum_of_squares(sizes, 100)
    fill = np.bincount(bins, sizes)
    assert fill.max() <= 100 and len(fill) <= -(-sizes.sum() // 100) + 2
    # every choice against trying all open gaps
    gaps, got = {}, []
    for i in np.argsort(-sizes, kind="stable"):
        s = sizes[i]
        options = []
        for g in {v for v in gaps.values() if v >= s}:
            after = list(gaps.values())
            after[after.index(g)] -= s
            options.append((sum(n * n for v, n in zip(*np.unique([x for x in after if x], return_counts=True))), g))
        if offsets[i] == 0 and bins[i] not in gaps:
            assert not options
            gaps[bins[i]] = 100 - s
        else:
            best = min(o[0] for o in options)
            assert (100 - offsets[i]) in [g for o, g in options if o == best]
            gaps[bins[i]] -= s
        if len(got) > 150:
            break
        got.append(i)


def test_blocks_and_empty(spark, empty):
    pieces = spark.range(1000).selectExpr("id as doc_id", "0 as piece", "cast(id % 64 + 1 as bigint) as length")
    rows = P.pack(pieces, 64, block=100).collect()
    assert len(rows) == 1000 and check(rows, 64) <= 1.05 * -(-sum(r.length for r in rows) // 64)
    assert P.pack_documents(empty).count() == 0


def test_a_rank_file_without_its_json_raises(tmp_path):
    path = tmp_path / "ranks.tiktoken"
    path.write_text("")
    with pytest.raises(FileNotFoundError):
        P.added_tokens(str(path))
