"""Phrase collocations, counted in quotient filters of packed word numbers.

1. Documents become blocks of a bounded number of bytes where they lie.  A block
   keeps its text as codes of its own word list, and sends that list with counts
   to shards of words, by hash.  A shard numbers the words that occur often
   enough and answers each block with the numbers of its words.  A number stands
   for (language, word), so languages never mix.
2. For n = 2, 3, ... a block counts its n-grams of which both (n-1)-grams are
   frequent, in a quotient filter of packed word numbers for each shard.  A
   shard merges the sorted filters of all blocks, keeps the frequent n-grams and
   answers each block with one bit for each n-gram it sent.  The block drops the
   words that no frequent n-gram of two neighbours covers, so its text shrinks.
   An n-gram in a third of all documents costs one entry a block.
3. Parts of a frequent phrase are frequent, so all counts that a score needs are
   there.  Scores are exact: products in decimal(38), floored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.quotient_filter import QuotientFilter, distinct, pack, permute, restore, shard_of, unpack
from tessera.llm.textarrays import words as hashed

#: Phrases occur at least so often, and have at most so many words.
LEAST, LONGEST = 100, 5
#: Phrases listed of a language.
FIRST = 2000
#: Characters of a block's texts, of one run of them that is split at once, and n-grams or words that a shard counts, before repeats are joined.
BLOCK, PIECE, SHARD = 8 << 20, 1 << 20, 1 << 21
#: Parts in which the best of a language are found.
PARTS = 64

#: Fixed values of the rule: these bytes end a piece, tab and space a word; A-Z become a-z.
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_END = b"."
_BYTES = bytes.maketrans(_PIECE_ENDS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", _END * len(_PIECE_ENDS) + b" abcdefghijklmnopqrstuvwxyz")


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few whole bytes each as the largest needs."""
    size = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :size]).tobytes()


def _expand(data: bytes) -> np.ndarray:
    size = data[0]
    x = np.zeros(((len(data) - 1) // size, 8), np.uint8)
    x[:, :size] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, size)
    return x.view("<i8").reshape(-1)


# --- 1: blocks, their words, and shards of words --------------------------------

LISTED = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("langs", pa.list_(pa.string())), ("lang", pa.binary()),
                    ("words", pa.binary()), ("data", pa.binary())])
LISTED_SQL = "shard bigint, block bigint, langs array<string>, lang binary, words binary, data binary"


def _coded(texts) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The texts' words as numbers of a list (0: end of a piece), the list, and the numbers of each text."""
    chunks, tokens, sizes, size = [pa.array([_END], pa.binary()).dictionary_encode()], [], [], 0
    for text in texts:
        # space is the only white space left, so that split() without an argument splits there
        own = text.encode().translate(_BYTES).replace(_END, b" . ").split()
        own.append(_END)
        tokens += own
        sizes.append(len(own))
        size += len(text)
        if size >= PIECE:
            chunks.append(pa.array(tokens, pa.binary()).dictionary_encode())
            tokens, size = [], 0
    chunks.append(pa.array(tokens, pa.binary()).dictionary_encode())
    chunks = pa.chunked_array(chunks).unify_dictionaries().chunks
    return np.concatenate([c.indices.to_numpy() for c in chunks[1:]]).astype(np.int64), chunks[0].dictionary, np.array(sizes)


def _shorter(ids: np.ndarray) -> np.ndarray:
    """One 0 for each run of them."""
    return ids[np.append(True, (ids[1:] != 0) | (ids[:-1] != 0))] if len(ids) else ids


def _block(block: int, rows: list[tuple[str, str]], shard_bits: int) -> pa.RecordBatch:
    """The block's word lists, one row a shard, and its text (shard -1) as numbers of the lists one after another."""
    langs = sorted({r[0] for r in rows})
    at = {x: i for i, x in enumerate(langs)}
    codes, words, sizes = _coded(r[1] for r in rows)
    of = np.repeat([at[r[0]] for r in rows], sizes)
    is_word = codes != 0
    unique, inverse, counts = np.unique(of[is_word] * len(words) + codes[is_word], return_inverse=True, return_counts=True)
    lang = unique // len(words)
    listed = words.take(pa.array(unique % len(words))).to_pylist()
    _, _, h = hashed(np.frombuffer(b" ".join(listed), np.uint8))
    h ^= np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "big") for x in langs], np.uint64)[lang]
    order = np.argsort(h, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    ids = np.zeros(len(codes), np.int64)
    ids[is_word] = place[inverse]
    shards = shard_of(h[order], 64, shard_bits)
    cuts = np.append(np.flatnonzero(np.diff(shards, prepend=-1)), len(shards)).tolist()
    out = [(-1, block, None, None, None, _squeeze(_shorter(ids)))]
    for a, e in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:e]
        out.append((int(shards[a]), block, langs, _squeeze(lang[own]), b" ".join([listed[i] for i in own.tolist()]), _squeeze(counts[own])))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), LISTED, strict=True)], schema=LISTED)


def _blocks(batches, shard_bits: int, block_bytes: int):
    number, rows, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows.append((lang, text))
            size += len(text)
            if size >= block_bytes:
                yield _block(number, rows, shard_bits)
                number, rows, size = number + 1, [], 0
    if rows:
        yield _block(number, rows, shard_bits)


def _numbering(least: int, shard_bits: int):
    def step(table: pa.Table) -> pa.Table:
        """The shard's answers (the number of each word sent, 0 if it is not frequent), its frequent words (block -1) and all words' counts by language (-2)."""
        langs: dict[str, int] = {}
        lang, tokens, counts, sizes = [], [], [], []
        for row in table.select(["langs", "lang", "words", "data"]).to_pylist():
            own = np.array([langs.setdefault(x, len(langs)) for x in row["langs"]])
            tokens.append(pa.array(row["words"].split(b" "), pa.binary()).dictionary_encode())
            lang.append(own[_expand(row["lang"])])
            counts.append(_expand(row["data"]))
            sizes.append(len(counts[-1]))
        chunks = pa.chunked_array(tokens).unify_dictionaries().chunks
        words = chunks[0].dictionary
        lang, counts = np.concatenate(lang), np.concatenate(counts)
        key = lang * len(words) + np.concatenate([c.indices.to_numpy() for c in chunks])
        unique, inverse = np.unique(key, return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, inverse, counts)
        often = np.flatnonzero(total >= least)
        number = np.zeros(len(unique), np.int64)
        shard = table.column("shard")[0].as_py()
        number[often] = (np.arange(1, len(often) + 1) << shard_bits) | shard
        out, end = [], 0
        for block, size in zip(table.column("block").to_pylist(), sizes, strict=True):
            out.append((shard, block, None, None, None, _squeeze(number[inverse[end:end + size]])))
            end += size
        names, every = list(langs), np.zeros(len(langs), np.int64)
        np.add.at(every, lang, counts)
        out.append((shard, -2, names, None, None, _squeeze(every)))
        if len(often):
            listed = words.take(pa.array(unique[often] % len(words))).to_pylist()
            out.append((shard, -1, names, _squeeze(unique[often] // len(words)), b" ".join(listed), _squeeze(total[often])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), LISTED, strict=True)], schema=LISTED)
    return step


def _words(batches, shard_bits: int):
    for batch in batches:
        for row in batch.to_pylist():
            n = _expand(row["data"])
            ids = (np.arange(1, len(n) + 1) << shard_bits) | row["shard"]
            lang = pa.array(row["langs"], pa.string()).take(pa.array(_expand(row["lang"])))
            yield pa.record_batch([pa.array(ids), lang, pa.array(row["words"].split(b" "), pa.binary()).cast(pa.string()), pa.array(n)], names=["id", "lang", "word", "n"])


def _totals(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.record_batch([pa.array(row["langs"], pa.string()), pa.array(_expand(row["data"]))], names=["lang", "n"])


# --- 2: n-grams of a block, and shards ----------------------------------------

def _grams(ids: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """First words of all n-grams without a 0, and their permuted keys."""
    zeros, size = np.cumsum(ids == 0), max(0, len(ids) - n + 1)
    at = np.flatnonzero((ids[:size] != 0) & (zeros[n - 1:n - 1 + size] == zeros[:size]))
    return at, permute(pack([ids[at + k] for k in range(n)], bits), n * bits)


def _alive(ids: np.ndarray, n: int, bits: int, shard_bits: int, answers: pa.Table) -> np.ndarray:
    """The stretches of ``ids`` in which two neighbouring n-grams are frequent, 0 after each."""
    at, limbs = _grams(ids, n, bits)
    unique, place = distinct(limbs)
    shards, frequent = shard_of(unique[0], n * bits, shard_bits), np.zeros(len(unique[0]), bool)
    for shard, flags in zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist(), strict=True):
        lo, hi = np.searchsorted(shards, [shard, shard + 1])
        frequent[lo:hi] = np.unpackbits(np.frombuffer(flags, np.uint8), count=hi - lo).astype(bool)
    at = at[frequent[place]]
    if not len(at):
        return at
    new = np.append(True, np.diff(at) != 1)
    start = at[new]
    length = np.diff(np.append(np.flatnonzero(new), len(at)))
    start, length = start[length > 1], length[length > 1] + n  # the words of the stretch, and one 0
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out = ids[np.minimum(np.repeat(start, length) + within, len(ids) - 1)]
    out[np.cumsum(length) - 1] = 0
    return out


SENT = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
SENT_SQL = "shard bigint, block bigint, data binary"


def _filters(block: int, ids: np.ndarray, n: int, bits: int, shard_bits: int, with_text: bool) -> pa.Table:
    """Filters of the block's n-grams, one row a shard, and its text (shard -1) when there are any."""
    _, limbs = _grams(ids, n, bits)
    unique, place = distinct(limbs)
    counts = np.bincount(place, minlength=len(unique[0])).astype(np.int64)
    shards = shard_of(unique[0], n * bits, shard_bits)
    cuts = np.append(np.flatnonzero(np.diff(shards, prepend=-1)), len(shards)).tolist()
    which, data = [], []
    for a, e in zip(cuts[:-1], cuts[1:], strict=True):
        which.append(int(shards[a]))
        data.append(QuotientFilter(n * bits, shard_bits, which[-1], [x[a:e] for x in unique], counts[a:e]).to_bytes())
    if which and with_text:
        which.append(-1), data.append(_squeeze(ids))
    return pa.table([pa.array(which, pa.int64()), pa.array([block] * len(which), pa.int64()), pa.array(data, pa.binary())], schema=SENT)


def _numbered(text: pa.Table, answers: pa.Table) -> np.ndarray:
    """A block's text in word numbers, 0 for the end of a piece and for words that are not frequent."""
    answers = answers.filter(pc.equal(answers.column("n"), 1)).sort_by("shard")
    number = np.concatenate([[0], *[_expand(x) for x in answers.column("data").to_pylist()]])
    return _shorter(number[_expand(text.column("data")[0].as_py())])


def _pairs(bits: int, shard_bits: int):
    def step(text: pa.Table, answers: pa.Table) -> pa.Table:
        return _filters(text.column("block")[0].as_py(), _numbered(text, answers), 2, bits, shard_bits, False)
    return step


def _longer(n: int, bits: int, before: int, shard_bits: int):
    """What is left of a block after the answers on its (n-1)-grams, in ``before`` shard bits, and its n-grams."""
    def step(text: pa.Table, answers: pa.Table) -> pa.Table:
        flags = answers.filter(pc.equal(answers.column("n"), n - 1))
        if not text.num_rows or not flags.num_rows:
            return SENT.empty_table()
        ids = _numbered(text, answers) if n == 3 else _expand(text.column("data")[0].as_py())
        return _filters(text.column("block")[0].as_py(), _alive(ids, n - 1, bits, before, flags), n, bits, shard_bits, True)
    return step


def _merging(least: int):
    def step(table: pa.Table) -> pa.Table:
        """The shard's frequent n-grams (block -1), and the flags of each block that has any."""
        filters = [QuotientFilter.from_bytes(x) for x in table.column("data").to_pylist()]
        merged, place = QuotientFilter.merge(filters)
        frequent = merged.counts >= least
        ends = np.cumsum([len(f.counts) for f in filters])
        blocks, data = [], []
        for block, f, end in zip(table.column("block").to_pylist(), filters, ends.tolist(), strict=True):
            flags = frequent[place[end - len(f.counts):end]]
            if flags.any():
                blocks.append(block), data.append(np.packbits(flags).tobytes())
        if blocks:
            blocks.append(-1), data.append(merged.where(frequent).to_bytes())
        return pa.table([pa.array([merged.shard] * len(blocks), pa.int64()), pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], schema=SENT)
    return step


def _reading(n: int, bits: int):
    def rows(batches):
        """Rows (ids, n) of filters."""
        for batch in batches:
            for data in batch.column(0):
                f = QuotientFilter.from_bytes(data.as_py())
                ids = np.stack(unpack(restore(f.limbs, f.width), bits, n), axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * n, pa.int32()), pa.array(ids.reshape(-1)))
                yield pa.record_batch([lists, pa.array(f.counts, pa.int64())], names=["ids", "n"])
    return rows


def _shard_bits(entries: int, width: int) -> int:
    return min(width, 64, max(0, (-(-entries // SHARD) - 1).bit_length()))


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                     longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(phrases, words, totals)``: ids and n of each frequent phrase of 1 to ``longest`` words; id, lang, word and n of each
    frequent word; n, the number of all words, by lang.

    Everything is per language; a null language is ``und``.  A null or empty
    text has no words.  Repeated rows count each time.  No rows give empty tables.
    """
    d = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_bits = _shard_bits(size // 8, 32)
    block_bytes = BLOCK
    made = materialise(d.mapInArrow(lambda it: _blocks(it, word_bits, block_bytes), LISTED_SQL), "phrases")
    text = made.where("shard = -1").select("block", "data")
    listed = materialise(made.where("shard >= 0").groupBy("shard").applyInArrow(_numbering(least, word_bits), LISTED_SQL), "phrases")
    words = materialise(listed.where("block = -1").drop("block").mapInArrow(lambda it: _words(it, word_bits), "id bigint, lang string, word string, n bigint"), "phrases")
    totals = listed.where("block = -2").select("langs", "data").mapInArrow(_totals, "lang string, n bigint")
    totals = materialise(totals.groupBy("lang").agg(F.sum("n").alias("n")), "phrases")
    top, entries = words.agg(F.coalesce(F.max("id"), F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = top.bit_length()
    phrases = words.select(F.array("id").alias("ids"), "n")
    answers = listed.where("block >= 0").select(F.lit(1).alias("n"), "shard", "block", "data")
    for n in range(2, longest + 1):
        if not entries:
            break
        shard_bits = _shard_bits(entries, n * bits)
        step = _pairs(bits, shard_bits) if n == 2 else _longer(n, bits, before, shard_bits)
        sent = text.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(step, SENT_SQL)
        if n > 2:  # pairs are told from the first text, so that it isn't written a second time
            sent = materialise(sent, "phrases")
            text = sent.where("shard = -1").select("block", "data")
        merged = materialise(sent.where("shard >= 0").groupBy("shard").applyInArrow(_merging(least), SENT_SQL), "phrases")
        flags = merged.where("block >= 0").select(F.lit(n).alias("n"), "shard", "block", "data")
        answers, before = answers.unionByName(flags) if n == 2 else flags, shard_bits
        found = materialise(merged.where("block = -1").select("data").mapInArrow(_reading(n, bits), "ids array<bigint>, n bigint"), "phrases")
        phrases = phrases.unionByName(found)
        entries = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return materialise(phrases, "phrases"), words, totals


# --- 3: scores ------------------------------------------------------------------

def scored_phrases(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """ids, lang, a, l, r, n, score of the phrases of two words and more that no longer one contains as often.

    A longer phrase that occurs as often contains one a word longer that does,
    so prefixes and suffixes tell.  Of the cuts into two parts the one with the
    lowest floor(1000 * a * n / (l * r)) counts, then the shortest first part.
    """
    long = phrases.where(F.size("ids") > 1)
    inner = long.where(F.size("ids") > 2).select(F.explode(F.array(
        F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"), F.lit(None).cast("bigint").alias("a"), F.col("n").alias("longer"))
    kept = (long.select("ids", F.col("n").alias("a"), F.lit(None).cast("bigint").alias("longer")).unionByName(inner)
            .groupBy("ids").agg(F.max("a").alias("a"), F.max("longer").alias("longer")).where("longer IS NULL OR longer < a").drop("longer"))
    parts = kept.select("ids", "a", F.explode(F.expr(
        "flatten(transform(sequence(1, size(ids) - 1), k -> array(named_struct('k', k, 'first', true, 'part', slice(ids, 1, k)), "
        "named_struct('k', k, 'first', false, 'part', slice(ids, k + 1, size(ids) - k)))))")).alias("x")).select("ids", "a", "x.*")
    lang = words.select(F.array("id").alias("part"), "lang")
    counts = phrases.join(lang, phrases["ids"] == lang["part"], "left").select(F.col("ids").alias("part"), F.col("n").alias("m"), "lang")
    cuts = (parts.join(counts, "part").groupBy("ids", "k").agg(F.max("a").alias("a"), F.max(F.when(F.col("first"), F.col("m"))).alias("l"),
            F.max(F.when(~F.col("first"), F.col("m"))).alias("r"), F.max(F.when(F.col("first"), F.col("lang"))).alias("lang")))
    whole = (cuts.groupBy("ids").agg(F.max("a").alias("a"), F.max("lang").alias("lang"), F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
             .join(totals, "lang"))
    best = F.expr("array_min(transform(cuts, c -> named_struct('score', (cast(a AS decimal(19, 0)) * cast(n AS decimal(16, 0)) * 1000) "
                  "div (cast(c.l AS decimal(19, 0)) * cast(c.r AS decimal(19, 0))), 'k', c.k, 'l', c.l, 'r', c.r)))")
    return whole.withColumn("best", best).select("ids", "lang", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def _first_of(df: DataFrame, group: str, order: list, first: int) -> DataFrame:
    """The first rows of each group: the first of every part, then the first of those."""
    parts = df.withColumn("__part", F.pmod(F.xxhash64("ids"), F.lit(PARTS)))
    parts = parts.withColumn("__at", F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))).where(F.col("__at") <= first)
    return (parts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
            .where(F.col("rank") <= first).drop("__part", "__at"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST,
                 first: int = FIRST) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's ``first`` phrases by score and a (falling), then phrase.

    See ``frequent_phrases`` and ``scored_phrases`` for what counts.  The limit
    ``first`` is the report's; every phrase is counted and scored.
    """
    phrases, words, totals = frequent_phrases(docs, lang_col, text_col, least, longest)
    scored = materialise(scored_phrases(phrases, words, totals), "phrases")
    # rows below the score and count at the limit need no words; ties at the limit are all spelled out
    limit = (_first_of(scored, "lang", [F.desc("score"), F.desc("a")], first).groupBy("lang")
             .agg(F.min(F.struct("score", "a")).alias("limit")))
    near = scored.join(limit, "lang").where(F.struct("score", "a") >= F.col("limit")).drop("limit")
    spelled = (near.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
               .groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    near = near.join(spelled, "ids")
    out = _first_of(near, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], first)
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
