"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so a MinHash of the document would
hold next to nothing of an item.  The sketch is taken of the item instead
(containment MinHash): its smallest shingle hashes, looked up in the whole
document.  Items are partitioned by size into classes of powers of two.  Of a
class with items of at most u shingles, an item with containment t misses at
most (1 - t) u shingles, so with a sketch of (1 - t) u + hits values at least
``hits`` of them are found: no containing document is lost, and a document with
fewer hits is not looked at again.  Candidates are verified by the exact
containment of the shingles themselves.

An item of fewer words than a shingle has is one shingle of all its words; the
documents' runs of as many words are looked up as well, for the few lengths that
such items have.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialise

SIZE, PERCENT = 5, 80
#: Sketch rows that are broadcast at most; beyond, documents and sketch are shuffled by hash.
SMALL = 1_000_000


def word_list(text: Column) -> Column:
    """Lower-case runs of letters and digits; null gives an empty list."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, size: int = SIZE) -> Column:
    """Shingle texts in order; fewer than ``size`` words are one shingle, none are none.

    ``words`` must be a plain column: it is read for every shingle.
    """
    n = F.size(words)
    whole = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))
    return F.when(n >= size, whole).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(hashes: Column, words: Column, size: int = SIZE) -> Column:
    """64-bit hashes of the shingles; ``hashes`` are those of the words."""
    n = F.size(hashes)
    whole = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    return F.when(n >= size, whole).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def short_runs(words: Column, lengths: list[int]) -> Column:
    """The texts of all runs of ``lengths`` words; ``words`` must be a plain column."""
    n, none = F.size(words), F.array().cast("array<string>")

    def runs(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))).otherwise(none)

    return F.concat(none, *[runs(k) for k in lengths])


def _hashed(df: DataFrame, text: str, words: str, word_hashes: str, out: str, size: int) -> DataFrame:
    d = df.withColumn(words, word_list(F.col(text)))
    d = d.withColumn(word_hashes, F.transform(words, lambda w: F.xxhash64(w)))
    return d.withColumn(out, shingle_hashes(F.col(word_hashes), F.col(words), size))


def item_sketches(items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per item: item, item_shingles (distinct), n, words, hits, sketch (empty without words)."""
    d = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    d = _hashed(d, "text", "w", "wh", "h", size)
    d = (d.withColumn("item_shingles", F.array_distinct(shingles(F.col("w"), size))).withColumn("h", F.array_distinct("h"))
         .withColumn("n", F.size("item_shingles")))
    most = F.pow(F.lit(2), F.floor(F.log2(F.greatest("n", F.lit(1)))) + 1).cast("int") - 1  # the class's largest size
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    d = d.withColumn("hits", F.least(need, F.when(F.col("n") < 8, 1).when(F.col("n") < 32, 2).otherwise(4)))
    missed = F.floor(most * (100 - percent) / 100).cast("int")
    return d.select("item", "item_shingles", "n", F.size("w").alias("words"), "hits", F.slice(F.array_sort("h"), 1, missed + F.col("hits")).alias("sketch"))


def containments(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Every item found in a document: doc, item, n_item, n_shared, and ``version`` (hash of the text).

    n_shared of an item's n_item distinct shingles occur in the document, at
    least ``percent`` in a hundred.  Words are lower-case runs of letters and
    digits.  An item of fewer than ``size`` words is one shingle, found wherever
    a document has these words in a row; without words it matches nothing, as a
    null text.  Null ids match like others.  Rows repeated in either table give one
    row.  Empty tables give no rows.
    """
    known = materialise(item_sketches(items, item_col, item_text, size, percent), "items").where("n > 0")
    # at most size - 1 numbers
    short = sorted(r[0] for r in known.where(F.col("words") < size).select("words").distinct().collect())
    probes = known.select("item", "hits", F.explode("sketch").alias("h")).distinct()
    if (known.agg(F.sum(F.size("sketch"))).first()[0] or 0) <= SMALL:
        probes = F.broadcast(probes)
    text = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    text = text.withColumn("version", F.xxhash64("text"))
    # explode_outer: explode would add a filter on the array, computed a second time below the projections
    hashed = _hashed(text, "text", "w", "wh", "h", size)
    if short:
        hashed = hashed.withColumn("h", F.concat("h", F.transform(short_runs(F.col("w"), short), lambda x: F.xxhash64(x))))
    found = hashed.select("doc", "version", F.explode_outer("h").alias("h"))
    candidates = materialise(found.join(probes, "h").groupBy("doc", "version", "item", "hits")
                             .agg(F.count_distinct("h").alias("found")).where("found >= hits").select("doc", "version", "item"), "candidates")
    some = candidates.select("doc", "version").distinct()
    again = (text.join(some, text.doc.eqNullSafe(some.doc) & (text.version == some.version), "left_semi")
             .dropDuplicates(["doc", "version"]).withColumn("w", word_list(F.col("text")))
             .withColumn("shingles", F.concat(shingles(F.col("w"), size), short_runs(F.col("w"), short))).drop("text", "w"))
    pairs = (candidates.withColumnRenamed("doc", "doc_").withColumnRenamed("version", "version_")
             .join(again, F.col("doc_").eqNullSafe(F.col("doc")) & (F.col("version_") == F.col("version")))
             .join(known.select(F.col("item").alias("item_"), "item_shingles", "n"), F.col("item").eqNullSafe(F.col("item_"))))
    pairs = pairs.withColumn("n_shared", F.size(F.array_intersect("item_shingles", "shingles")).cast("bigint"))
    return (pairs.where(F.col("n_shared") * 100 >= F.col("n") * percent)
            .select("doc", "version", "item", F.col("n").cast("bigint").alias("n_item"), "n_shared").distinct())


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    doc, version = fresh(docs, "__doc"), fresh(docs, "__version")
    bad = materialise(containments(docs, items, id_col, text_col, **how).select(F.col("doc").alias(doc), F.col("version").alias(version)).distinct(), "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(bad[doc]) & (F.xxhash64(docs[text_col]) == bad[version]), "left_anti")
