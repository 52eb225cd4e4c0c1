"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``docs``.  A stage judges
its own input.  Null ids, null or empty texts, repeated rows, extra columns and
empty tables pass as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from tessera.llm.common import materialise, prepare
from tessera.plans.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected: no letters, or too little confidence."""
    prepare(spark)
    model = language_id.fit(docs)
    names = list(docs.columns)
    if {"lang_pred", "score", "rejected"} & set(names):  # columns of docs keep their values
        docs = docs.toDF(*[f"{c}__" if c in ("lang_pred", "score", "rejected") else c for c in names])
    return language_id.predict(docs, model).where(~F.col("rejected")).drop("lang_pred", "score", "rejected").toDF(*names)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the document with the smallest id."""
    prepare(spark)
    return exact_dedup.keep_first(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a similarity of 0.8, keep the one with the smallest id."""
    prepare(spark)
    return jaccard_join.keep_one(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item (0.8 of its 5-word shingles)."""
    prepare(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact), ("jaccard_join", drop_near),
          ("decontamination", drop_contaminated), ("packing", pack)]

#: A trained classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
