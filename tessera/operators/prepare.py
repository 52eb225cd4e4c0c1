"""Prepare: label, balance, split, scale, one-hot and batch.

The balanced order gives every kept row a dense position ``pos`` without a
global sort: rows are ranked inside their class by a seeded md5 (ranked in
hash sub-buckets, see ``rank_in_groups``) and classes are interleaved, so
``pos = (rn - 1) * L + label_idx``.  Split and batch numbers are arithmetic
on ``pos``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import label_from_path, one_hot, scale_pixels
from tessera.functions.hashing import DEFAULT_SEED, seeded_md5
from tessera.operators.ordering import bits_for, rank_in_groups, sorted_index

TRAIN_WEIGHT = 80
TEST_WEIGHT = 20
BATCH_SIZE = 20


def with_labels(files: DataFrame, path_col: str = "path", out: str = "label") -> DataFrame:
    """label = parent folder name."""
    return files.withColumn(out, label_from_path(path_col))


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """P5 table: ``(label, label_idx)`` with labels in sorted order, 0-based.

    The distinct labels (an aggregate) are numbered by sorted ranges, so there
    may be as many labels as rows.  A null label comes first."""
    return sorted_index(df.select(label).distinct(), [label], "label_idx").withColumn("label_idx", F.col("label_idx").cast("int"))


def index_labels(df: DataFrame, label: str = "label", out: str = "label_idx") -> DataFrame:
    """P5: attach the class index of each row's label."""
    idx = label_index(df, label).withColumnRenamed("label_idx", out)
    return df.join(idx, label, "left")


@dataclass(frozen=True)
class MinMax:
    lo: float
    hi: float


def fit_min_max(df: DataFrame, col: str = "features") -> MinMax:
    """P8 fit: smallest and largest element over all arrays (two scalars)."""
    r = df.agg(F.min(F.array_min(col)).cast("double").alias("lo"),
               F.max(F.array_max(col)).cast("double").alias("hi")).first()
    return MinMax(r["lo"], r["hi"])


def apply_min_max(df: DataFrame, stats: MinMax, col: str = "features",
                  lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """P8 apply: ``(x - min) / (max - min)`` mapped onto [lo, hi]."""
    span = stats.hi - stats.lo
    if span == 0:
        scaled = F.transform(F.col(col), lambda x: F.lit(lo))
    elif lo == 0.0 and hi == 1.0:
        scaled = F.transform(F.col(col), lambda x: (x.cast("double") - F.lit(stats.lo)) / F.lit(span))
    else:
        scaled = F.transform(F.col(col), lambda x: (x.cast("double") - F.lit(stats.lo)) / F.lit(span)
                             * F.lit(hi - lo) + F.lit(lo))
    return df.withColumn(col, scaled)


@dataclass(frozen=True)
class Balance:
    per_class: int      # rows kept per class (the smallest class)
    n_classes: int
    n_train: int

    @property
    def n(self) -> int:
        return self.per_class * self.n_classes


def class_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """J3 table: ``(label, label_idx, class_n)``, one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_n"))
    return sorted_index(counts, [label], "label_idx").withColumn("label_idx", F.col("label_idx").cast("int"))


def balance_classes(df: DataFrame, label: str = "label", id_col: str = "id",
                    seed: int = DEFAULT_SEED, train: int = TRAIN_WEIGHT,
                    test: int = TEST_WEIGHT) -> tuple[DataFrame, Balance]:
    """B1 (+J3): shuffle with the seed, cut every class to the smallest class
    and interleave classes.

    Adds ``label_idx``, ``rn`` (1-based rank in its class) and ``pos``.
    Returns the frame and the class numbers (smallest class, class count,
    training rows) needed by the split.
    """
    sizes = class_sizes(df, label)
    agg = sizes.agg(F.min("class_n").alias("m"), F.max("class_n").alias("mx"),
                    F.count(F.lit(1)).alias("l")).first()
    m, n_cls = int(agg["m"] or 0), int(agg["l"] or 0)
    n = m * n_cls
    n_train = int(math.floor(train / (train + test) * n + 0.5))
    d = df.withColumn("__md5", seeded_md5(seed, id_col))
    ranked = rank_in_groups(d, [label], "__md5", [id_col], out="rn", bits=bits_for(agg["mx"] or 1), limit=m)
    kept = ranked.filter(F.col("rn") <= m).join(sizes.select(label, "label_idx"), label)
    out = kept.withColumn("pos", ((F.col("rn") - 1) * F.lit(n_cls) + F.col("label_idx")).cast("bigint"))
    return out.drop("__md5"), Balance(m, n_cls, n_train)


def split_train_test(balanced: DataFrame, bal: Balance) -> DataFrame:
    """B2: the first ``round(w * n)`` rows of the interleaved order train, the
    rest test.  Adds ``split`` and ``split_pos`` (position inside its set)."""
    is_train = F.col("pos") < F.lit(bal.n_train)
    return (balanced
            .withColumn("split", F.when(is_train, F.lit("train")).otherwise(F.lit("test")))
            .withColumn("split_pos", F.when(is_train, F.col("pos"))
                        .otherwise(F.col("pos") - F.lit(bal.n_train)).cast("bigint")))


def assign_batches(df: DataFrame, batch: int = BATCH_SIZE, pos_col: str = "split_pos") -> DataFrame:
    """Consecutive rows in groups of ``batch``; the last may be short."""
    return df.withColumn("batch_id", F.floor(F.col(pos_col) / F.lit(batch)).cast("bigint"))


def prepare_samples(images: DataFrame, n_classes: int | None = None, label: str = "label",
                    id_col: str = "id", pixels: str = "pixels", seed: int = DEFAULT_SEED,
                    batch: int = BATCH_SIZE, scale: bool = False,
                    train: int = TRAIN_WEIGHT, test: int = TEST_WEIGHT) -> tuple[DataFrame, Balance]:
    """Balanced, split, (optionally 0..255-scaled), one-hot, batched samples
    ``(id, pos, split, split_pos, batch_id, label, features, onehot)``."""
    bal_df, bal = balance_classes(images, label, id_col, seed, train, test)
    k = n_classes or bal.n_classes
    s = assign_batches(split_train_test(bal_df, bal), batch)
    feats = scale_pixels(pixels) if scale else F.col(pixels)
    out = s.select(
        F.col(id_col).alias("id"), "pos", "split", "split_pos", "batch_id",
        F.col("label_idx").alias("label"),
        feats.alias("features"),
        one_hot("label_idx", k).alias("onehot"),
    )
    return out, bal
