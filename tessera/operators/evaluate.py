"""Evaluation: confusion matrix and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(pred: DataFrame, actual: str = "actual", predicted: str = "predicted",
                     by: list[str] | None = None) -> DataFrame:
    """``(actual, predicted, n)`` counts (a partial + final hash aggregate)."""
    by = by or []
    return pred.groupBy(*by, actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(cm: DataFrame, classes: list[int]) -> DataFrame:
    """A7 wide form: one row per actual class, one column per predicted class."""
    return (cm.groupBy("actual").pivot("predicted", classes).agg(F.sum("n")).fillna(0))


def class_metrics(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A8 per class: ``(cls, n_true, n_pred, tp, precision, recall, f1)``.

    Classes are those seen as actual or predicted.  Precision is NULL for a
    class never predicted, recall NULL for a class never present.
    """
    by = by or []
    rows = cm.select(*by, F.col("actual").alias("cls"), F.col("n").alias("n_true"), F.lit(0).cast("bigint").alias("n_pred"),
                     F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("tp")) \
        .unionByName(cm.select(*by, F.col("predicted").alias("cls"), F.lit(0).cast("bigint").alias("n_true"),
                               F.col("n").alias("n_pred"), F.lit(0).cast("bigint").alias("tp")))
    per = rows.groupBy(*by, "cls").agg(F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"),
                                       F.sum("tp").alias("tp"))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred"))
    r = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true"))
    per = per.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision").isNull() | F.col("recall").isNull(), F.lit(None).cast("double")) \
        .when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)) \
        .otherwise(F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return per.withColumn("f1", f1)


def classification_metrics(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A8 summary: accuracy and macro precision / recall / F1 (mean over the
    classes where the value is defined)."""
    by = by or []
    per = class_metrics(cm, by)
    return per.groupBy(*by).agg(
        (F.sum("tp") / F.sum("n_true")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.count(F.lit(1)).alias("n_classes"),
        F.sum("n_true").alias("n"))
