"""Curves, thresholds and classification metrics for 0/1 labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.columns import as_double, col
from tabprep.functions.running import ROWS_PER_BUCKET, running_totals
from tabprep.sources.storage import stored


@dataclass
class Cumulated:
    """One row per distinct score, highest first: true and false positives up to it."""

    rows: DataFrame
    positives: int
    negatives: int


def cumulate(df: DataFrame, label: str, score: str) -> Cumulated:
    """Combine rows by score before anything is ordered, then run totals over range buckets."""
    y = as_double(label)
    by_score = (df.where(col(score).isNotNull() & col(label).isNotNull())
                .groupBy(as_double(score).alias("threshold"))
                .agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg")))
    n, p, q = by_score.agg(F.count("*"), F.sum("pos"), F.sum("neg")).first()
    if n > ROWS_PER_BUCKET:
        by_score = stored(by_score, "scores")
    rows = running_totals(by_score, "threshold", {"pos": "tp", "neg": "fp"}, rows=n)
    return Cumulated(rows, p or 0, q or 0)


def roc_curve(df: DataFrame, label: str, score: str, with_start: bool = True) -> DataFrame:
    """``threshold, fpr, tpr`` for every distinct score, and the start point (infinity, 0, 0)."""
    c = cumulate(df, label, score)
    curve = c.rows.select("threshold", (F.col("fp") / F.lit(float(c.negatives or 1))).alias("fpr"),
                          (F.col("tp") / F.lit(float(c.positives or 1))).alias("tpr"))
    if not with_start:
        return curve
    start = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.union(curve)


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by trapezoids; each one needs only its own row's totals."""
    c = cumulate(df, label, score)
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    scale = float(c.positives * c.negatives) or 1.0
    return c.rows.agg((F.sum(area) / F.lit(scale)).alias("auc"))


def pr_curve(df: DataFrame, label: str, score: str, with_end: bool = True) -> DataFrame:
    """``threshold, precision, recall`` per distinct score, and the end point (1, 0)."""
    c = cumulate(df, label, score)
    curve = c.rows.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                          (F.col("tp") / F.lit(float(c.positives or 1))).alias("recall"))
    if not with_end:
        return curve
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return curve.union(end)


def best_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """Thresholds with the largest Youden J (the highest on ties) and the largest F1 (the lowest)."""
    c = cumulate(df, label, score)
    tpr = F.col("tp") / F.lit(float(c.positives or 1))
    fpr = F.col("fp") / F.lit(float(c.negatives or 1))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    f1 = 2 * precision * tpr / (precision + tpr + 1e-6)
    best = c.rows.agg(F.max(F.struct((tpr - fpr).alias("j"), F.col("threshold").alias("t"))).alias("a"),
                      F.max(F.struct(f1.alias("f"), (-F.col("threshold")).alias("t"))).alias("b"))
    start_wins = F.col("a.j") <= 0
    return best.select(
        F.when(start_wins, F.lit(float("inf"))).otherwise(F.col("a.t")).alias("threshold_j"),
        F.greatest(F.col("a.j"), F.lit(0.0)).alias("youden_j"),
        (-F.col("b.t")).alias("threshold_f1"), F.col("b.f").alias("f1"))


def threshold_predict(df: DataFrame, score: str, threshold: float, name: str = "predicted") -> DataFrame:
    return df.withColumn(name, F.when(col(score) >= threshold, 1).otherwise(0))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return (df.groupBy(col(actual).alias("actual"), col(predicted).alias("predicted"))
            .agg(F.count("*").alias("count")))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, their macro and weighted averages, and accuracy,
    balanced accuracy and the F1 of class 1. Everything follows from the confusion counts."""
    long = confusion_matrix(df, actual, predicted).select(F.inline(F.array(
        F.struct(F.col("actual").cast("string").alias("class"), F.col("count").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").cast("string").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("count").alias("predicted"), F.lit(0).cast("bigint").alias("hits")))))
    per = long.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    classes = per.select("class", precision.alias("precision"), recall.alias("recall"),
                         f1.alias("f1"), "support", "hits")
    w = F.col("support")
    total = F.sum(w)
    row = classes.agg(
        total.alias("n"), (F.sum("hits") / total).alias("acc"),
        F.avg(F.when(w > 0, F.col("recall"))).alias("balanced"),
        F.max(F.when(F.col("class") == "1", F.col("f1"))).alias("f1_one"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * w) / total).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")])

    def line(name: str, precision, recall, f1):
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"),
                        recall.alias("recall"), f1.alias("f1"), F.col("n").alias("support"))

    none = F.lit(None).cast("double")
    lines = row.select(F.inline(F.array(
        line("macro avg", *[F.col(f"macro_{m}") for m in ("precision", "recall", "f1")]),
        line("weighted avg", *[F.col(f"weighted_{m}") for m in ("precision", "recall", "f1")]),
        line("accuracy", none, none, F.col("acc")),
        line("balanced accuracy", none, none, F.col("balanced")),
        line("f1 of class 1", none, none, F.col("f1_one")))))
    return classes.drop("hits").union(lines)
