"""Counts of expected and predicted classes, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """``expected, predicted, n``; one shuffle of pre-aggregated counts. All other metrics start here."""
    return df.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """One row: ``total, correct, accuracy``; accuracy is 0.0 without rows."""
    right = F.count_if(F.col(expected) == F.col(predicted))
    return df.agg(F.count("*").alias("total"), right.alias("correct")).withColumn(
        "accuracy", F.coalesce(F.try_divide(F.col("correct"), F.col("total")), F.lit(0.0))
    )


def class_report(counts: DataFrame) -> DataFrame:
    """From ``confusion``: precision, recall, f1 and support of every class that is expected or predicted; 0.0 where undefined."""
    as_expected = counts.groupBy(F.col("expected").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n"))).alias("right"))
    as_predicted = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted_n"))
    both = as_expected.join(as_predicted, "label", "full")
    right, support, chosen = (F.coalesce(F.col(c), F.lit(0)) for c in ("right", "support", "predicted_n"))
    precision, recall = (F.coalesce(F.try_divide(right, n), F.lit(0.0)) for n in (chosen, support))
    f1 = F.coalesce(F.try_divide(2 * right, chosen + support), F.lit(0.0))
    return both.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), support.cast("bigint").alias("support"))


def averages(report: DataFrame) -> DataFrame:
    """One row: ``macro_f1, weighted_f1`` of a class report."""
    return report.agg(
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"),
    )


def matrix(counts: DataFrame, labels: list[str]) -> DataFrame:
    """The confusion matrix: a row per label of ``labels``, with an array of counts in their order."""
    cells = [F.coalesce(F.sum(F.when(F.col("predicted") == p, F.col("n"))), F.lit(0)).cast("bigint") for p in labels]
    all_labels = counts.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], "expected string, place int")
    rows = counts.groupBy("expected").agg(F.array(*cells).alias("row"))
    return F.broadcast(all_labels).join(rows, "expected", "left").select(
        "place", "expected", F.coalesce("row", F.array_repeat(F.lit(0).cast("bigint"), len(labels))).alias("row")
    )


def slice_metrics(df: DataFrame, condition, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """One row: ``rows, accuracy, macro_f1`` of the rows with the condition; macro F1 is over labels that occur there."""
    part = df.where(condition)
    a = accuracy(part, expected, predicted).select(F.col("total").alias("rows"), "accuracy")
    return a.crossJoin(averages(class_report(confusion(part, expected, predicted))).select("macro_f1"))
