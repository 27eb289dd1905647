"""What a learner is stuck on: patterns counted per label, labels ranked by hits and priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V


def ranked(t: Column, patterns: dict[str, list[str]] = V.DIAGNOSIS_PATTERNS, priority: list[str] | None = None) -> Column:
    """array<struct(less, place, label, evidence)> of the labels with hits in the collapsed text, most hits first, then by priority."""
    order = priority or list(V.DIAGNOSES)
    each = []
    for place, label in enumerate(order):
        found = T.found_patterns(t, patterns[label])
        each.append(F.struct((-F.size(found)).alias("less"), F.lit(place).alias("place"), F.lit(label).alias("label"), found.alias("evidence")))
    return F.array_sort(F.filter(F.array(*each), lambda x: x["less"] < 0))


def diagnose(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``predicted``, ``name``, ``confidence``, ``evidence``, ``explanation`` and ``secondary`` (at most two labels).

    Confidence is 0.70, 0.85 or 0.95 for one, two or more hits; 0.35 without a hit and 0.2 for null or blank text, both with the
    default label.
    """
    r = df.withColumn("__t", T.collapsed(F.coalesce(F.col(text), F.lit(""))))
    r = r.withColumn("__ranked", ranked(F.col("__t")))
    best = F.get(F.col("__ranked"), F.lit(0))
    blank = F.col("__t") == ""
    hits = -best["less"]
    confidence = (
        F.when(blank, 0.2).when(best.isNull(), 0.35).when(hits == 1, 0.7).when(hits == 2, 0.85).otherwise(0.95)
    )
    label = F.coalesce(best["label"], F.lit(V.DEFAULT_DIAGNOSIS))
    names = F.create_map(*(F.lit(x) for k, (n, _) in V.DIAGNOSES.items() for x in (k, n)))
    explained = F.create_map(*(F.lit(x) for k, (_, e) in V.DIAGNOSES.items() for x in (k, e)))
    return r.withColumns(
        {
            "predicted": label,
            "name": names[label],
            "confidence": confidence,
            "evidence": F.coalesce(best["evidence"], F.array().cast("array<string>")),
            "explanation": explained[label],
            "secondary": F.transform(F.slice(F.col("__ranked"), 2, 2), lambda x: x["label"]),
        }
    ).drop("__ranked", "__t")
