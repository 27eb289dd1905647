"""Portable linear classifiers: scores, softmax, top classes, fallback; fitting with MLlib; export and validation."""

from __future__ import annotations

import gzip
import json
import math
import os
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..sources.store import write_atomically

# Limits and names of the exported form.
FORMAT, VERSION, NGRAMS = "studyspark-linear-router", 2, [2, 5]
MOST_FEATURES, MOST_CLASSES, MOST_COEFFICIENTS, MOST_PACKED, MOST_RAW = 250_000, 128, 2_000_000, 64 << 20, 128 << 20
LEAST_CONFIDENCE = 0.35


def decision_scores(weights: DataFrame, coefficients: DataFrame, bias: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """``key, class, place, score`` for every document and class.

    ``weights``: key, gram, w; ``coefficients``: gram, coef array<double> (one per class, so the join keeps one row a gram);
    ``bias``: place, class, b. Documents without known grams keep the bias.
    """
    k = bias.count()
    small = coefficients.count() <= MOST_FEATURES
    joined = weights.join(F.broadcast(coefficients) if small else coefficients, "gram")
    sums = joined.groupBy(key).agg(*(F.sum(F.col("w") * F.get("coef", F.lit(i))).alias(f"s{i}") for i in range(k)))
    every = docs.select(key).distinct().join(sums, key, "left")
    long = every.select(key, F.posexplode(F.array(*(F.coalesce(f"s{i}", F.lit(0.0)) for i in range(k)))).alias("place", "s"))
    return long.join(F.broadcast(bias), "place").select(key, "class", "place", (F.col("s") + F.col("b")).alias("score"))


def probabilities(scores: DataFrame, key: str) -> DataFrame:
    """Adds ``p``: softmax, shifted by the largest score."""
    w = Window.partitionBy(key)
    e = F.exp(F.col("score") - F.max("score").over(w))
    return scores.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def top_classes(probs: DataFrame, key: str, k: int = 1) -> DataFrame:
    """The ``k`` likeliest classes of each document with their ``rank``; ties go to the earlier class."""
    if k < 1:
        raise ValueError("k must be at least 1")
    order = Window.partitionBy(key).orderBy(F.desc("p"), "place")
    return probs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def routes(probs: DataFrame, key: str, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``key, skill, confidence, needs_fallback`` from each document's likeliest class."""
    return top_classes(probs, key).select(key, F.col("class").alias("skill"), F.col("p").alias("confidence"), (F.col("p") < least).alias("needs_fallback"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``weight``: rows / (classes * rows of the label)."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    total = df.count()
    k = counts.count()
    return df.join(F.broadcast(counts) if k <= 10_000 else counts, label).withColumn("weight", F.lit(float(total)) / (k * F.col("__n"))).drop("__n")


def fit(vectors: DataFrame, label: str, features: str = "features", c: float = 4.0, iterations: int = 100):
    """Multinomial logistic regression of balanced classes; ``c`` as the inverse strength of the penalty on summed losses."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer

    rows = balanced_weights(vectors, label)
    indexer = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc").fit(rows)
    lr = LogisticRegression(featuresCol=features, labelCol="__label", weightCol="weight", family="multinomial", standardization=False, regParam=1 / (c * max(1, rows.count())), maxIter=iterations)
    return lr.fit(indexer.transform(rows)), indexer.labels


def payload(vocabulary: dict[str, int], idf: list[float], classes: list[str], coefficients: list[list[float]], intercepts: list[float], metadata: dict) -> dict:
    return {
        "format": FORMAT, "schema_version": VERSION, "metadata": metadata,
        "vectorizer": {"analyzer": "char", "norm": "l2", "ngram_range": NGRAMS, "vocabulary": vocabulary, "idf": idf},
        "classifier": {"classes": classes, "coefficients": coefficients, "intercepts": intercepts},
    }


def problems(model: object, labels: list[str] | None = None) -> list[str]:
    """What is wrong with an exported model; empty if it can be used."""
    out: list[str] = []

    def need(ok: bool, what: str) -> bool:
        if not ok:
            out.append(what)
        return ok

    def numbers(x: object, n: int) -> bool:
        return isinstance(x, list) and len(x) == n and all(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) for v in x)

    if not need(isinstance(model, dict), "not an object"):
        return out
    need(model.get("format") == FORMAT, "unknown format")
    need(model.get("schema_version") == VERSION and not isinstance(model.get("schema_version"), bool), "unknown version")
    need(isinstance(model.get("metadata"), dict), "metadata is not an object")
    v, c = model.get("vectorizer"), model.get("classifier")
    if not need(isinstance(v, dict) and isinstance(c, dict), "a part is missing"):
        return out
    need(v.get("analyzer") == "char" and v.get("norm") == "l2", "unknown analyzer or norm")
    need(v.get("ngram_range") == NGRAMS, "unknown n-gram range")
    grams, classes = v.get("vocabulary"), c.get("classes")
    if need(isinstance(grams, dict) and 0 < len(grams) <= MOST_FEATURES, "bad vocabulary"):
        need(all(isinstance(g, str) and NGRAMS[0] <= len(g) <= NGRAMS[1] for g in grams), "a gram of wrong length")
        need(sorted(x for x in grams.values() if isinstance(x, int) and not isinstance(x, bool)) == list(range(len(grams))), "indices are not 0 to n-1")
        need(numbers(v.get("idf"), len(grams)), "bad idf")
    if need(isinstance(classes, list) and 1 < len(classes) <= MOST_CLASSES and all(isinstance(x, str) for x in classes), "bad classes"):
        need(len(set(classes)) == len(classes), "repeated class")
        need(set(classes) == set(V.LEARNED_LABELS if labels is None else labels), "unexpected classes")
        need(numbers(c.get("intercepts"), len(classes)), "bad intercepts")
        rows = c.get("coefficients")
        n = len(grams) if isinstance(grams, dict) else 0
        need(len(classes) * n <= MOST_COEFFICIENTS, "too many coefficients")
        need(isinstance(rows, list) and len(rows) == len(classes) and all(numbers(r, n) for r in rows), "bad coefficients")
    meta = model.get("metadata") if isinstance(model.get("metadata"), dict) else {}
    held = meta.get("holdout_ids", [])
    need(isinstance(held, list) and len(set(map(str, held))) == len(held), "hold-out ids repeat")
    need(all(isinstance(i, str) and 0 < len(i) <= 256 for i in held) if isinstance(held, list) else False, "a hold-out id is no text of 1 to 256 characters")
    for name, kinds in (("seed", int), ("train_total", int), ("test_total", int), ("dataset_total", int), ("test_size", (int, float)), ("split", dict), ("dataset", str), ("dataset_sha256", str)):
        need(name not in meta or isinstance(meta[name], kinds) and not isinstance(meta[name], bool), f"metadata: {name} has another type")
    sha = meta.get("dataset_sha256")
    need(not isinstance(sha, str) or len(sha) == 64 and all(c in "0123456789abcdef" for c in sha), "metadata: dataset_sha256 is no SHA-256")
    size = meta.get("test_size")
    need(isinstance(size, bool) or not isinstance(size, (int, float)) or 0 < size < 1, "metadata: test_size must lie between 0 and 1")
    if "labels" in meta and isinstance(classes, list):
        need(isinstance(meta["labels"], list) and sorted(map(str, meta["labels"])) == sorted(map(str, classes)), "metadata: labels are not the classes")
    if out:
        return out
    if {"train_total", "test_total", "dataset_total"} <= set(meta):
        need(meta["train_total"] + meta["test_total"] == meta["dataset_total"], "totals don't add up")
        need(len(held) == meta["test_total"], "hold-out ids and test total differ")
    return out


def save(model: dict, path: str | os.PathLike, labels: list[str] | None = None) -> None:
    """The same bytes for the same model: sorted keys, no time stamp; written beside the target and renamed."""
    wrong = problems(model, labels)
    if wrong:
        raise ValueError("; ".join(wrong))
    raw = json.dumps(model, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()
    write_atomically(path, gzip.compress(raw, mtime=0))


def load(path: str | os.PathLike, labels: list[str] | None = None) -> dict:
    """A validated model; refuses pickles, what isn't a regular file, and more bytes than the limits, packed or not."""
    p = Path(path)
    if p.suffix in (".pkl", ".pickle", ".joblib"):
        raise ValueError("pickled models are refused")
    if not p.is_file() or p.is_symlink() or p.stat().st_size > MOST_PACKED:
        raise ValueError(f"{p} is not a regular file of allowed size")
    with gzip.open(p) as f:
        raw = f.read(MOST_RAW + 1)
    if len(raw) > MOST_RAW:
        raise ValueError("the model is too large")
    model = json.loads(raw)
    wrong = problems(model, labels)
    if wrong:
        raise ValueError("; ".join(wrong))
    return model


def tables(spark, model: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A loaded model as ``idf`` (gram, idf), ``coefficients`` (gram, coef) and ``bias`` (place, class, b)."""
    grams, idf = model["vectorizer"]["vocabulary"], model["vectorizer"]["idf"]
    rows = model["classifier"]["coefficients"]
    i = spark.createDataFrame([(g, float(idf[k])) for g, k in grams.items()], "gram string, idf double")
    c = spark.createDataFrame([(g, [float(r[k]) for r in rows]) for g, k in grams.items()], "gram string, coef array<double>")
    b = spark.createDataFrame([(n, x, float(y)) for n, (x, y) in enumerate(zip(model["classifier"]["classes"], model["classifier"]["intercepts"]))], "place int, class string, b double")
    return i, c, b
