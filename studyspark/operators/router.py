"""The learned router end to end: requests checked, a data set split, a model fitted, exported, verified, evaluated and replayed."""

from __future__ import annotations

import json
import math
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import vocabulary as V
from ..plans.shared import Kept
from ..sources import jsonl, store
from . import dataset, linear, metrics, splits, tfidf

#: Longest request in characters, and the largest report in bytes.
LONGEST, MOST_REPORT = 20_000, 16 << 20
SEED, TEST_SIZE, GROUP = 42, 0.2, "topic"
RECORD = "id string, text string, label string, category string, subject string, topic string, source string, hard_negative boolean"


def request_problem(text: Column) -> Column:
    """What is wrong with a request: null, blank or too long; null if nothing is."""
    return (
        F.when(text.isNull(), "the request is no text").when(T.stripped(text) == "", "the request is empty")
        .when(F.length(text) > LONGEST, F.concat(F.lit("the request has "), F.length(text).cast("string"), F.lit(f" characters; the limit is {LONGEST}")))
    )


def quarantined(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows whose request is usable, and the others with ``problem``; a bad row stops no batch."""
    marked = df.withColumn("problem", request_problem(F.col(text)))
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null")


def scores(df: DataFrame, model: dict, key: str, text: str = "text") -> DataFrame:
    """``key, class, place, score, p`` of all classes for every row, by a loaded or exported model.

    n-grams that the model doesn't know are dropped before the vector gets unit length; a text without known ones keeps the bias.
    """
    spark = df.sparkSession
    idf, coefficients, bias = linear.tables(spark, model)
    weights = tfidf.document_weights(df, key, idf, text)
    return linear.probabilities(linear.decision_scores(weights, coefficients, bias, df, key), key)


def predictions(df: DataFrame, model: dict, key: str, text: str = "text") -> DataFrame:
    """``key, skill, confidence, needs_fallback``; requests must be usable (see ``quarantined``)."""
    return linear.routes(scores(df, model, key, text), key)


def load_records(spark: SparkSession, path: str, labels: list[str] | None = None) -> DataFrame:
    """The data set's records with ``key`` (their own or a derived id); raises for a bad line, an empty file, repeated keys or other labels."""
    good, bad = jsonl.checked(spark, path, StructType.fromDDL(RECORD), ["text", "label"])
    jsonl.raise_first(bad)
    if good.isEmpty():
        raise ValueError(f"{path}: no records")
    rows = good.withColumn("key", dataset.record_keys(good, "id", "line", "text", "label"))
    twice = dataset.repeated_keys(rows, "key").first()
    if twice is not None:
        raise ValueError(f"{path}: record id {twice['key']!r} stands {twice['n']} times")
    off = dataset.label_set_differences(rows, "label", V.LEARNED_LABELS if labels is None else labels).collect()
    if off:
        raise ValueError(f"{path}: " + "; ".join(f"label {r['label']} is {r['problem']}" for r in off))
    return rows


def split_records(rows: DataFrame, test_size: float = TEST_SIZE, seed: int = SEED, group: str | None = GROUP) -> tuple[DataFrame, dict]:
    """``rows`` with ``split``, by groups of a column or (``group`` null or ``none``) by label alone, and a description of the split."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    if group in (None, "none"):
        return splits.stratified(rows, "key", "label", test_size, seed), {"strategy": "stratified_by_label", "group_field": None}
    if group not in rows.columns:
        raise ValueError(f"unknown group field: {group}")
    unit = F.coalesce(T.stripped(F.col(group)), F.lit(""))
    marked = rows.withColumn("__group", F.when(unit != "", F.lower(unit)).otherwise(F.concat(F.lit("record-id:"), F.col("key"))))
    return splits.grouped(marked, "key", "__group", "label", test_size, seed).drop("__group"), {"strategy": "group_holdout", "group_field": group}


def fitted(train: DataFrame, keep: Kept, metadata: dict | None = None, c: float = 4.0, iterations: int = 200) -> dict:
    """A model of ``train`` (key, text, label) in its exported form: character n-gram TF-IDF and a balanced linear classifier."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    counts = keep(tfidf.term_counts(train, "key"), "counts")
    idf = keep(tfidf.inverse_frequencies(counts, train.count()), "idf")
    size = idf.count()
    if size > linear.MOST_FEATURES:
        raise ValueError(f"{size} n-grams are more than a model may have ({linear.MOST_FEATURES})")
    vocabulary = keep(tfidf.vocabulary(idf), "vocabulary")
    weights = tfidf.weights(counts, vocabulary, "key").join(F.broadcast(vocabulary.select("gram", "idx")), "gram")
    vector = F.udf(lambda parts: SparseVector(size, [(int(p["idx"]), float(p["w"])) for p in parts]), VectorUDT())
    vectors = weights.groupBy("key").agg(vector(F.collect_list(F.struct("idx", "w"))).alias("features")).join(train.select("key", "label"), "key")
    model, classes = linear.fit(vectors, "label", c=c, iterations=iterations)
    grams = vocabulary.orderBy("idx").collect()
    matrix = model.coefficientMatrix.toArray()
    keep.free(counts, idf, vocabulary)
    return linear.payload(
        {r["gram"]: int(r["idx"]) for r in grams}, [float(r["idf"]) for r in grams], classes, [[float(x) for x in row] for row in matrix],
        [float(x) for x in model.interceptVector.toArray()], metadata or {},
    )


def quality(rows: DataFrame, predicted: DataFrame) -> dict:
    """Accuracy, averages, class report and slices of ``rows`` (key, label, ...) with ``predicted`` (key, skill)."""
    both = rows.join(predicted.select("key", F.col("skill").alias("predicted")), "key").withColumnRenamed("label", "expected")
    counts = metrics.confusion(both)
    report = metrics.class_report(counts)
    a, m = metrics.accuracy(both).first(), metrics.averages(report).first()
    out = {"total": a["total"], "accuracy": a["accuracy"], "macro_f1": m["macro_f1"], "weighted_f1": m["weighted_f1"]}
    out["classes"] = {r["label"]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in report.collect()}
    hard = metrics.slice_metrics(both, F.coalesce(F.col("hard_negative"), F.lit(False)) if "hard_negative" in both.columns else F.lit(False)).first()
    out["hard_negatives"] = hard.asDict()
    off = out["classes"].get("non-learning")
    out["non_learning_recall"] = off["recall"] if off else 0.0
    return out


def _same_file(a: Path, b: Path) -> bool:
    if a.resolve() == b.resolve():
        return True
    return a.exists() and b.exists() and os.path.samefile(a, b)


def check_paths(inputs: dict[str, str], outputs: dict[str, str], protected: tuple[str, ...] = ()) -> None:
    """Raises where an output is an input, another output or a protected file, links and other spellings of a path included."""
    named = [(n, Path(p)) for n, p in (*inputs.items(), *outputs.items())]
    for i, (n, p) in enumerate(named):
        for m, q in named[i + 1 :]:
            if _same_file(p, q):
                raise ValueError(f"{n} and {m} must be different files: {p}")
    for n, p in outputs.items():
        for q in protected:
            if _same_file(Path(p), Path(q)):
                raise ValueError(f"the {n} must not overwrite {q}")


def _holdout(rows: DataFrame) -> list[str]:
    return [r["key"] for r in rows.select("key").orderBy("line").collect()]


def train(spark: SparkSession, data: str, artifact: str, report: str, seed: int = SEED, test_size: float = TEST_SIZE, group: str | None = GROUP, labels: list[str] | None = None) -> dict:
    """Loads, splits, fits, exports, verifies and evaluates; writes the model and a report beside it, and gives the report.

    The exported model must classify the hold-out as the fitted one does. A model has a limit of size, and so has what it is trained on.
    """
    check_paths({"data set": data}, {"artifact": artifact, "report": report})
    keep = Kept(spark)
    wanted = V.LEARNED_LABELS if labels is None else labels
    rows = keep(load_records(spark, data, wanted), "records")
    marked, how = split_records(rows, test_size, seed, group)
    marked = keep(marked, "split")
    ours, held = marked.where("split = 'train'"), marked.where("split = 'test'")
    ids = _holdout(held)
    total = rows.count()
    meta = {
        "dataset": Path(data).name, "dataset_sha256": store.file_hash(data), "dataset_total": total, "train_total": total - len(ids), "test_total": len(ids),
        "holdout_ids": ids, "labels": sorted(wanted), "seed": seed, "test_size": test_size, "split": how,
    }
    model = fitted(ours.select("key", "text", "label"), keep, meta)
    linear.save(model, artifact, wanted)
    loaded = linear.load(artifact, wanted)
    after = keep(predictions(held.select("key", "text"), loaded, "key"), "predicted")
    before = predictions(held.select("key", "text"), model, "key")
    apart = after.join(before.select("key", F.col("skill").alias("other")), "key").where("skill <> other").count()
    if apart or after.count() != len(ids):
        raise ValueError(f"the exported model classifies {apart} of {len(ids)} records otherwise")
    out = {**meta, "artifact": {"file": Path(artifact).name, "sha256": store.file_hash(artifact), "format": linear.FORMAT, "schema_version": linear.VERSION}, "metrics": quality(held, after)}
    store.write_atomically(report, (json.dumps(out, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n").encode())
    return out


def recorded_holdout(report: str, data: str, rows: DataFrame) -> tuple[list[str], dict]:
    """The ids of a report's hold-out, after checking the report against the data set: hash, totals, ids, split."""
    path = Path(report)
    if path.suffix.lower() != ".json" or not path.is_file() or path.stat().st_size > MOST_REPORT:
        raise ValueError(f"{report} is no report file of allowed size")
    found = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError("a report must be an object")
    ids, n, m = found.get("holdout_ids"), found.get("dataset_total"), found.get("test_total")
    whole = all(isinstance(x, int) and not isinstance(x, bool) for x in (n, m, found.get("seed")))
    if found.get("dataset_sha256") != store.file_hash(data):
        raise ValueError("the report is about another data set")
    if not whole or n != rows.count():
        raise ValueError("the report's total is not that of the data set")
    if m <= 0 or not isinstance(ids, list) or len(ids) != m or not all(isinstance(x, str) and 0 < len(x) <= 256 for x in ids) or len(set(ids)) != m:
        raise ValueError("the report's hold-out ids are wrong")
    size = found.get("test_size")
    if isinstance(size, bool) or not isinstance(size, (int, float)) or not math.isfinite(size) or not 0 < size < 1 or not isinstance(found.get("split"), dict):
        raise ValueError("the report's split is wrong")
    listed = rows.sparkSession.createDataFrame([(x,) for x in ids], "key string")
    missing = splits.replay(rows.select("key"), "key", listed)[1].count()
    if missing:
        raise ValueError(f"{missing} hold-out ids are not in the data set")
    return ids, found


def evaluate(spark: SparkSession, data: str, artifact: str, report: str | None = None, seed: int | None = None, test_size: float | None = None, group: str | None = None, labels: list[str] | None = None) -> dict:
    """Quality of a saved model on the hold-out that ``report`` records, or on a new split if there is no report or any of its values is given.

    A recorded hold-out must be the one that the model says it wasn't trained on.
    """
    model = linear.load(artifact, labels)
    rows = load_records(spark, data, labels)
    meta = model["metadata"]
    sha = store.file_hash(data)
    if report is not None and seed is None and test_size is None and group is None:
        ids, found = recorded_holdout(report, data, rows)
        if meta.get("holdout_ids") != ids:
            raise ValueError("the model was trained with another hold-out than the report records")
        held = splits.replay(rows, "key", spark.createDataFrame([(x,) for x in ids], "key string"))[0]
        how = {**found["split"], "replayed": True, "seed": found["seed"], "test_size": found["test_size"]}
    else:
        size, start = TEST_SIZE if test_size is None else test_size, SEED if seed is None else seed
        marked, how = split_records(rows, size, start, GROUP if group is None else group)
        held, how = marked.where("split = 'test'"), {**how, "replayed": False, "seed": start, "test_size": size}
    result = quality(held, predictions(held.select("key", "text"), model, "key"))
    return {
        "artifact_sha256": store.file_hash(artifact), "dataset_sha256": sha, "dataset_matches_training": sha == meta.get("dataset_sha256"), "split": how,
        "test_total": result["total"], "metrics": result,
    }
