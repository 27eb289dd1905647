"""python -m studyspark.cli route|diagnose|score|review|remember|cases|train|predict|evaluate ...: the operators on single texts and small files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions import vocabulary as V
from .operators import dataset, diagnosis, linear, metrics, review, router, routing, rubric, scheduler
from .sources import jsonl, store


def _session() -> SparkSession:
    s = SparkSession.builder.appName("studyspark").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _cases(spark: SparkSession, path: str, fields: str, required: list[str], allowed: dict[str, list[str]] | None = None) -> DataFrame:
    good, bad = jsonl.checked(spark, path, StructType.fromDDL(fields), required, allowed)
    jsonl.raise_first(bad)
    return good


def _print(df: DataFrame) -> None:
    for line in df.select(F.to_json(F.struct("*"))).toLocalIterator():
        print(line[0])


def _judge(spark: SparkSession, a: argparse.Namespace, field: str, labels: list[str], run) -> int:
    if a.text is not None:
        _print(run(spark.createDataFrame([(a.text,)], "text string")).drop("text"))
        return 0
    cases = _cases(spark, a.eval, f"text string, {field} string, category string", ["text", field], {field: labels})
    result = metrics.accuracy(run(cases), field, "predicted")
    _print(result)
    return 0 if result.first()["accuracy"] >= a.min_accuracy else 1


def _score(spark: SparkSession, a: argparse.Namespace) -> int:
    cases = _cases(spark, a.suite, "id string, label string, name string, rubric string, text string, baseline boolean", ["text"])
    cases = cases.withColumn("called", F.coalesce("id", "label", "name"))
    blank = cases.where(F.trim("called") == "").orderBy("line").first()
    twice = dataset.repeated_keys(cases.where("called is not null").withColumn("called", F.trim("called")), "called").first()
    if blank is not None or twice is not None:
        raise ValueError(f"{a.suite}:{blank['line']}: the case's name is blank" if blank is not None else f"{a.suite}: case {twice['called']!r} stands {twice['n']} times")
    results = rubric.score(cases, baseline="baseline", strict=True)
    shown = results.withColumn("called", F.coalesce("called", F.lit("<case>")))
    if a.form == "markdown":
        print(rubric.markdown_report(shown, "called"))
    elif a.form == "text":
        for row in rubric.text_lines(shown, "called").toLocalIterator():
            print(row["line"])
    else:
        _print(shown.select("line", F.col("called").alias("id"), "used_rubric", "total", "max_score", "passed", "is_baseline", "scores"))
    s = rubric.summarize(results).first()
    if a.form == "json":
        print(json.dumps(s.asDict(), ensure_ascii=False))
    return 0 if s["judged"] and s["passed"] == s["judged"] else 1


def _items(spark: SparkSession, paths: list[str], words: bool) -> DataFrame:
    """Items of all files with ``keys``, the names they came with."""
    found = []
    for path in paths:
        value = store.read_json(path, [])
        if words and isinstance(value, dict) and not isinstance(value.get("words"), list):
            raise ValueError(f"{path}: a list, or an object with a list of words, is needed")
        found += store.items(value)
    columns = StructType.fromDDL(review.ITEM)
    return spark.createDataFrame([[*(x.get(f.name) for f in columns), [k for k in x]] for x in found], review.ITEM + ", keys array<string>")


def _review(spark: SparkSession, a: argparse.Namespace) -> int:
    stores = {}
    for name, paths in (("words", a.words or []), ("texts", a.texts or [])):
        df = _items(spark, paths, name == "words")
        bad = review.violations(df).first()
        if bad is not None:
            print(f"{', '.join(paths)}: {bad['problem']}", file=sys.stderr)
            return 1
        stores[name] = review.state(df, a.today).withColumn("name", review.word_name() if name == "words" else review.text_name())
    if a.report:
        files = jsonl.files_per_directory(spark, a.report) if a.report != "-" else None
        _print(review.learning_report(stores, a.today, files))
        return 0
    _print(review.summary(stores, a.today))
    for name, df in stores.items():
        _print(scheduler.due_queue(df, a.today, 8).select(F.lit(name).alias("due"), "name", "review_priority"))
        _print(scheduler.weakest(df, 5).select(F.lit(name).alias("weak"), "name", "review_priority"))
    return 0


def _remember(spark: SparkSession, a: argparse.Namespace) -> int:
    item = json.loads(a.item)
    if not isinstance(item, dict):
        raise ValueError("an item must be an object")
    columns = StructType.fromDDL(review.ITEM)
    df = spark.createDataFrame([[item.get(f.name) for f in columns]], columns)
    bad = review.violations(df).first()
    if bad is not None:
        raise ValueError(bad["problem"])
    after = scheduler.with_scores(scheduler.review(review.state(df, a.today), F.lit(a.quality), a.today), a.today).first().asDict()
    new = {k: str(v) if k in ("last_reviewed", "next_review") else v for k, v in after.items() if k not in item or item[k] != v}
    print(json.dumps({**item, **{k: v for k, v in new.items() if v is not None}}, ensure_ascii=False))
    return 0


def _library(spark: SparkSession, a: argparse.Namespace) -> int:
    fields = ", ".join(f"{f} string" for f in dataset.CASE_FIELDS)
    cases = dataset.case_library(_cases(spark, a.cases, fields, dataset.CASE_FIELDS))
    cases = dataset.filtered(cases, subject=a.subject, skill=a.skill)
    _print(dataset.profile(cases, "subject", "skill", "diagnosis") if a.summary else cases.orderBy("line").select(*dataset.CASE_FIELDS))
    return 0


def _learned(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        if a.command == "train":
            out = router.train(spark, a.dataset, a.artifact, a.report, a.seed, a.test_size, a.split_group)
        elif a.command == "evaluate":
            out = router.evaluate(spark, a.dataset, a.artifact, None if a.recompute_split else a.benchmark, a.seed, a.test_size, a.split_group)
        else:
            model = linear.load(a.artifact)
            df = spark.createDataFrame([(0, a.text)], "k int, text string")
            bad = router.quarantined(df)[1].first()
            if bad is not None:
                raise ValueError(bad["problem"])
            found = linear.top_classes(router.scores(df, model, "k"), "k", a.top_k).orderBy("rank").collect()
            out = {"skill": found[0]["class"], "confidence": found[0]["p"], "needs_fallback": found[0]["p"] < a.min_confidence, "top": [[r["class"], r["p"]] for r in found]}
    except (OSError, ValueError) as e:
        print(f"{a.command}: {e}", file=sys.stderr)
        return 2
    if a.command != "predict":
        out = {k: v for k, v in out.items() if k not in ("holdout_ids", "labels")}
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="studyspark")
    sub = p.add_subparsers(dest="command", required=True)
    for name, least in (("route", 0.9), ("diagnose", 0.85)):
        q = sub.add_parser(name)
        what = q.add_mutually_exclusive_group(required=True)
        what.add_argument("text", nargs="?")
        what.add_argument("--eval")
        q.add_argument("--min-accuracy", type=float, default=least)
    q = sub.add_parser("score")
    q.add_argument("suite")
    q.add_argument("--form", choices=("json", "text", "markdown"), default="json")
    r = sub.add_parser("review")
    r.add_argument("--words", action="append")
    r.add_argument("--texts", action="append")
    r.add_argument("--report", nargs="?", const="-", help="one report over all stores; with a folder, also the files of its directories")
    r.add_argument("--today", required=True)
    q = sub.add_parser("remember")
    q.add_argument("item")
    q.add_argument("--quality", type=int, required=True)
    q.add_argument("--today", required=True)
    q = sub.add_parser("cases")
    q.add_argument("cases")
    q.add_argument("--subject")
    q.add_argument("--skill")
    q.add_argument("--summary", action="store_true")
    groups = ("topic", "subject", "source", "none")
    q = sub.add_parser("train")
    for name in ("--dataset", "--artifact", "--report"):
        q.add_argument(name, required=True)
    q.add_argument("--seed", type=int, default=router.SEED)
    q.add_argument("--test-size", type=float, default=router.TEST_SIZE)
    q.add_argument("--split-group", choices=groups, default=router.GROUP)
    q = sub.add_parser("predict")
    q.add_argument("text")
    q.add_argument("--artifact", required=True)
    q.add_argument("--top-k", type=int, default=3)
    q.add_argument("--min-confidence", type=float, default=linear.LEAST_CONFIDENCE)
    q = sub.add_parser("evaluate")
    for name in ("--dataset", "--artifact"):
        q.add_argument(name, required=True)
    q.add_argument("--benchmark")
    q.add_argument("--recompute-split", action="store_true")
    q.add_argument("--seed", type=int)
    q.add_argument("--test-size", type=float)
    q.add_argument("--split-group", choices=groups)
    a = p.parse_args(argv)
    spark = _session()
    if a.command == "route":
        return _judge(spark, a, "skill", V.SKILLS, routing.route)
    if a.command == "diagnose":
        return _judge(spark, a, "label", list(V.DIAGNOSES), diagnosis.diagnose)
    run = {"score": _score, "review": _review, "remember": _remember, "cases": _library}.get(a.command, _learned)
    return run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
