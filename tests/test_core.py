"""Reference-type operators on inline rows, against expected values, and every query against its SQL."""

import gzip
import hashlib
import json
import math
import os
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studyspark import queries as Q
from studyspark.functions import text as T
from studyspark.functions import vocabulary as V
from studyspark.operators import budget, dataset, diagnosis, documents, generator, linear, metrics, routing, rubric, scheduler, splits, tfidf
from studyspark.plans.shared import Kept
from studyspark.sources import jsonl, store


def one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# text


@pytest.mark.parametrize("text, plain", [("　A  b\n", "a b"), ("", ""), (" \t", ""), ("x  y", "x y")])
def test_normalized(spark, text, plain):
    assert one(spark, [(text,)], "t string").select(T.normalized(F.col("t"))).first()[0] == plain


# router


@pytest.mark.parametrize(
    "text, skill, confidence",
    [
        (None, "zero-base-learning", 0.2), ("  　", "zero-base-learning", 0.2), ("用 mistake-review 看看", "mistake-review", 1.0),
        ("serendipity", "word-deep-dive", 0.95), ("!abandon GRE", "word-deep-dive", 0.95), ("affect 和 effect 的区别", "word-deep-dive", 0.95),
        ("帮我背这段课文", "text-memorizer", 0.95), ("给我一个学习计划", "study-plan-builder", 0.9), ("每天的这题答案", "problem-solving", 0.9),
        ("这题我做错了", "mistake-review", 0.95), ("为什么矩阵可以用于旋转", "deepening-learning", 0.85), ("求解极限题", "problem-solving", 0.9),
        ("我学过但是懵", "fuzzy-understanding", 0.9), ("什么是导数", "zero-base-learning", 0.85), ("导数怎么理解？", "zero-base-learning", 0.65),
        ("hello there friend", "zero-base-learning", 0.4), ("elimination of terms please", "problem-solving", 0.9),
    ],
)
def test_route(spark, text, skill, confidence):
    r = routing.route(one(spark, [(text,)], "text string")).first()
    assert (r["predicted"], r["confidence"]) == (skill, confidence)


def test_route_names_its_rules(spark):
    r = routing.route(one(spark, [("做错了，扣分",)], "text string")).first()
    assert r["matched_rules"] == ["mistake:做错", "mistake:扣分"]


# diagnosis


@pytest.mark.parametrize(
    "text, label, confidence, secondary",
    [
        ("", "missing_prerequisite", 0.2, []), ("天气不错", "missing_prerequisite", 0.35, []), ("这两个我分不清", "concept_confusion", 0.7, []),
        ("会套公式", "formula_without_understanding", 0.85, []), ("只会背模板，一换题就错，∀是什么", "rote_no_transfer", 0.95, ["symbol_not_understood"]),
        ("推导时混淆", "concept_confusion", 0.7, ["derivation_gap"]),
    ],
)
def test_diagnose(spark, text, label, confidence, secondary):
    r = diagnosis.diagnose(one(spark, [(text,)], "text string")).first()
    assert (r["predicted"], r["confidence"], r["secondary"]) == (label, confidence, secondary)
    assert r["name"] == V.DIAGNOSES[label][0]


# metrics


def test_metrics_by_hand(spark):
    df = one(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "expected string, predicted string")
    assert metrics.accuracy(df).first()["accuracy"] == 0.5
    report = {r["label"]: r for r in metrics.class_report(metrics.confusion(df)).collect()}
    assert report["b"]["precision"] == pytest.approx(1 / 3) and report["b"]["recall"] == 1.0 and report["c"]["f1"] == 0.0
    avg = metrics.averages(metrics.class_report(metrics.confusion(df))).first()
    assert avg["macro_f1"] == pytest.approx((2 / 3 + 1 / 2 + 0) / 3)
    rows = {r["expected"]: r["row"] for r in metrics.matrix(metrics.confusion(df), ["a", "b", "c"]).collect()}
    assert rows == {"a": [1, 1, 0], "b": [0, 1, 0], "c": [0, 1, 0]}
    assert metrics.accuracy(df.where("false")).first()["accuracy"] == 0.0


# scheduler


STATE = "id string, review_count int, correct_streak int, interval_days int, ease_factor double, mastered boolean, next_review date"


def test_one_review_after_the_other(spark):
    df = one(spark, [("x", 0, 0, 1, 2.5, False, None)], STATE)
    seen = []
    for q in (5, 5, 5, 2):
        df = scheduler.review(df, F.lit(q), "2024-03-01")
        r = df.first()
        seen.append((r["correct_streak"], r["interval_days"], round(r["ease_factor"], 3)))
    assert seen == [(1, 1, 2.6), (2, 6, 2.7), (3, 17, 2.8), (0, 1, 2.48)]


def test_bounds_and_defaults(spark):
    r = scheduler.with_defaults(one(spark, [("x", None, 5, None, 0.5, None, None)], STATE)).first()
    assert (r["review_count"], r["interval_days"], r["ease_factor"], r["mastered"]) == (0, 1, 1.3, True)
    with pytest.raises(Exception, match="correct_streak"):
        scheduler.with_defaults(one(spark, [("x", 0, -1, 1, 2.5, False, None)], STATE)).collect()


def test_scores_are_monotone_and_bounded(spark):
    rows = [(str(d), 3, s, i, e, False, None) for d in range(3) for s in range(5) for i in (1, 10) for e in (1.3, 2.5)]
    df = one(spark, rows, STATE).withColumn("next_review", F.date_sub(F.lit("2024-03-01").cast("date"), F.col("id").cast("int") * 5))
    r = scheduler.with_scores(df, "2024-03-01").toPandas()
    assert r.forgetting_risk.between(0.01, 0.99).all() and r.review_priority.between(0, 1).all() and r.mastery_probability.between(0.03, 0.98).all()
    for _, g in r.groupby(["correct_streak", "interval_days", "ease_factor"]):
        assert g.sort_values("days_overdue").forgetting_risk.is_monotonic_increasing
    dated = df.withColumn("next_review", F.lit(None).cast("date"))
    assert set(scheduler.with_scores(dated, "2024-03-01").toPandas().days_overdue) == {1}


@pytest.mark.parametrize("s, ok", [("2024-02-29", True), ("2024-2-1", False), ("2023-02-29", False), ("", False), ("2024-02-01T00:00", False)])
def test_days(spark, s, ok):
    assert (one(spark, [(s,)], "s string").select(scheduler.day(F.col("s"))).first()[0] is not None) == ok


def test_queue_order_and_names(spark):
    rows = [("", 0, 0, 1, 2.5, False, None), ("b", 0, 0, 1, 2.5, False, None), ("m", 9, 9, 9, 2.5, True, None)]
    df = scheduler.with_scores(scheduler.with_defaults(one(spark, rows, STATE)), "2024-03-01").withColumn("word", F.lit("c"))
    assert [r["id"] for r in scheduler.due_queue(df, "2024-03-01", 5).collect()] == ["b", ""]
    assert scheduler.mastery_stats(df, "2024-03-01").first()["mastered_percent"] == 33.3


def test_fold_of_nothing_and_of_ties(spark):
    schema = "item string, at timestamp, tie long, quality int"
    assert scheduler.fold_reviews(one(spark, [], schema)).count() == 0
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, 2, 0), ("a", t, 1, 5), (None, t, 1, 5), ("b", None, 1, 5), ("b", t, 1, 9)]
    got = {r["item"]: r["correct_streak"] for r in scheduler.fold_reviews(one(spark, rows, schema)).collect()}
    assert got == {"a": 0, "b": 1}


# rubrics


TABLE = "| 常见错误 | 原因 | 正确理解 |\n|---|---|---|\n| 甲 | 乙 | 丙 |\n| 甲 | 乙 |  丙 |\n| 丁 | 戊 | 己 |\n| TODO | x | y |\n| ... | | |\n"


@pytest.mark.parametrize(
    "text, n",
    [(TABLE, 2), (TABLE.replace("常见错误", "别的"), 0), ("x\n\n" + TABLE + "\n后文\n" + TABLE + "| 庚 | 辛 | 壬 |", 3), ("", 0), ("|", 0), ("|a|b|", 0), (TABLE.replace("\n", "\r\n"), 2)],
)
def test_table_rows(spark, text, n):
    assert one(spark, [(text,)], "t string").select(rubric.misconception_rows(F.col("t"))).first()[0] == n


def test_gate_needs_the_table_and_no_cheering(spark):
    good = "诊断：先确认卡点？基础？\n类比，想象，比如，例如：步骤\n定义为满足则 ε\n变式：换成别的，自测。\n常见误区\n" + TABLE + "方法总结：关键\n" + "核心一句话总结\n" * 3
    rows = [(1, good, "concept"), (2, good + "加油", "concept"), (3, good.replace("丁", "甲").replace("戊", "乙").replace("己", "丙"), "Concept "), (4, good, "?"), (5, " ", "concept"), (6, good, None)]
    got = {r["n"]: (r["passed"], r["p0_passed"], r["total"]) for r in rubric.score(one(spark, rows, "n int, text string, rubric string")).collect()}
    assert got[1][0] and not got[2][0] and not got[3][0] and got[3][1] is False
    assert got[4] == (False, False, None) == got[5] and got[6] == got[1]


def test_markers(spark):
    df = one(spark, [("<!-- rubric: baseline -->\n<!-- rubric: fuzzy -->\nx<!-- eval:stop -->y",)], "t string")
    r = df.select(rubric.file_rubric(F.col("t")).alias("m"), rubric.scorable(F.col("t")).alias("s")).first()
    assert (r["m"]["rubric"], r["m"]["baseline"]) == ("fuzzy-understanding", True) and r["s"].endswith("x")


# data sets and splits


def test_first_of_each_keeps_order_and_drops_blank(spark):
    df = one(spark, [(3, " a"), (1, "a "), (2, "b"), (4, None), (5, "　")], "n int, text string")
    assert sorted(r["n"] for r in dataset.first_of_each(df, [F.col("n")]).collect()) == [1, 2]


def test_profile_counts_nulls_apart(spark):
    got = {(r["field"], r["value"]): r["n"] for r in dataset.profile(one(spark, [("a", None), ("a", "x"), (None, "x")], "p string, q string"), "p", "q").collect()}
    assert got == {("p", "a"): 2, ("p", None): 1, ("q", "x"): 2, ("q", None): 1, ("total", None): 3}


def test_stratified_is_exact_and_checks_its_size(spark):
    df = one(spark, [(i, "ab"[i % 2] if i < 95 else None) for i in range(100)], "k int, label string")
    got = splits.stratified(df, "k", "label").where("split = 'test'").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"a": math.ceil(48 * 0.2), "b": math.ceil(47 * 0.2)}
    with pytest.raises(ValueError):
        splits.stratified(df, "k", "label", 1.0)


def test_groups_stay_together(spark):
    df = one(spark, [(i, f"g{i % 23}", "xyz"[i % 23 % 3]) for i in range(460)] + [(900, "only", "w"), (901, "only", "w")], "k int, g string, label string")
    s = splits.grouped(df, "k", "g", "label", candidates=64)
    leak = splits.leakage(s.where("label <> 'w'"), "g").first()
    assert leak["groups_on_both_sides"] == 0 and 0.1 < s.where("split = 'test'").count() / s.count() < 0.3


def test_candidates_equal_plain_python_and_hash_groups_twice(spark):
    rows = [(f"g{i % 331}", "xyz"[i % 331 % 3]) for i in range(1500)] + [("g5", "x"), (None, "x"), ("g6", None)]
    found = splits.group_candidates(one(spark, rows, "g string, label string"), "g", "label", 0.2, 7, 16)
    known = [(g, x) for g, x in rows if g and x]
    groups, n = {g for g, _ in known}, Counter(x for _, x in known)
    want = {}
    for c in range(16):
        test = set(sorted(groups, key=lambda g: (hashlib.md5(f"7|{c}|{g}".encode()).hexdigest(), g))[: math.ceil(0.2 * len(groups))])
        t = Counter(x for g, x in known if g in test)
        if all(0 < t[x] < n[x] for x in n):
            want[c] = (abs(sum(t.values()) / len(known) - 0.2) + sum(abs(t[x] / n[x] - 0.2) for x in n) / len(n), len(test))
    got = {r["candidate"]: (r["score"], r["test_groups"]) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[c][1] == want[c][1] and got[c][0] == pytest.approx(want[c][0], abs=2e-9) for c in got)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= 2  # groups aren't hashed, ranked and shuffled again and again


@pytest.mark.parametrize("more", [[], ["text"]])
def test_group_split_equals_plain_python_and_works_its_rows_out_once(spark, more):
    data = [(i, f"g{i % 97}", "xyz"[i % 97 % 3], "t") for i in range(700)] + [(700 + i, "g1", "w", "t") for i in range(20)]
    data += [(800, None, "x", "t"), (801, "g3", None, "t"), (802, None, "w", "t"), (803, "g2", "x", "t"), (None, "g1", "w", "t")]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = one(spark, data, "k int, g string, label string, text string").repartition(3).mapInArrow(count, "k int, g string, label string, text string")
    split = splits.grouped(df.select("k", "g", "label", *more), "k", "g", "label", 0.2, 7, 16)
    got = sorted(map(tuple, split.drop("text").collect()), key=str)

    def unit(k, g, label):
        tail = ("record-id:", k) if label == "w" else ("field:", g)
        return None if label is None or tail[1] is None else f"{tail[0]}{tail[1]}"

    known = [(unit(*r[:3]), r[2]) for r in data if unit(*r[:3])]
    units, n, best = {u for u, _ in known if u}, Counter(x for _, x in known), None
    for c in range(16):
        test = set(sorted(units, key=lambda u: (hashlib.md5(f"7|{c}|{u}".encode()).hexdigest(), u))[: math.ceil(0.2 * len(units))])
        t = Counter(x for u, x in known if u in test)
        if all(0 < t[x] < n[x] for x in n):
            score = round(abs(sum(t.values()) / len(known) - 0.2) + sum(abs(t[x] / n[x] - 0.2) for x in n) / len(n), 9)
            best = min(best or (9, 0, None), (score, c, test), key=lambda b: b[:2])
    assert got == sorted(((k, g, x, "test" if unit(k, g, x) in best[2] else "train") for k, g, x, _ in data), key=str)
    assert seen.value == len(data) * (1 + len(more))  # other columns are read once more, at the end
    assert "Aggregate" not in split._jdf.queryExecution().optimizedPlan().toString()  # the last step only looks units up


def test_replay_reports_missing_ids(spark):
    there, missing = splits.replay(one(spark, [(1,), (2,)], "k int"), "k", one(spark, [(2,), (3,)], "key int"))
    assert [r["k"] for r in there.collect()] == [2] and [r["k"] for r in missing.collect()] == [3]


def test_templates(spark):
    topics = one(spark, [("极限", None)], "topic string, simple string")
    out = dataset.expand(topics, one(spark, [("{topic}从{simple}讲", "z")], "template string, label string"), ["topic", "simple"]).first()
    assert out["text"] == "极限从讲"


def test_label_sets(spark):
    d = {(r["label"], r["problem"]) for r in dataset.label_set_differences(one(spark, [("a",), ("x",)], "l string"), "l", ["a", "b"]).collect()}
    assert d == {("b", "missing"), ("x", "unexpected")}


# learned router


def _grams(t):
    return [t[i : i + n] for n in range(2, 6) for i in range(len(t) - n + 1)]


def test_idf_table_is_no_python_object_per_gram(spark, monkeypatch):
    """On the driver a million grams are Arrow columns; the weights are those of the join."""
    seen, sc = [], spark.sparkContext
    real = sc.broadcast
    monkeypatch.setattr(sc, "broadcast", lambda value: (seen.append(value), real(value))[1])
    df = one(spark, [(i, f"some words {i} 极限 {i % 7}") for i in range(50)], "k int, text string")
    counts = tfidf.term_counts(df, "k")
    idf = tfidf.inverse_frequencies(counts, 50)
    got = {(r["k"], r["gram"]): r["w"] for r in tfidf.document_weights(df, "k", idf).collect()}
    assert got == pytest.approx({(r["k"], r["gram"]): r["w"] for r in tfidf.weights(counts, idf, "k").collect()})
    assert len(seen) == 1 and len(seen[0]) == 1 and isinstance(seen[0]["table"], pa.Table)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab 中文", max_size=12), min_size=1, max_size=4))
def test_tfidf_equals_plain_python(spark, texts):
    df = one(spark, list(enumerate(texts)), "k int, text string")
    counts = tfidf.term_counts(df, "k")
    idf = tfidf.inverse_frequencies(counts, len(texts))
    got = {(r["k"], r["gram"]): r["w"] for r in tfidf.weights(counts, idf, "k").collect()}
    import re

    plain = [re.sub(r"\s\s+", " ", t.lower()) for t in texts]
    want = {}
    for k, t in enumerate(plain):
        v = {g: (1 + math.log(_grams(t).count(g))) * (math.log((1 + len(texts)) / (1 + sum(g in _grams(x) for x in plain))) + 1) for g in set(_grams(t))}
        n = math.sqrt(sum(x * x for x in v.values()))
        want |= {(k, g): x / n for g, x in v.items()}
    assert got == pytest.approx(want)


def test_norms_hold_no_vocabulary(spark, monkeypatch):
    """Norms equal those of plain Python; the driver sees frequencies by the piece, and no n-gram of a text is shuffled."""
    import re

    from pyspark.sql.classic.dataframe import DataFrame

    seen, real = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: (seen.append(found := real(df)), found)[1])
    monkeypatch.setattr(tfidf, "_PIECE", 100)
    texts = [f"Some  words {i} 极限 {i % 7} \U0001f600" * (1 + i % 3) for i in range(150)] + ["", "a", None, "ab", "ab", "ZZ top"]
    df = one(spark, list(enumerate(texts)), "k int, text string")
    norms = tfidf.norms(df, "k", Kept(spark))
    got = {r["k"]: (r["most"], r["total"]) for r in norms.collect()}
    plain = [re.sub(r"\s\s+", " ", (t or "").lower()) for t in texts]
    df_of = Counter(g for t in plain for g in set(_grams(t)))
    want = {}
    for k, t in enumerate(plain):
        raw = [(1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df_of[g])) + 1) for g, n in Counter(_grams(t)).items()]
        if raw:
            norm = math.sqrt(sum(x * x for x in raw))
            want[k] = (max(raw) / norm, sum(raw) / norm)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert len(seen) > 2 and max(len(t) for t in seen) < 300 and sum(len(t) for t in seen) == sum(n > 1 for n in df_of.values())


def test_tfidf_norms_shuffle_no_ngrams(spark, tiny):
    plan = Q.tfidf_norms(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "MapInArrow" in plan


def _model():
    return linear.payload({"ab": 0, "bc": 1}, [1.0, 1.5], ["p", "q"], [[1.0, 0.0], [0.0, 1.0]], [0.1, 0.1], {"train_total": 1, "test_total": 1, "dataset_total": 2, "holdout_ids": ["1"]})


def test_model_round_trip_is_byte_identical(spark, tmp_path):
    for n in ("a", "b"):
        linear.save(_model(), tmp_path / f"{n}.json.gz", ["p", "q"])
    assert (tmp_path / "a.json.gz").read_bytes() == (tmp_path / "b.json.gz").read_bytes()
    idf, coef, bias = linear.tables(spark, linear.load(tmp_path / "a.json.gz", ["p", "q"]))
    docs = one(spark, [(1, "abab"), (2, "bc"), (3, "zz"), (4, None)], "k int, text string")
    w = tfidf.weights(tfidf.term_counts(docs, "k"), idf, "k")
    p = linear.probabilities(linear.decision_scores(w, coef, bias, docs, "k"), "k")
    sums = p.groupBy("k").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == 4 and all(r["s"] == pytest.approx(1) for r in sums)
    got = {r["k"]: (r["skill"], r["needs_fallback"]) for r in linear.routes(p, "k", 0.6).collect()}
    assert got == {1: ("p", False), 2: ("q", False), 3: ("p", True), 4: ("p", True)}


@pytest.mark.parametrize(
    "change",
    [
        lambda m: m.update(format="other"), lambda m: m.update(schema_version=True), lambda m: m["vectorizer"].update(ngram_range=[1, 9]),
        lambda m: m["vectorizer"]["vocabulary"].update({"toolong": 2}), lambda m: m["vectorizer"].update(idf=[1.0, float("nan")]),
        lambda m: m["classifier"].update(classes=["p", "p"]), lambda m: m["classifier"].update(coefficients=[[1.0]]),
        lambda m: m["classifier"].update(intercepts=[True, 0.0]), lambda m: m["metadata"].update(holdout_ids=["1", "1"]), lambda m: m["metadata"].update(dataset_total=9),
    ],
)
def test_bad_models_are_refused(change):
    m = json.loads(json.dumps(_model()))
    change(m)
    assert linear.problems(m, ["p", "q"])


def test_load_refuses_pickles_and_large_files(tmp_path, monkeypatch):
    (tmp_path / "m.pkl").write_bytes(b"x")
    with pytest.raises(ValueError):
        linear.load(tmp_path / "m.pkl")
    monkeypatch.setattr(linear, "MOST_RAW", 10)
    (tmp_path / "m.gz").write_bytes(gzip.compress(b" " * 1000))
    with pytest.raises(ValueError):
        linear.load(tmp_path / "m.gz")


def test_fit_separates_classes(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([1.0, 0.1 * i]), "a") for i in range(8)] + [(Vectors.dense([-1.0, 0.1 * i]), "b") for i in range(4)]
    df = spark.createDataFrame(rows, ["features", "label"])
    model, labels = linear.fit(df, "label", iterations=30)
    assert labels == ["a", "b"] and model.predict(Vectors.dense([0.9, 0.0])) == 0.0
    weights = {r["label"]: r["weight"] for r in linear.balanced_weights(df, "label").collect()}
    assert weights == {"a": 0.75, "b": 1.5}


# generator and inline rubrics


def test_generated_requests(spark):
    topics = one(spark, [(1, "calculus", "极限", "极限", "极限和函数值", "求极限", "看错", "函数", None), (2, "odd", "极限", None, None, None, None, None, "easy")], "place long, subject string, topic string, simple string, pair string, problem string, mistake string, prerequisite string, difficulty string")
    words = one(spark, [(1, "cache", "buffer"), (2, "cache", "buffer")], "place long, word string, other string")
    passages = one(spark, [(1, "实践是检验真理的唯一标准，这是由真理的本性和实践的特点决定的")], "place long, text string")
    others = one(spark, [(1, "帮我写邮件"), (2, " "), (3, None), (4, " 帮我写邮件 ")], "place long, text string")
    got = generator.training_set(topics, words, passages, others, Kept(spark)).orderBy("id").collect()
    assert [r["id"] for r in got] == [f"router-train-{i:04d}" for i in range(1, len(got) + 1)] and len({r["text"] for r in got}) == len(got)
    templates = sum(map(len, generator.TEMPLATES.values()))
    by = {}
    for r in got:
        by.setdefault(r["label"], []).append(r)
    assert len(by["word-deep-dive"]) == 5 and len(by["text-memorizer"]) == 7 and [r["text"] for r in by["non-learning"]] == ["帮我写邮件"]
    assert sum(r["subject"] == "calculus" for r in got) == templates + 4
    assert sum(r["hard_negative"] for r in got if r["subject"] == "calculus") == 4 and by["non-learning"][0]["diagnosis"] is None
    first = got[0]
    assert first["text"] == "极限是什么？我第一次接触，想先知道它解决什么问题。" and first["diagnosis"] == "missing_prerequisite" and first["difficulty"] == "undergraduate"
    assert any(r["text"] == "为什么极限在高等数学里这么重要？想从多个角度理解。" and r["diagnosis"] == "concept_confusion" for r in got)
    assert all(r["topic"] == passages.first()["text"][:18] for r in by["text-memorizer"])


def test_markers_in_texts(spark):
    body = "常见误区\n| 常见错误 | 为什么错 | 正确理解 |\n|---|---|---|\n| a | b | c |\n| d | e | f |"
    told = f"<!-- rubric: Plan -->\n<!-- rubric: baseline -->\n{body}\n<!-- eval:stop -->\n显然"
    df = one(spark, [(1, told, None), (2, told.replace("<!-- rubric: baseline -->\n", ""), None), (3, body, "word"), (4, f"<!-- rubric: nothing -->\n{body}", None)], "id int, text string, rubric string")
    open_ = {r["id"]: r for r in rubric.score(df, inline=True, allow_inline_baseline=True, allow_stop=True).collect()}
    assert (open_[1]["used_rubric"], open_[1]["is_baseline"], open_[2]["used_rubric"], open_[3]["used_rubric"], open_[4]["used_rubric"]) == ("concept", True, "study-plan-builder", "word", None)
    assert open_[2]["style_passed"] and open_[2]["max_score"] == 20
    shut = {r["id"]: r for r in rubric.score(df, inline=True).collect()}
    assert not shut[1]["is_baseline"] and not shut[2]["style_passed"]
    with pytest.raises(Exception, match="unknown rubric"):
        rubric.score(df.where("id = 4"), inline=True, strict=True).collect()
    with pytest.raises(Exception, match="must not be blank"):
        rubric.score(one(spark, [(1, " ", None)], "id int, text string, rubric string"), strict=True).collect()
    said = rubric.markdown_report(rubric.score(df.where("id < 4"), inline=True), "id")
    assert said.startswith("# Eval report") and "| 3 | word |" in said


# budgets and documents


def test_greedy_passes_over_what_does_not_fit(spark):
    rows = [("g", 1, 60), ("g", 2, 50), ("g", 3, 40), ("h", 1, 200), ("h", 2, 1)]
    got = {(r["grp"], r["ord"]): r["kept"] for r in budget.fit(one(spark, rows, "grp string, ord long, tokens int"), 100).collect()}
    assert got == {("g", 1): True, ("g", 2): False, ("g", 3): True, ("h", 1): False, ("h", 2): True}
    kept = {(r["grp"], r["ord"]): (r["tokens"], r["used"]) for r in budget.fitting(one(spark, rows, "grp string, ord long, tokens int"), 100, Kept(spark), at_once=1).collect()}
    assert kept == {("g", 1): (60, 60), ("g", 3): (40, 100), ("h", 2): (1, 1)}


def test_budget_rounds_equal_the_fold(spark):
    rng = np.random.RandomState(4)
    rows = [(f"g{i % 3}", int(i), None if i % 97 == 0 else int(rng.randint(1, 60))) for i in range(600)] + [(None, 1, 5), ("g0", None, 5)]
    items = one(spark, rows, "grp string, ord long, tokens int")
    want = {tuple(r) for r in budget.fit(items, 900).where("kept").select("grp", "ord", "tokens", "used").collect()}
    assert {tuple(r) for r in budget.fitting(items, 900, Kept(spark), at_once=7).collect()} == want and len(want) > 20
    assert budget.fitting(items.limit(0), 900, Kept(spark)).count() == 0


def test_prompts_are_judged_as_a_whole():
    form = budget.target(" Generic ")
    whole, kept, short = budget.assemble(form, "rules", [("a", "x" * 400), ("b", "y")], "mem")
    assert kept == ["a", "b"] and not short and whole.endswith("# Memory Strategy\n\nmem\n") and whole.startswith("# Compiled prompt")
    most = budget._text_tokens(budget.assemble(form, "rules", [("b", "y")], "mem")[0])
    for least, want in ((most, ["b"]), (most - 1, [])):
        text, kept, short = budget.assemble(form, "rules", [("a", "x" * 400), ("b", "y")], "mem", least)
        assert kept == want and short and budget._text_tokens(text) <= least
    with pytest.raises(ValueError, match="unknown target"):
        budget.target("nothing")
    assert budget.target("x", {"x": budget.Target("x", "X", "x.md", files=False)}).file == "x.md"


def test_skill_names():
    assert budget.parsed_skills("zero, deep,zero") == ["zero-base-learning", "deepening-learning"]
    assert len(budget.parsed_skills("all")) == len(V.SKILLS) and budget.parsed_skills("") == ["scientific-learning"]
    with pytest.raises(ValueError):
        budget.parsed_skills("nothing")


CONTRACT = "常见误区，至少 2 条\n| 常见错误 | 为什么错 | 正确理解 |\n|---|---|---|\n| a | b | c |\n| d | e | f |"


@pytest.mark.parametrize(
    "text, name, errors",
    [
        ("---\nname: a-b\ndescription: d\n---\n" + CONTRACT, "a-b", []), ("no", "a", ["no front matter"]), ("---\nname: a\n", "a", ["front matter has no end"]),
        ("---\nname: a\ndescription: d\n---\n \n", "a", ["the body is empty"]), ("---\nname: a\nname: a\ndescription: d\n---\n" + CONTRACT, "a", ["repeated key"]),
        ("---\nname: a\ndescription: d\nmetadata:\n  x: 1\n  x: 2\n---\n" + CONTRACT, "a", ["repeated key"]), ("---\nname: a\ndescription: d\nstray\n---\n" + CONTRACT, "a", ["front matter is no mapping"]),
        ("---\nname: a\ndescription: d\n---\n" + CONTRACT.replace("| e |", "| |"), "a", ["no table of two misconceptions"]),
        ("---\nname: a\ndescription: d\n---\n" + CONTRACT.replace("|---|---|---|\n", ""), "a", ["no table of two misconceptions"]),
        ("---\nname: a\ndescription: d\n---\n" + CONTRACT.replace("至少 2 条", ""), "a", ["the least number of misconceptions is not said"]),
        ("---\nname: a\ndescription: d\n---\n" + CONTRACT.replace("常见错误", "错误"), "a", ["no table of two misconceptions"]),
        ("---\nname: scientific-learning\ndescription: d\n---\nbody", "scientific-learning", []),
        ("---\nname: A b\ndescription: <d>\nx: 1\n---\nbody", "c", ["unexpected keys: x", "name is not in lower case with hyphens", "name and directory differ", "description has angle brackets", "no section on misconceptions", "no table of two misconceptions"]),
        (None, "a", ["no front matter"]),
    ],
)
def test_document_contract(spark, text, name, errors):
    assert documents.errors(one(spark, [(text, name)], "text string, name string")).first()["errors"] == errors


# sources


def test_json_lines_are_strict(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "a.jsonl").write_text('{"text": "x", "n": 1}\n\n{"text": 5}\n{"text": " "}\nnope\n{"text": "y", "n": true}\n{"n": 2}\n{"text": "z", "skill": "q"}\n', encoding="utf-8")
    good, bad = jsonl.checked(spark, str(tmp_path / "a.jsonl"), StructType.fromDDL("text string, n int, skill string"), ["text"], {"skill": ["a"]})
    assert [(r["line"], r["text"], r["n"]) for r in good.orderBy("line").collect()] == [(1, "x", 1)]
    assert [(r["line"], r["problem"]) for r in bad.orderBy("line").collect()] == [
        (3, "text is not of type string"), (4, "text is blank"), (5, "not a JSON object"), (6, "n is not of type int"), (7, "text is missing"), (8, "skill is unknown"),
    ]
    with pytest.raises(ValueError, match=r"a.jsonl:3: text"):
        jsonl.raise_first(bad)
    jsonl.write(one(spark, [("b", 1)], "z string, a int"), str(tmp_path / "out"))
    assert [p.read_text() for p in (tmp_path / "out").glob("*.txt") if p.stat().st_size] == ['{"a":1,"z":"b"}\n']


def test_files(spark, tmp_path):
    for d, n in (("x", "a.json"), ("x", "README.md"), ("y", "b.md")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / n).write_text("t")
    (tmp_path / "x" / "deeper").mkdir()
    (tmp_path / "x" / "deeper" / "c.md").write_text("t")
    (tmp_path / "y" / "README.old.md").write_text("t")
    assert {r["directory"]: r["files"] for r in jsonl.files_per_directory(spark, str(tmp_path)).collect()} == {"x": 1, "y": 2}
    assert jsonl.documents(spark, str(tmp_path)).count() == 4


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    for name, n in (("a", 4000), ("b", 3)):
        (tmp_path / f"{name}.txt").write_text("".join("\n" if i % 10 == 9 else f"{name}{i}\n" for i in range(n)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = jsonl.lines(spark, str(tmp_path)).collect()
        assert jsonl.lines(spark, str(tmp_path)).rdd.getNumPartitions() >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(f"{name}.txt", i + 1, f"{name}{i}") for name, n in (("a", 4000), ("b", 3)) for i in range(n) if i % 10 != 9}
    assert {(r["path"].rsplit("/", 1)[-1], r["line"], r["value"]) for r in got} == want


def test_store(tmp_path, monkeypatch):
    p = tmp_path / "m.json"
    assert store.read_json(p, [1]) == [1]
    store.write_json(p, {"words": [{"id": "a"}]})
    store.write_json(p, [])
    assert store.read_json(p, None) == [] and json.loads((tmp_path / "m.json.bak").read_text()) == {"words": [{"id": "a"}]}
    p.write_text("{")
    with pytest.raises(ValueError):
        store.read_json(p, [])
    with pytest.raises(ValueError):
        store.read_json(tmp_path, [])
    monkeypatch.setattr(store, "MOST_BYTES", 0)
    with pytest.raises(ValueError):
        store.read_json(p, [])
    assert store.items({"words": [{"a": 1}]}) == [{"a": 1}] == store.items({"k": {"a": 1}})
    with pytest.raises(ValueError):
        store.items([1])
    assert len(store.file_hash(__file__)) == 64


def test_stream_of_reviews_equals_the_fold(spark, tmp_path):
    from studyspark.streaming import reviews

    source, out = tmp_path / "in", tmp_path / "out"
    rows = spark.sql("select 'a' item, timestamp'2024-01-01' + make_interval(0,0,0,id) at, id tie, cast(id % 6 as int) quality from range(20)")
    rows.coalesce(1).write.parquet(str(source))
    stream = reviews.states(spark.readStream.schema(rows.schema).parquet(str(source)))
    stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(str(out))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    got, want = spark.read.parquet(str(out)).collect(), scheduler.fold_reviews(rows).collect()
    assert [(r["reviews"], r["correct_streak"], r["ease_factor"]) for r in got] == [(r["reviews"], r["correct_streak"], r["ease_factor"]) for r in want]


# every query with SQL


def _rows(df):
    def plain(v):
        if v is None or v != v:
            return "NULL"
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, tiny, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(tiny).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = Q.QUERIES[name](spark, tiny).toPandas(), con.execute(Q.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_entry_works_with_and_without_the_subpackage(spark, tiny):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists(Path(e.__file__).parent / "bench.py")
