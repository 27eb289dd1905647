import json

import pytest
from pyspark.sql import functions as F

from studyspark import cli
from studyspark.operators import dataset, review, router
from studyspark.plans.shared import Kept


def test_route_and_its_gate(spark, tmp_path, capsys):
    assert cli.main(["route", "这题做错了"]) == 0
    assert json.loads(capsys.readouterr().out)["predicted"] == "mistake-review"
    f = tmp_path / "cases.jsonl"
    f.write_text('{"text": "做错了", "skill": "mistake-review"}\n{"text": "做错了", "skill": "problem-solving"}\n', encoding="utf-8")
    assert cli.main(["route", "--eval", str(f)]) == 1 and cli.main(["route", "--eval", str(f), "--min-accuracy", "0.5"]) == 0
    assert '"accuracy":0.5' in capsys.readouterr().out
    f.write_text('{"text": "x", "skill": "nothing"}\n')
    with pytest.raises(ValueError, match="cases.jsonl:1"):
        cli.main(["route", "--eval", str(f)])


def test_diagnose_and_score(spark, tmp_path, capsys):
    assert cli.main(["diagnose", "分不清"]) == 0
    f = tmp_path / "suite.jsonl"
    f.write_text('{"text": "short", "rubric": "concept"}\n{"text": "x", "baseline": true}\n')
    assert cli.main(["score", str(f)]) == 1
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["baseline"] == 1
    assert cli.main(["score", str(f), "--form", "markdown"]) == 1 and "| <case> | concept |" in capsys.readouterr().out
    assert cli.main(["score", str(f), "--form", "text"]) == 1 and "BASELINE" in capsys.readouterr().out
    f.write_text('{"text": "a", "id": "x"}\n{"text": "b", "name": "x "}\n')
    with pytest.raises(ValueError, match="stands 2 times"):
        cli.main(["score", str(f)])


def test_review(spark, tmp_path, capsys):
    w = tmp_path / "w.json"
    w.write_text(json.dumps({"words": [{"word": "a", "review_count": 3}, {"word": "b", "mastered": True, "next_review": "2024-05-01"}]}))
    assert cli.main(["review", "--words", str(w), "--today", "2024-03-01"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.strip().split("\n")]
    assert {r["store"]: (r["total"], r["due"]) for r in rows if "store" in r} == {"words": (2, 1), "all": (2, 1)}
    t = [tmp_path / "q.json", tmp_path / "p.json"]
    t[0].write_text(json.dumps([{"title": "", "content": "c", "review_count": 2}]))
    t[1].write_text(json.dumps({"k": {"content": "d", "correct_streak": 7}}))
    assert cli.main(["review", "--words", str(w), "--texts", str(t[0]), "--texts", str(t[1]), "--today", "2024-03-01", "--report"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.strip().split("\n")]
    assert {(r["store"], r["name"]) for r in rows if r["section"] == "weak"} == {("words", "a"), ("texts", "")}
    assert [(r["store"], r["name"]) for r in rows if r["section"] == "stable"] == [("texts", "d"), ("words", "b")]
    assert [r["name"] for r in rows if r["section"] == "attention"] == ["", "a"] or len([r for r in rows if r["section"] == "attention"]) == 2
    w.write_text(json.dumps([{"word": "a", "next_review": "soon"}]))
    assert cli.main(["review", "--words", str(w), "--today", "2024-03-01"]) == 1


def test_bars_and_numbers(spark):
    df = spark.createDataFrame([(1, 2), (0, 0), (5, 5)], "v int, t int")
    assert [r[0].count("█") for r in df.select(review.bar(F.col("v"), F.col("t"))).collect()] == [10, 0, 20]
    rows = spark.range(0, 1000, 1, 7).select((F.lit(999) - F.col("id")).alias("k"))
    got = dataset.numbered(rows, [F.col("k")], Kept(spark)).orderBy("k").collect()
    assert [r["id"] for r in got] == [f"{i:04d}" for i in range(1, 1001)]


def test_one_review_and_the_case_library(spark, tmp_path, capsys):
    assert cli.main(["remember", '{"word": "a", "correct_streak": 1, "note": "n"}', "--quality", "5", "--today", "2024-03-01"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert (got["correct_streak"], got["interval_days"], got["next_review"], got["note"]) == (2, 6, "2024-03-07", "n")
    with pytest.raises(ValueError, match="out of bounds"):
        cli.main(["remember", '{"review_count": -1}', "--quality", "5", "--today", "2024-03-01"])
    case = {"id": "1", "subject": "s", "scenario": "x", "prompt": "p", "skill": "problem-solving", "diagnosis": "derivation_gap", "rubric": "concept"}
    f = tmp_path / "c.jsonl"
    f.write_text("\n".join(json.dumps({**case, "id": i, "subject": "s" if i == "1" else "t"}) for i in "123"))
    assert cli.main(["cases", str(f), "--subject", "t"]) == 0 and len(capsys.readouterr().out.strip().split("\n")) == 2
    assert cli.main(["cases", str(f), "--summary"]) == 0 and '"n":3' in capsys.readouterr().out
    for wrong, said in (({**case, "id": "2", "skill": "x"}, "c.jsonl:2: unknown skill x"), (case, "c.jsonl:1: repeated id 1"), ({**case, "id": None}, "c.jsonl:2: id is missing")):
        f.write_text(json.dumps(case) + "\n" + json.dumps(wrong))
        with pytest.raises(ValueError, match=said):
            cli.main(["cases", str(f)])


def _records():
    said = {"zero-base-learning": "从零讲一下%s", "fuzzy-understanding": "%s我总是分不清", "deepening-learning": "讲透%s的本质", "problem-solving": "这题怎么做：%s",
            "mistake-review": "%s做错了帮我复盘", "word-deep-dive": "查词：%s", "text-memorizer": "帮我背这段：%s", "study-plan-builder": "两周内补%s怎么安排", "non-learning": "帮我写邮件给%s"}
    topics = ["极限", "导数", "积分", "级数", "矩阵", "概率", "图论", "进程", "死锁", "缓存"]
    return [{"id": f"{label}-{t}", "text": s % t, "label": label, "topic": t, "hard_negative": t == "导数"} for label, s in said.items() for t in topics]


def test_learned_router_end_to_end(spark, tmp_path, capsys):
    data, model, report = tmp_path / "d.jsonl", tmp_path / "m.json.gz", tmp_path / "r.json"
    data.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in _records()), encoding="utf-8")
    assert cli.main(["train", "--dataset", str(data), "--artifact", str(model), "--report", str(report)]) == 0
    found = json.loads(report.read_text(encoding="utf-8"))
    assert found["metrics"]["accuracy"] >= 0.9 and found["train_total"] + found["test_total"] == 90 == found["dataset_total"]
    held = {i.split("-")[-1] for i in found["holdout_ids"]}
    assert len(found["holdout_ids"]) == 9 * len(held)  # whole topics
    capsys.readouterr()
    assert cli.main(["evaluate", "--dataset", str(data), "--artifact", str(model), "--benchmark", str(report)]) == 0
    again = json.loads(capsys.readouterr().out)
    assert again["split"]["replayed"] and again["dataset_matches_training"] and again["metrics"]["accuracy"] == found["metrics"]["accuracy"]
    assert cli.main(["predict", "帮我背这段：链表", "--artifact", str(model), "--top-k", "2"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["skill"] == "text-memorizer" and len(said["top"]) == 2
    assert cli.main(["predict", "x" * 20_001, "--artifact", str(model)]) == 2 and "20001 characters" in capsys.readouterr().err
    assert cli.main(["predict", " ", "--artifact", str(model)]) == 2
    for change, problem in (({"dataset_sha256": "0"}, "another data set"), ({"dataset_total": 89}, "total"), ({"test_total": True}, "total"), ({"holdout_ids": found["holdout_ids"][:-1]}, "ids are wrong"),
                            ({"holdout_ids": [*found["holdout_ids"][:-1], "zzz"]}, "not in the data set"), ({"holdout_ids": found["holdout_ids"][::-1]}, "another hold-out"), ({"test_size": 2}, "split is wrong")):
        report.write_text(json.dumps({**found, **change}))
        assert cli.main(["evaluate", "--dataset", str(data), "--artifact", str(model), "--benchmark", str(report)]) == 2
        assert problem in capsys.readouterr().err


def test_paths_must_differ_and_data_must_be_whole(spark, tmp_path):
    data = tmp_path / "d.jsonl"
    data.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in _records()), encoding="utf-8")
    (tmp_path / "link.gz").symlink_to(data)
    for artifact, report in (("link.gz", "r.json"), ("x", "x"), ("a", "../" + tmp_path.name + "/d.jsonl")):
        with pytest.raises(ValueError, match="must be different"):
            router.train(spark, str(data), str(tmp_path / artifact), str(tmp_path / report))
    with pytest.raises(ValueError, match="must not overwrite"):
        router.check_paths({}, {"report": str(data)}, (str(data),))
    for text, problem in (("", "no records"), ('{"text": "a", "label": "word-deep-dive"}', "is missing"), ('{"text": "a", "label": "b", "id": "1"}\n{"text": "c", "label": "b", "id": "1"}', "stands 2 times")):
        data.write_text(text)
        with pytest.raises(ValueError, match=problem):
            router.load_records(spark, str(data))
    with pytest.raises(ValueError, match="unknown group field"):
        router.split_records(spark.createDataFrame([("a", "b")], "key string, label string"), group="nothing")
