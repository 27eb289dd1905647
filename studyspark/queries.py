"""The queries over the tables, one or more per operator, and each one's SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vocabulary as V
from .operators import budget, dataset, diagnosis, documents, generator, linear, metrics, router, routing, rubric, scheduler, splits, tfidf
from .plans.shared import Kept, code, first_by_key, ship, table
from .sql import oracle

TODAY = oracle.TODAY


def _six(c):
    return F.rint(c * 1e6) / 1e6


def _routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by_key(table(spark, sf_dir, "routing_cases").select("case_id", "text", "skill", "category", "split", "source"), "case_id")


def _routed(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    """Requests with their route, each key once: texts are routed where they lie, and only ``columns`` of the result are shuffled."""
    rows = table(spark, sf_dir, "routing_cases").select("case_id", "text", "skill", "source")
    routed = routing.route(rows).withColumn("expected", code("skill"))
    return first_by_key(routed.select("case_id", *(columns or ("predicted", "expected", "source"))), "case_id")


def route_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's skill, confidence and the rules that matched."""
    return _routed(spark, sf_dir, "predicted", "confidence", F.array_join("matched_rules", "|").alias("matched_rules"))


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by skill."""
    return _routed(spark, sf_dir, "predicted").groupBy("predicted").agg(F.count("*").alias("n"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).where(F.col("expected").isin(V.SKILLS))


def route_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(_judged(spark, sf_dir)).withColumn("accuracy", _six(F.col("accuracy")))


def route_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_judged(spark, sf_dir))


def route_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.class_report(metrics.confusion(_judged(spark, sf_dir)))
    return r.withColumns({c: _six(F.col(c)) for c in ("precision", "recall", "f1")})


def route_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.averages(metrics.class_report(metrics.confusion(_judged(spark, sf_dir))))
    return r.withColumns({c: _six(F.col(c)) for c in r.columns})


def route_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro F1 of one source's requests."""
    r = metrics.slice_metrics(_judged(spark, sf_dir), F.col("source") == "web_form")
    return r.withColumns({c: _six(F.col(c)) for c in ("accuracy", "macro_f1")})


def route_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.matrix(metrics.confusion(_judged(spark, sf_dir)), V.SKILLS)
    return m.select("place", "expected", F.array_join("row", ",").alias("row"))


def _diagnosed(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    rows = diagnosis.diagnose(table(spark, sf_dir, "diagnosis_cases").select("case_id", "text", "label"))
    rows = rows.withColumn("expected", F.replace(code("label"), F.lit("-"), F.lit("_")))
    return first_by_key(rows.select("case_id", *columns), "case_id")


def diagnose_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement's label, confidence, evidence and secondary labels."""
    return _diagnosed(
        spark, sf_dir, "predicted", "name", "confidence", F.array_join("evidence", " ; ").alias("evidence"), F.array_join("secondary", ",").alias("secondary")
    )


def diagnose_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _diagnosed(spark, sf_dir, "predicted", "expected").where(F.col("expected").isin(list(V.DIAGNOSES)))
    return metrics.accuracy(judged).withColumn("accuracy", _six(F.col("accuracy")))


def _smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored answers; blank ones and those of unknown rubrics have no score and are left out before they are scored."""
    rows = table(spark, sf_dir, "smoke").select("case_no", "rubric", "text", "baseline")
    scored = rubric.score(rows.where((T.stripped(F.col("text")) != "") & rubric.rubric_name("rubric").isNotNull()), baseline="baseline")
    return first_by_key(scored.drop("text", "rubric", "baseline"), "case_no")


def rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer's score in each dimension of its rubric."""
    return _smoke(spark, sf_dir).select("case_no", F.explode("scores").alias("s")).select("case_no", "s.dimension", "s.score")


def rubric_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smoke(spark, sf_dir).select("case_no", "used_rubric", "total", "p0_passed", "style_passed", "passed")


def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rubric.summarize(_smoke(spark, sf_dir))
    return r.withColumns({c: _six(F.col(c)) for c in ("accuracy", "average_score")})


def rubric_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rubric.breakdown(_smoke(spark, sf_dir))
    return r.withColumn("average_score", _six(F.col("average_score")))


def md_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct substantive rows of each answer's best misconception table."""
    rows = table(spark, sf_dir, "smoke").select("case_no", "text").where("text is not null")
    return first_by_key(rows.select("case_no", rubric.misconception_rows(F.col("text")).alias("n")), "case_no")


def inline_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose rubric stands in a marker within the text and which a stop marker ends; what follows it doesn't count."""
    rows = table(spark, sf_dir, "smoke").where((T.stripped(F.col("text")) != "") & F.coalesce(F.trim("rubric"), F.lit("")).rlike("^[A-Za-z][A-Za-z0-9_-]*$"))
    marker = F.concat(F.lit("<!-- rubric: "), F.trim("rubric"), F.lit(" -->\n"), F.when(F.col("baseline"), "<!-- rubric: baseline -->\n").otherwise(""))
    told = rows.select("case_no", F.concat(marker, F.col("text"), F.lit(oracle.AFTER_STOP)).alias("text"))
    scored = rubric.score(told, rubric=None, inline=True, allow_inline_baseline=True, allow_stop=True).where("used_rubric is not null")
    return first_by_key(scored.select("case_no", "used_rubric", "is_baseline", "total", "max_score", "passed"), "case_no")


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", budget.estimated_tokens(F.col("text")).alias("tokens"))


def budget_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source that fit 20,000 estimated tokens, in order, passing over what doesn't fit."""
    items = table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("ord"), budget.estimated_tokens(F.col("text")).alias("tokens"))
    return budget.fitting(items, 20_000, Kept(spark))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_by_key(table(spark, sf_dir, "subject_cases").select("id", "subject", "scenario", "skill", "diagnosis"), "id")
    return rows.withColumns({c: code(c) for c in ("subject", "skill", "diagnosis")})


def subject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by subject, by skill, by diagnosis and in all."""
    return dataset.profile(_subjects(spark, sf_dir), "subject", "skill", "diagnosis")


def subject_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dataset.filtered(_subjects(spark, sf_dir), subject="calculus", skill=None, diagnosis="")
    return rows.select("id", "scenario")


def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by skill, category and source, variants as written."""
    return dataset.profile(_routing(spark, sf_dir), "skill", "category", "source")


def generator_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated requests by label, category, source and diagnosis: from topics, and from the words, passages and requests of other tables."""
    topics = first_by_key(table(spark, sf_dir, "topics").select(F.col("topic_id").alias("place"), *generator.FIELDS[1:], "difficulty"), "place")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("word"), F.col("p_type").alias("other"))
    passages = table(spark, sf_dir, "heldout_items").select(F.col("item_id").alias("place"), "text")
    others = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("place"), F.col("n_name").alias("text"))
    return dataset.profile(generator.records(topics, parts, passages, others), "label", "category", "source", "diagnosis")


def request_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that the learned router would refuse, and why; others stay out."""
    rows = table(spark, sf_dir, "routing_cases").select("case_id", "text")
    return first_by_key(router.quarantined(rows)[1].select("case_id", "problem"), "case_id")


def router_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out statements classified by an exported model: idf of the training rows' n-grams, coefficients the labels' mean vectors.

    The model is written, read again and validated before it scores; held-out texts have n-grams that it doesn't know.
    """
    keep = Kept(spark)
    label = F.replace(code("label"), F.lit("-"), F.lit("_"))
    rows = first_by_key(table(spark, sf_dir, "diagnosis_cases").select("case_id", "text", label.alias("label"), F.lower(F.trim("split")).alias("split")), "case_id")
    rows = keep(rows.where((T.stripped(F.col("text")) != "") & F.col("label").isin(list(V.DIAGNOSES))), "rows")
    ours = rows.where("split = 'train'")
    n = ours.count()
    common = F.col("df") >= F.greatest(F.lit(5), F.ceil(F.lit(n) / 200))
    idf = keep(tfidf.vocabulary(tfidf.inverse_frequencies(tfidf.term_counts(ours, "case_id"), n).where(common)), "idf")
    weights = tfidf.document_weights(ours, "case_id", idf)
    means = weights.join(ours.select("case_id", "label"), "case_id").groupBy("gram", "label").agg(F.sum("w").alias("s"))
    sizes = {r["label"]: r["count"] for r in ours.groupBy("label").count().collect()}
    labels = sorted(sizes)
    table_ = means.join(idf, "gram").groupBy("gram", "idx", "idf").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("label") == x, F.col("s"))), F.lit(0.0)) for x in labels)).alias("sums"))
    grams = table_.orderBy("idx").collect()
    columns = [[r["sums"][k] / sizes[x] for r in grams] for k, x in enumerate(labels)]
    model = linear.payload({r["gram"]: i for i, r in enumerate(grams)}, [r["idf"] for r in grams], labels, columns, [0.0] * len(labels), {})
    if linear.problems(model, labels):  # too few rows for a model
        return spark.createDataFrame([], "case_id bigint, skill string, confidence double")
    with tempfile.TemporaryDirectory() as folder:
        linear.save(model, f"{folder}/model.json.gz", labels)
        model = linear.load(f"{folder}/model.json.gz", labels)
    found = router.predictions(rows.where("split in ('validation', 'test')").select("case_id", "text"), model, "case_id")
    return found.select("case_id", "skill", _six(F.col("confidence")).alias("confidence"))


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first request of each text."""
    return dataset.first_of_each(_routing(spark, sf_dir), [F.col("case_id")]).select("case_id")


def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer's own id or a derived one."""
    rows = first_by_key(table(spark, sf_dir, "smoke").select("case_no", "id", "text", "rubric"), "case_no")
    return rows.select("case_no", dataset.record_keys(rows, "id", "case_no", "text", "rubric").alias("record_key"))


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_by_key(table(spark, sf_dir, "smoke").select("case_no", "id"), "case_no").where("id is not null")
    return dataset.repeated_keys(rows, "id")


def label_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills that requests lack or shouldn't have."""
    rows = _routing(spark, sf_dir).select(code("skill").alias("skill")).where("skill is not null")
    return dataset.label_set_differences(rows, "skill", V.LEARNED_LABELS)


def template_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three templates filled in for every topic."""
    templates = spark.createDataFrame(oracle.TEMPLATES, "template string, label string")
    topics = first_by_key(table(spark, sf_dir, "topics").select("topic_id", "topic", "simple", "mistake"), "topic_id")
    return dataset.expand(topics, templates, ["topic", "simple", "mistake"]).select("topic_id", "label", "text")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _routing(spark, sf_dir).select("case_id", code("skill").alias("label"))
    return splits.stratified(rows, "case_id", "label").select("case_id", "split")


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_by_key(table(spark, sf_dir, "topics").select("topic_id", "difficulty", "topic"), "topic_id")
    return rows.select("topic_id", code("difficulty").alias("label"), T.normalized(F.col("topic")).alias("topic"))


def group_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each of 128 candidate hold-outs of whole topics is off."""
    return splits.group_candidates(_topics(spark, sf_dir), "topic", "label")


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.grouped(_topics(spark, sf_dir), "topic_id", "topic", "label").select("topic_id", "split")


def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitters on both sides of a per-label split."""
    rows = first_by_key(table(spark, sf_dir, "routing_cases").select("case_id", "submitted_by", "split"), "case_id")
    return splits.leakage(rows.withColumn("split", F.when(F.col("split") == "test", "test").otherwise("train")), "submitted_by")


def holdout_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed documents that are there, and reviewed ids that aren't."""
    there, missing = splits.replay(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "review_labels").select(F.col("doc_id").alias("key")))
    return there.select("doc_id", F.lit("there").alias("state")).unionByName(missing.select("doc_id", F.lit("missing").alias("state")))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by_key(table(spark, sf_dir, "diagnosis_cases").select("case_id", "text"), "case_id").where("text is not null")


def _counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _statements(spark, sf_dir)
    return rows, tfidf.term_counts(rows, "case_id")


def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-grams of each statement: all, different ones, and the most of one."""
    return _counts(spark, sf_dir)[1].groupBy("case_id").agg(F.sum("n").alias("grams"), F.count("*").alias("different"), F.max("n").alias("most"))


def idf_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-grams by how many statements have them, with their idf."""
    rows, counts = _counts(spark, sf_dir)
    return tfidf.inverse_frequencies(counts, rows.count()).groupBy("df").agg(F.count("*").alias("grams"), _six(F.max("idf")).alias("idf"))


def tfidf_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement's greatest weight and sum of weights."""
    keep = Kept(spark)
    ship(spark)
    found = tfidf.norms(keep(_statements(spark, sf_dir), "statements"), "case_id", keep)
    return found.select("case_id", _six(F.col("most")).alias("most"), _six(F.col("total")).alias("total"))


def linear_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings routed by a linear classifier whose coefficients are the labels' mean vectors: the two likeliest labels."""
    long = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "w"))
    long = long.select("vec_id", "label", F.col("i").cast("string").alias("gram"), F.col("w").cast("double").alias("w"))
    means = long.groupBy("label", "gram").agg(F.avg("w").alias("m"))
    labels = [r["label"] for r in means.select("label").distinct().orderBy("label").collect()]
    coefficients = means.groupBy("gram").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("label") == x, F.col("m"))), F.lit(0.0)) for x in labels)).alias("coef"))
    bias = spark.createDataFrame([(i, str(x), 0.0) for i, x in enumerate(labels)], "place int, class string, b double")
    scores = linear.decision_scores(long.select("vec_id", "gram", "w"), coefficients, bias, long, "vec_id")
    top = linear.top_classes(linear.probabilities(scores, "vec_id"), "vec_id", 2)
    return top.select("vec_id", "rank", "class", _six(F.col("p")).alias("p"), (F.col("p") < linear.LEAST_CONFIDENCE).alias("needs_fallback"))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat_ws("|", "user_id", "event_type").alias("item"), F.col("ts").alias("at"), F.col("event_id").alias("tie"),
        F.pmod(F.floor("value"), F.lit(6)).cast("int").alias("quality"),
    )


def sm2_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each item after all its reviews."""
    return scheduler.fold_reviews(_reviews(spark, sf_dir)).withColumn("last_day", F.col("last_day").cast("string"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scheduler.fold_reviews(_reviews(spark, sf_dir))
    state = s.select(F.col("item").alias("id"), F.col("reviews").alias("review_count"), "correct_streak", "interval_days", "ease_factor", "mastered", F.date_add("last_day", F.col("interval_days")).alias("next_review"))
    return scheduler.with_scores(scheduler.with_defaults(state), TODAY)


def sched_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("id", "days_overdue", "forgetting_risk", "mastery_probability", "review_priority")


def due_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 items to review first."""
    return scheduler.due_queue(_items(spark, sf_dir), TODAY, 20).select("id", "review_priority")


def weakest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 weakest items."""
    return scheduler.weakest(_items(spark, sf_dir), 10).select("id", "review_priority")


def mastery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumn("kind", F.element_at(F.split("id", r"\|"), -1))
    return scheduler.mastery_stats(items, TODAY, "kind")


def review_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's state after one more review of quality 4."""
    r = scheduler.review(_items(spark, sf_dir), F.lit(4), TODAY)
    return r.select("id", "review_count", "correct_streak", "interval_days", "ease_factor", "mastered", F.col("next_review").cast("string").alias("next_review"))


def basic_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubling intervals since the last wrong answer."""
    return scheduler.basic_interval(_reviews(spark, sf_dir))


def doc_contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with front matter made of their kind and subject, a good table, a broken one or none, and what breaks the contract."""
    d = table(spark, sf_dir, "documents")
    rows_ = F.when(F.col("doc_id") % 3 == 0, oracle.GOOD_TABLE).when(F.col("doc_id") % 3 == 1, oracle.BAD_TABLE).otherwise("")
    front = F.concat(F.lit("---\nname: "), F.coalesce("kind", F.lit("")), F.lit("\ndescription: "), F.coalesce("subject", F.lit("")), F.lit("\n---\n"), F.coalesce("text", F.lit("")), rows_)
    out = documents.errors(d.select("doc_id", front.alias("text"), F.replace(F.coalesce("kind", F.lit("")), F.lit("_"), F.lit("-")).alias("name")))
    return out.select("doc_id", F.array_join("errors", "; ").alias("errors"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        route_cascade, route_counts, route_accuracy, route_confusion, route_class_report, route_averages, route_slice, route_matrix,
        diagnose_rank, diagnose_accuracy, rubric_scores, rubric_gate, suite_summary, rubric_breakdown, md_table_rows, token_estimate,
        budget_greedy, inline_rubric, generator_profile, request_check, router_scores, subject_summary, subject_filter, dataset_profile, dedup_first_wins, record_keys, repeated_ids, label_set,
        template_expand, stratified_split, group_candidates, group_split, leakage_report, holdout_replay, ngram_counts, idf_profile,
        tfidf_norms, linear_softmax, sm2_fold, sched_scores, due_queue, weakest_items, mastery_stats, review_step, basic_interval,
        doc_contract_errors,
    )
}
ORACLE: dict[str, str] = oracle.SQL
