"""Answers scored by rubrics of ten dimensions, with gates, and summaries of a suite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..plans.shared import code

LINE_ENDS = r"\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def rubric_name(column: str) -> Column:
    """The rubric that a value names: aliases resolved, ``concept`` for null or blank, null for unknown ones."""
    c = F.coalesce(code(column), F.lit("concept"))
    aliases = F.create_map(*(F.lit(x) for pair in V.RUBRIC_ALIASES.items() for x in pair))
    c = F.coalesce(aliases[c], c)
    return F.when(c.isin(list(V.RUBRICS)), c)


def scorable(text: Column) -> Column:
    """The text before the stop marker."""
    return F.substring_index(text, V.STOP_MARKER, 1)


def file_rubric(text: Column) -> Column:
    """struct(rubric, baseline) from marker comments in the first ten lines: the last marker names the rubric, any one the baseline."""
    lines = F.slice(F.split(text, "\n", -1), 1, 10)
    kinds = F.array_compact(F.transform(lines, lambda x: F.nullif(F.lower(F.regexp_extract(x, r"(?i)<!--\s*rubric:\s*([a-z][a-z0-9_-]*)\s*-->", 1)), F.lit(""))))
    last = F.replace(F.coalesce(F.element_at(F.when(F.size(kinds) > 0, kinds), -1), F.lit("concept")), F.lit("_"), F.lit("-"))
    aliases = F.create_map(*(F.lit(x) for pair in V.RUBRIC_ALIASES.items() for x in pair))
    return F.struct(F.when(last == "baseline", "concept").otherwise(F.coalesce(aliases[last], last)).alias("rubric"), F.array_contains(kinds, "baseline").alias("baseline"))


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike(T.java("|".join(f"(?:{p})" for p in patterns)))


def _contains(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _ladder(one: Column, two: Column) -> Column:
    """2 if both hold, 1 if one does."""
    return one.cast("int") + two.cast("int")


def misconception_rows(text: Column) -> Column:
    """Most distinct substantive rows of any Markdown table whose header names errors, reasons and corrections.

    One pass over the lines of each text within the row: no explode and no shuffle.
    """
    def cells(line: Column) -> Column:
        s = T.stripped(line)
        inner = F.substring(s, F.lit(2), F.length(s) - 2)
        barred = F.contains(line, F.lit("|")) & F.startswith(s, F.lit("|")) & F.endswith(s, F.lit("|"))
        return F.when(barred, F.transform(F.split(inner, r"\|", -1), T.stripped))

    def whole(c: Column, pattern: str) -> Column:
        return c.rlike(T.java(r"\A(?:" + pattern + r")\z", ignore_case=True))

    def header(c: Column) -> Column:
        return (F.size(c) >= 3) & whole(F.get(c, F.lit(0)), V.ERROR_HEADER) & whole(F.get(c, F.lit(1)), V.REASON_HEADER) & whole(F.get(c, F.lit(2)), V.CORRECTION_HEADER)

    def substantive(c: Column) -> Column:
        first = F.slice(c, 1, 3)
        separator = F.forall(c, lambda x: x.rlike(r"\A:?-{3,}:?\z"))
        return (F.size(c) >= 3) & ~separator & F.forall(first, lambda x: (x != "") & ~whole(x, V.PLACEHOLDER))

    def key(c: Column) -> Column:
        return F.array_join(F.transform(F.slice(c, 1, 3), lambda x: F.lower(T.collapsed(x))), "\u0001")

    lines = F.transform(F.split(text, LINE_ENDS, -1), cells)
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("best"), F.lit(False).alias("inside"), F.lit(False).alias("counts"), none.alias("rows"))

    def step(a: Column, c: Column) -> Column:
        added = F.when(substantive(c), F.array_union(a["rows"], F.array(key(c)))).otherwise(a["rows"])
        begun = F.struct(a["best"].alias("best"), F.lit(True).alias("inside"), header(c).alias("counts"), none.alias("rows"))
        on = F.struct(F.greatest(a["best"], F.when(a["counts"], F.size(added)).otherwise(0)).alias("best"), F.lit(True).alias("inside"), a["counts"].alias("counts"), added.alias("rows"))
        off = F.struct(a["best"].alias("best"), F.lit(False).alias("inside"), F.lit(False).alias("counts"), none.alias("rows"))
        return F.when(c.isNull(), off).when(a["inside"], on).otherwise(begun)

    return F.aggregate(lines, start, step, lambda a: a["best"])


def scorers(text: Column, rows: Column, stripped: Column) -> dict[str, Column]:
    """All dimensions' scores, 0 to 2, by name of scorer; ``rows`` are ``misconception_rows``, ``stripped`` the text without outer white space."""
    questions = F.regexp_count(text, F.lit(V.QUESTION_MARK)) >= 2
    intuition = F.size(T.found_patterns(text, V.INTUITION_PATTERNS, ignore_case=False))
    formal, maths = text.rlike(T.java(V.FORMAL_PATTERN)), text.rlike(T.java(V.MATH_PATTERN))
    example = text.rlike(T.java(V.EXAMPLE_PATTERN))
    told = text.rlike(T.java(V.STEP_PATTERN)) | text.rlike(T.java(V.WORKED_PATTERN))
    lines = F.split(stripped, "\n", -1)
    paragraphs = F.size(F.filter(lines, lambda x: (T.stripped(x) != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("|"))))
    closing = F.right(stripped, F.lit(200)).rlike(V.CLOSING_PATTERN)
    summary = _contains(text, V.SUMMARY_WORDS)
    exam = _contains(text, V.EXAM_WORDS)
    out = {
        "diagnosis": _ladder(_contains(text, V.DIAGNOSTIC_WORDS), questions),
        "intuition": F.when(intuition >= 3, 2).when(intuition >= 1, 1).otherwise(0),
        "formal_definition": F.greatest(_ladder(formal, maths), (F.length(text) > 300).cast("int")),
        "example": F.when(example & told, 2).when(example, 1).otherwise(0),
        "variation": _ladder(_any(text, V.VARIATION_PATTERNS), text.rlike(V.TEST_PATTERN)),
        "misconception": F.when(~text.rlike(V.MISCONCEPTION_PATTERN), 0).when(rows >= 2, 2).otherwise(1),
        "conciseness": F.when(F.size(lines) < 5, 0).when((F.size(lines) > 120) | (paragraphs < 3), 1).otherwise(2),
        "audience": F.when(_contains(text, V.ADVANCED_TERMS) | text.rlike(T.java(V.ADVANCED_PATTERN)), 0).otherwise(2),
        "method_summary": F.when(summary & closing, 2).when(summary, 1).otherwise(0),
        "no_encouragement": F.when(_any(text, V.ENCOURAGEMENT_PATTERNS + V.SKIPPED_REASONING_PATTERNS), 0).otherwise(2),
        "exam_relevance": F.when(exam & text.rlike(V.EXAM_ACTION_PATTERN), 2).when(exam, 1).otherwise(0),
        "etymology": _ladder(text.rlike(V.ETYMOLOGY_PATTERN), text.rlike(V.LOOKALIKE_PATTERN)),
    }
    for name, (full, patterns) in V.SIGNALS.items():
        hits = F.size(T.found_patterns(text, patterns, multiline=True))
        out[name] = F.when(hits >= full, 2).when(hits >= 1, 1).otherwise(0)
    return out


def score(
    df: DataFrame, text: str = "text", rubric: str | None = "rubric", baseline: str | None = None, inline: bool = False,
    allow_inline_baseline: bool = False, allow_stop: bool = False, strict: bool = False,
) -> DataFrame:
    """``df`` with ``used_rubric``, ``scores`` (array of dimension and score), ``total``, ``max_score``, ``p0_passed``, ``style_passed`` and ``passed``.

    Rows with null or blank text or an unknown rubric have null scores and have not passed; with ``strict`` they raise. Only the
    dimensions of a row's own rubric are computed. With ``inline`` a row without a value in ``rubric`` is scored by the rubric that
    a marker comment in its text's first lines names. Such a marker makes a row a baseline only with ``allow_inline_baseline``, and a
    stop marker ends what is scored only with ``allow_stop``, so that no text exempts itself.
    """
    said = T.stripped(F.col(text)) != ""
    usable = F.when(said, scorable(F.col(text)) if allow_stop else F.col(text))
    if strict:
        usable = F.when(F.coalesce(said, F.lit(False)), usable).otherwise(F.raise_error(F.lit("the text must not be blank")))
    by = scorers(F.col("__text"), F.col("__rows"), F.col("__s"))
    arrays = F.lit(None).cast("array<struct<dimension:string,score:int>>")
    cases = None
    for name, dims in V.RUBRICS.items():
        these = F.array(*(F.struct(F.lit(d).alias("dimension"), by[s].cast("int").alias("score")) for d, s in dims))
        cases = F.when(F.col("used_rubric") == name, these) if cases is None else cases.when(F.col("used_rubric") == name, these)
    given = F.col(rubric).cast("string") if rubric is not None else F.lit(None).cast("string")
    marks = file_rubric(F.col(text))
    asked = df.withColumn("__asked", F.coalesce(given, marks["rubric"]) if inline else given)
    used = rubric_name("__asked")
    if strict:
        used = F.coalesce(used, F.raise_error(F.concat(F.lit("unknown rubric: "), F.col("__asked"))))
    out = asked.withColumns({"used_rubric": used, "__text": usable}).drop("__asked")
    out = out.withColumns({"__rows": misconception_rows(F.col("__text")), "__s": T.stripped(F.col("__text"))})
    out = out.withColumn("scores", F.when(F.col("__text").isNotNull(), F.coalesce(cases, arrays))).drop("__text", "__rows", "__s")

    def of(*names: str) -> Column:
        hit = F.filter("scores", lambda x: x["dimension"].isin(list(names)))
        return F.coalesce(F.get(hit, F.lit(0))["score"], F.lit(0))

    total = F.aggregate("scores", F.lit(0), lambda a, x: a + x["score"])
    out = out.withColumns({"total": total, "max_score": 2 * F.size("scores"), "p0_passed": of("常见误区", "关键误区") == 2, "style_passed": of("避免空泛") == 2})
    passed = (F.col("total") >= V.PASS_SCORE) & F.col("p0_passed") & F.col("style_passed")
    judged = {"passed": F.coalesce(passed, F.lit(False))}
    own = F.lit(False)
    if inline and allow_inline_baseline:
        own = F.coalesce(marks["baseline"], F.lit(False))
    if baseline is not None or inline:
        judged["is_baseline"] = F.coalesce(F.col(baseline), own) if baseline is not None else own
    return out.withColumns(judged)


def markdown_report(results: DataFrame, label: str, most: int = 10_000) -> str:
    """A Markdown report of scored cases (with ``is_baseline``): the summary and a row a case, in order of label.

    A report is read by people; more than ``most`` cases raise, rather than being left out.
    """
    s = summarize(results).first()
    rows = results.select(F.col(label).cast("string").alias("label"), "used_rubric", "total", "max_score", "passed", "is_baseline").orderBy("label").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} cases are too many for a report")
    head = [
        "# Eval report", "", f"- Cases: {s['total']}", f"- Judged: {s['judged']}", f"- Baselines: {s['baseline']}", f"- Passed: {s['passed']}/{s['judged']}",
        f"- Mean score: {s['average_score']:.1f}/{s['max_score']}", "", "| Case | Rubric | Score | Status |", "|---|---|---:|---|",
    ]
    state = {(True, True): "BASELINE", (True, False): "BASELINE", (False, True): "PASS", (False, False): "FAIL"}
    return "\n".join([*head, *(f"| {r['label']} | {r['used_rubric']} | {r['total']}/{r['max_score']} | {state[bool(r['is_baseline']), bool(r['passed'])]} |" for r in rows)])


def text_lines(results: DataFrame, label: str, dimensions: bool = True) -> DataFrame:
    """``label, line``: each case in lines for a terminal: name and rubric, a bar of half the maximum with the score, the dimensions."""
    status = F.when(F.col("is_baseline"), "BASELINE").when(F.col("passed"), "PASS").otherwise("FAIL")
    width = F.floor(F.col("max_score") / 2).cast("int")
    filled = F.floor(width * F.col("total") / F.col("max_score")).cast("int")
    head = F.concat(F.col(label).cast("string"), F.lit(" ["), F.col("used_rubric"), F.lit("]"))
    bar = F.concat(F.lit("  "), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), width - filled), F.lit(" "), status, F.lit("  "), F.concat_ws("/", F.col("total").cast("string"), F.col("max_score").cast("string")))
    each = F.transform("scores", lambda x: F.concat(F.lit("  "), x["dimension"], F.lit(" "), x["score"].cast("string"), F.lit("/2")))
    lines = F.concat(F.array(head, bar), each) if dimensions else F.array(head, bar)
    return results.where("scores is not null").select(F.col(label).cast("string").alias("label"), F.posexplode(lines).alias("n", "line")).orderBy("label", "n").select("label", "line")


def summarize(results: DataFrame) -> DataFrame:
    """One row over scored cases with ``is_baseline``: counts, share passed and mean total of the judged ones (0.0 without any)."""
    judged = ~F.col("is_baseline")
    return results.agg(
        F.count("*").alias("total"), F.count_if(judged).alias("judged"), F.count_if("is_baseline").alias("baseline"),
        F.count_if(judged & F.col("passed")).alias("passed"),
        F.coalesce(F.try_divide(F.count_if(judged & F.col("passed")), F.count_if(judged)), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg(F.when(judged, F.col("total"))), F.lit(0.0)).alias("average_score"),
        F.when(F.count_if(judged) > 0, V.MAX_SCORE).otherwise(0).alias("max_score"),
    )


def breakdown(results: DataFrame) -> DataFrame:
    """By rubric, baselines included: cases, passed ones and mean total."""
    return results.groupBy(F.col("used_rubric").alias("rubric")).agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.avg(F.coalesce("total", F.lit(0))).alias("average_score")
    )
