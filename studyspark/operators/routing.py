"""Requests to skills by an ordered cascade of phrase and pattern rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V


@dataclass(frozen=True)
class Rule:
    """One step: phrases and patterns whose hits lead to ``skill``, unless a veto phrase is there."""

    tag: str
    skill: str
    confidence: float
    phrases: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    vetoes: list[str] = field(default_factory=list)
    pattern_tag: str = ""


RULES = [
    Rule("text-memory", "text-memorizer", 0.95, V.TEXT_PHRASES),
    Rule("plan", "study-plan-builder", 0.9, V.PLAN_PHRASES, vetoes=V.PLAN_VETOES),
    Rule("mistake", "mistake-review", 0.95, V.MISTAKE_PHRASES),
    Rule("deep", "deepening-learning", 0.85, V.DEEP_PHRASES, V.DEEP_PATTERNS, pattern_tag="deep-regex"),
    Rule("problem", "problem-solving", 0.9, V.PROBLEM_PHRASES),
    Rule("fuzzy", "fuzzy-understanding", 0.9, V.FUZZY_PHRASES),
    Rule("zero", "zero-base-learning", 0.85, V.ZERO_PHRASES),
    Rule("zero", "zero-base-learning", 0.65, [], V.ZERO_PATTERNS, pattern_tag="zero-regex"),
]
SINGLE_WORD = r"\A!?[A-Za-z][A-Za-z'-]*(?:\s+(?:" + "|".join(V.EXAM_SUFFIXES) + r"))?\z"


def _result(skill: Column | str, confidence: float, rules: Column) -> Column:
    s = F.lit(skill) if isinstance(skill, str) else skill
    return F.struct(s.alias("skill"), F.lit(confidence).alias("confidence"), rules.alias("matched_rules"))


def _when_hit(rule: Rule) -> Callable[[Column], Column]:
    return lambda h: F.when(F.size(h) > 0, _result(rule.skill, rule.confidence, h))


def routed(t: Column, stripped: Column, rules: list[Rule] = RULES) -> Column:
    """struct(skill, confidence, matched_rules): the first rule that hits.

    ``t`` is the normalized text and ``stripped`` the text without outer white space; both should be columns, since every rule
    looks at them. Empty text, explicit skill names and single English words come before the list of rules; without any hit the
    default skill gets a low confidence. Each rule's hits are found once, and only if no rule before it has hit.
    """
    first = F.coalesce(*(F.when(F.contains(t, F.lit(s)), F.lit(s)) for s in V.SKILLS))
    single = F.when(stripped.rlike(T.java(SINGLE_WORD)), F.lit("word:single-english-word"))
    comparison = F.when(t.rlike(T.java(V.COMPARISON_PATTERN, ignore_case=True)), F.lit("word:english-word-comparison"))
    words = F.concat(T.tagged("word", T.found_literals(t, V.WORD_PHRASES)), F.array_compact(F.array(single, comparison)))

    def bound(value: Column, result: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), result), F.lit(0))

    steps = [
        F.when(t == "", _result(V.DEFAULT_SKILL, 0.2, F.array(F.lit("empty:fallback")))),
        bound(first, lambda s: F.when(s.isNotNull(), _result(s, 1.0, F.array(F.concat(F.lit("explicit:"), s))))),
        bound(words, lambda h: F.when(F.size(h) > 0, _result("word-deep-dive", 0.95, h))),
    ]
    for rule in rules:
        hits = T.tagged(rule.tag, T.found_literals(t, rule.phrases))
        if rule.patterns:
            hits = F.concat(hits, T.tagged(rule.pattern_tag, T.found_patterns(t, rule.patterns)))
        if rule.vetoes:
            vetoed = reduce(lambda a, b: a | b, [F.contains(t, F.lit(v)) for v in rule.vetoes])
            hits = F.when(~vetoed, hits).otherwise(F.array().cast("array<string>"))
        steps.append(bound(hits, _when_hit(rule)))
    return F.coalesce(*steps, _result(V.DEFAULT_SKILL, 0.4, F.array(F.lit("fallback:" + V.DEFAULT_SKILL))))


def route(df: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``df`` with ``predicted``, ``confidence`` and ``matched_rules``; a null text counts as empty. Projections only, no shuffle."""
    raw = F.coalesce(F.col(text), F.lit(""))
    r = df.withColumns({"__t": T.normalized(raw), "__s": T.stripped(raw)})
    r = r.withColumn("__routed", routed(F.col("__t"), F.col("__s"), rules))
    out = {"predicted": F.col("__routed.skill"), "confidence": F.col("__routed.confidence"), "matched_rules": F.col("__routed.matched_rules")}
    return r.withColumns(out).drop("__routed", "__t", "__s")
