"""Labelled requests made from topics, words, passages and requests of other kinds, as a training set of the learned router."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..plans.shared import Kept
from .dataset import first_of_each, numbered

# Templates of each label with their category, in order.
TEMPLATES = {
    "zero-base-learning": [
        ("{simple}是什么？我第一次接触，想先知道它解决什么问题。", "zero"), ("从零讲一下{simple}，不要一上来就给公式。", "zero"),
        ("我完全没学过{topic}，能不能用直觉解释一下？", "zero"), ("刚开始学{topic}，{simple}到底在研究什么？", "zero"),
    ],
    "fuzzy-understanding": [
        ("我学过{topic}，但{pair}总是分不清。", "concept_confusion"), ("{simple}我会算一点，但不知道它到底在干什么。", "formula_without_understanding"),
        ("老师讲到{simple}时我能跟着做，自己一换题就不会用了。", "rote_no_transfer"),
        ("我看得懂{topic}的例题，但不理解为什么可以这样做。", "formula_without_understanding"), ("{simple}相关符号一多我就懵，尤其是{pair}。", "symbol_not_understood"),
    ],
    "deepening-learning": [
        ("讲透{simple}的本质，别只给定义。", "concept_confusion"), ("为什么{simple}在{subject_cn}里这么重要？想从多个角度理解。", "concept_confusion"),
        ("{simple}背后的证明思路是什么？有没有反例能说明条件不能少？", "derivation_gap"), ("{topic}和{pair}之间有什么更深的联系？", "concept_confusion"),
        ("{simple}为什么不能随便套模板？想理解它的适用条件。", "rote_no_transfer"), ("为什么{simple}在某些条件下会失效？", "derivation_gap"),
        ("{simple}为什么可以成立？核心证明直觉是什么？", "derivation_gap"),
    ],
    "problem-solving": [
        ("这题怎么做：{problem}。我不知道第一步该想什么。", "derivation_gap"), ("我卡在一道{topic}题上，题目是：{problem}。求思路。", "derivation_gap"),
        ("帮我分析这道题的解题模型：{problem}。不要直接给答案。", "derivation_gap"), ("遇到{topic}题时怎么判断该用哪个方法？比如：{problem}。", "concept_confusion"),
    ],
    "mistake-review": [
        ("这题我做错了：{problem}，我可能是{mistake}，帮我复盘。", "concept_confusion"), ("我的答案和标准答案不一样，题目是{problem}，我想知道错因。", "concept_confusion"),
        ("错题复盘：{topic}这里我总是{mistake}，怎么避免？", "rote_no_transfer"), ("我以为{simple}题这样做就行，但答案说不对，可能哪里错了？", "concept_confusion"),
    ],
    "study-plan-builder": [
        ("我想两周内补{topic}，每天 1 小时，怎么安排？", "plan"), ("期末要考{topic}，我基础是{prerequisite}不太稳，给我排个复习计划。", "plan"),
        ("如果目标是能做{topic}的中等题，应该怎么学{simple}？", "plan"),
    ],
}
# Hard negatives of a topic (text, label, category, diagnosis), and requests around a word or a passage.
HARD_NEGATIVES = [
    ("{simple}是什么？我不是要做题，只想先入门。", "zero-base-learning", "zero", "missing_prerequisite"),
    ("我会做{simple}的基本题，但{pair}还是分不清。", "fuzzy-understanding", "concept_confusion", "concept_confusion"),
    ("{problem}，这是我错题里的题，我的错误是{mistake}。", "mistake-review", "mistake", "concept_confusion"),
    ("为什么{simple}不能只靠背模板？我想理解适用条件。", "deepening-learning", "deep", "rote_no_transfer"),
]
WORD_REQUESTS = ["{word}", "!{word} 六级", "查词：{word}", "{word} 和 {other} 有什么区别？", "{word} 这个词在考研阅读里怎么考？"]
PASSAGE_REQUESTS = [
    "帮我背这段：{text}。", "针对这段出题抽背：{text}。", "关键词触发：{short}，帮我复习薄弱点。", "把这段整理成填空题和问答题：{text}。",
    "我需要默写这段：{text}。请帮我做梯度挖空。", "围绕这段材料出 5 道抽背题：{text}。", "这段我总背混：{text}。帮我列常见记忆误区。",
]
# Diagnosis of a label whose category is none, and subjects' names.
LABEL_DIAGNOSES = {
    "zero-base-learning": "missing_prerequisite", "fuzzy-understanding": "formula_without_understanding", "deepening-learning": "concept_confusion",
    "problem-solving": "derivation_gap", "mistake-review": "concept_confusion", "study-plan-builder": "missing_prerequisite",
}
SUBJECT_NAMES = {
    "calculus": "高等数学", "linear_algebra": "线性代数", "probability_statistics": "概率统计", "algorithms": "算法", "csapp": "计算机系统",
    "operating_systems": "操作系统", "computer_networks": "计算机网络", "machine_learning": "机器学习", "signals_systems": "信号与系统",
    "automatic_control": "自动控制", "circuits": "电路", "physics": "大学物理", "mathematical_modeling": "数学建模", "research_competition": "科研竞赛",
}
#: Characters of a passage that name it, and the form of ids.
SHORT, ID = 18, "router-train-%04d"
FIELDS = ("subject_cn", "subject", "topic", "simple", "pair", "problem", "mistake", "prerequisite")


def diagnosis_of(category: str, label: str) -> str | None:
    """A template's category if that is a diagnosis, else its label's diagnosis."""
    return category if category in V.DIAGNOSES else LABEL_DIAGNOSES.get(label)


def filled(template: Column, fields: dict[str, Column]) -> Column:
    """The template with each ``{field}`` replaced by its value; a null value leaves an empty place."""
    return reduce(lambda t, f: F.replace(t, F.lit("{" + f[0] + "}"), F.coalesce(f[1], F.lit(""))), fields.items(), template)


def _cases(rows: list[tuple[str, str, str, str | None, str, bool]]) -> Column:
    names = ("template", "label", "category", "diagnosis", "source", "hard_negative")
    return F.array(*(F.struct(F.lit(i).alias("n"), *(F.lit(v).cast("boolean" if k == "hard_negative" else "string").alias(k) for k, v in zip(names, r))) for i, r in enumerate(rows)))


def _expanded(df: DataFrame, part: int, order: Column, cases: Column, fields: dict[str, Column], subject: Column, topic: Column, difficulty: Column) -> DataFrame:
    rows = df.select(F.lit(part).alias("part"), order.alias("place"), *(c.alias(f"f_{k}") for k, c in fields.items()), subject.alias("subject"), topic.alias("topic"), difficulty.alias("difficulty"), F.explode(cases).alias("c"))
    text = T.stripped(filled(F.col("c.template"), {k: F.col(f"f_{k}") for k in fields}))
    return rows.select("part", "place", F.col("c.n").alias("n"), text.alias("text"), "c.label", "c.category", "subject", "topic", "c.diagnosis", "difficulty", "c.source", "c.hard_negative")


def requests(topics: DataFrame, words: DataFrame, passages: DataFrame, others: DataFrame) -> DataFrame:
    """All requests in order (``part, place, n``), repeats and blank texts included.

    ``topics``: place, subject, topic, simple, pair, problem, mistake, prerequisite, difficulty; ``words``: place, word, other;
    ``passages``: place, text; ``others``: place, text (requests that are no learning requests). Templates lie in the plan, so each
    row is expanded where it lies, without a join or a shuffle.
    """
    by_topic = [(t, label, c, diagnosis_of(c, label), "synthetic_from_public_course_topic", False) for label, ts in TEMPLATES.items() for t, c in ts]
    by_topic += [(t, label, c, d, "synthetic_hard_negative", True) for t, label, c, d in HARD_NEGATIVES]
    names = F.create_map(*(F.lit(x) for pair in SUBJECT_NAMES.items() for x in pair))
    fields = {"subject_cn": F.coalesce(names[F.col("subject")], F.col("subject")), **{f: F.col(f) for f in FIELDS[1:]}}
    level = F.coalesce(F.col("difficulty"), F.lit("undergraduate"))
    usual = F.lit("undergraduate")
    parts = [
        _expanded(topics, 0, F.col("place"), _cases(by_topic), fields, F.col("subject"), F.col("topic"), level),
        _expanded(words, 1, F.col("place"), _cases([(t, "word-deep-dive", "word", None, "synthetic_word_cases", False) for t in WORD_REQUESTS]),
                  {"word": F.col("word"), "other": F.col("other")}, F.lit("english"), F.col("word"), usual),
        _expanded(passages, 2, F.col("place"), _cases([(t, "text-memorizer", "text", None, "synthetic_text_memory", False) for t in PASSAGE_REQUESTS]),
                  {"text": F.col("text"), "short": F.left("text", F.lit(SHORT))}, F.lit("memorization"), F.left("text", F.lit(SHORT)), usual),
        _expanded(others, 3, F.col("place"), _cases([("{text}", "non-learning", "out_of_scope", None, "visible_conversation_or_platform_pattern", True)]),
                  {"text": F.col("text")}, F.lit("platform"), F.lit("non-learning request"), F.lit("general")),
    ]
    return reduce(DataFrame.unionByName, parts)


def records(topics: DataFrame, words: DataFrame, passages: DataFrame, others: DataFrame) -> DataFrame:
    """The requests with the first of each text alone (by part, place and number), blank ones dropped; ``quality`` silver, none for review."""
    first = first_of_each(requests(topics, words, passages, others), [F.col("part"), F.col("place"), F.col("n")])
    return first.withColumns({"quality": F.lit("silver"), "review_required": F.lit(False)})


def training_set(topics: DataFrame, words: DataFrame, passages: DataFrame, others: DataFrame, keep: Kept) -> DataFrame:
    """The records with consecutive ids in order."""
    rows = records(topics, words, passages, others)
    return numbered(rows, [F.col("part"), F.col("place"), F.col("n")], keep, form=ID).drop("part", "place", "n")
