"""The queries as DuckDB SQL, written from the same word lists but by other means (unnesting, windows, recursion)."""

from __future__ import annotations

from ..functions import vocabulary as V
from ..functions.text import SPACE
from ..functions.text import sql_literal as q
from ..operators import generator as G
from ..operators.documents import LEAST_ROWS_SAID, TABLE_HEADER, TABLE_RULE
from ..operators.routing import RULES, SINGLE_WORD
from ..operators.rubric import LINE_ENDS

TODAY = "2024-02-01"
TEMPLATES = [("什么是{topic}？能从{simple}讲起吗？", "zero"), ("{topic}这题怎么做？", "problem"), ("我总是{mistake}，{topic}错在哪？", "mistake")]


AFTER_STOP = "\n<!-- eval:stop -->\n总结：例如，为什么？诊断卡点；显然，加油"
GOOD_TABLE = "\n常见误区，至少 2 条\n| 常见错误 | 为什么错 | 正确理解 |\n|---|:---:|---|\n| a | b | c |\n| d | e | f |\n"
BAD_TABLE = "\n常见误区\n| 常见错误 | 为什么错 | 正确理解 |\n|---|---|---|\n| a | b | c |\n| d |  | f |\n"


def _re(p: str, flags: str = "") -> str:
    return q((f"(?{flags})" if flags else "") + p.replace(r"\s", SPACE))


def _hit(text: str, p: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {_re(p, flags)})"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace({x}, {q(SPACE + '+')}, ' ', 'g')")


def _code(c: str) -> str:
    inner = f"regexp_replace(lower({c}), {q(r'[\s_\-\x{a0}\x{2000}-\x{200b}\x{202f}\x{3000}\x{feff}]+')}, '-', 'g')"
    return f"nullif(regexp_replace({inner}, '^-|-$', '', 'g'), '')"


def _six(x: str) -> str:
    return f"round_even(({x}) * 1e6, 0) / 1e6"


def _three(x: str) -> str:
    return f"round_even(({x}) * 1000, 0) / 1000"


def _list(hits: list[tuple[str, str]]) -> str:
    """The given values whose condition holds, in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(v)} END" for v, c in hits) + "], lambda x: x IS NOT NULL)"


def _in(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


ROUTING = "routing AS (SELECT DISTINCT case_id, text, skill, category, source FROM routing_cases WHERE case_id IS NOT NULL)"


def _cascade() -> str:
    t = "t"
    words = _list([("word:" + p, f"contains({t}, {q(p)})") for p in V.WORD_PHRASES] + [
        ("word:single-english-word", _hit("s", SINGLE_WORD)), ("word:english-word-comparison", _hit(t, V.COMPARISON_PATTERN, "i"))])
    explicit = "CASE " + " ".join(f"WHEN contains({t}, {q(s)}) THEN {q(s)}" for s in V.SKILLS) + " END"
    lists, cases = [f"{explicit} AS explicit", f"{words} AS r0"], [
        f"WHEN t = '' THEN {{'skill': {q(V.DEFAULT_SKILL)}, 'confidence': 0.2::DOUBLE, 'rules': ['empty:fallback']}}",
        "WHEN explicit IS NOT NULL THEN {'skill': explicit, 'confidence': 1.0::DOUBLE, 'rules': ['explicit:' || explicit]}",
        "WHEN len(r0) > 0 THEN {'skill': 'word-deep-dive', 'confidence': 0.95::DOUBLE, 'rules': r0}",
    ]
    for i, r in enumerate(RULES, 1):
        lists.append(_list([(f"{r.tag}:{p}", f"contains({t}, {q(p)})") for p in r.phrases] + [(f"{r.pattern_tag}:{p}", _hit(t, p, "i")) for p in r.patterns]) + f" AS r{i}")
        veto = "".join(f" AND NOT contains({t}, {q(v)})" for v in r.vetoes)
        cases.append(f"WHEN len(r{i}) > 0{veto} THEN {{'skill': {q(r.skill)}, 'confidence': {r.confidence}::DOUBLE, 'rules': r{i}}}")
    end = f"ELSE {{'skill': {q(V.DEFAULT_SKILL)}, 'confidence': 0.4::DOUBLE, 'rules': ['fallback:{V.DEFAULT_SKILL}']}} END"
    return f"""{ROUTING},
      plain AS (SELECT *, lower({_collapse("coalesce(text, '')")}) AS t, {_strip("coalesce(text, '')")} AS s FROM routing),
      matched AS (SELECT *, {', '.join(lists)} FROM plain),
      routed AS (SELECT case_id, source, {_code('skill')} AS expected, CASE {' '.join(cases)} {end} AS r FROM matched),
      judged AS (SELECT case_id, source, expected, r.skill AS predicted FROM routed WHERE expected IN {_in(V.SKILLS)})"""


_CASCADE = "WITH " + _cascade()


def _report(source: str) -> str:
    return f"""labels AS (SELECT expected AS label FROM {source} UNION SELECT predicted FROM {source}),
      report AS (SELECT label, (SELECT count(*) FROM {source} WHERE expected = label AND predicted = label) AS hit,
        (SELECT count(*) FROM {source} WHERE expected = label) AS support, (SELECT count(*) FROM {source} WHERE predicted = label) AS chosen FROM labels),
      rated AS (SELECT label, support, coalesce(hit / nullif(chosen, 0), 0.0)::DOUBLE AS precision, coalesce(hit / nullif(support, 0), 0.0)::DOUBLE AS recall,
        coalesce(2 * hit / nullif(chosen + support, 0), 0.0)::DOUBLE AS f1 FROM report)"""


def _diagnosis() -> str:
    each = [
        f"{{'less': -len(e{i}), 'place': {i}, 'label': {q(k)}, 'evidence': e{i}}}" for i, k in enumerate(V.DIAGNOSES)
    ]
    lists = [_list([(p, _hit("t", p, "i")) for p in V.DIAGNOSIS_PATTERNS[k]]) + f" AS e{i}" for i, k in enumerate(V.DIAGNOSES)]
    names = "CASE predicted " + " ".join(f"WHEN {q(k)} THEN {q(n)}" for k, (n, _) in V.DIAGNOSES.items()) + " END"
    return f"""cases AS (SELECT DISTINCT case_id, text, label FROM diagnosis_cases WHERE case_id IS NOT NULL),
      plain AS (SELECT *, {_collapse("coalesce(text, '')")} AS t FROM cases),
      found AS (SELECT *, {', '.join(lists)} FROM plain),
      ranked AS (SELECT *, list_sort(list_filter([{', '.join(each)}], lambda x: x.less < 0)) AS r FROM found),
      best AS (SELECT case_id, label, t, r, coalesce(r[1].label, {q(V.DEFAULT_DIAGNOSIS)}) AS predicted FROM ranked),
      diagnosed AS (SELECT case_id, label, predicted, {names} AS name,
        CASE WHEN t = '' THEN 0.2 WHEN len(r) = 0 THEN 0.35 WHEN r[1].less = -1 THEN 0.7 WHEN r[1].less = -2 THEN 0.85 ELSE 0.95 END::DOUBLE AS confidence,
        coalesce(array_to_string(r[1].evidence, ' ; '), '') AS evidence,
        array_to_string(list_transform(r[2:3], lambda x: x.label), ',') AS secondary FROM best)"""


def _count(hits: list[str]) -> str:
    return "(" + " + ".join(f"({h})::INT" for h in hits) + ")" if hits else "0"


def _scorers() -> dict[str, str]:
    def has(words):
        return "(" + " OR ".join(f"contains(text, {q(w)})" for w in words) + ")"

    def any_(patterns):
        return "(" + " OR ".join(_hit("text", p) for p in patterns) + ")"

    n_intuition = _count([_hit("text", p) for p in V.INTUITION_PATTERNS])
    lines = f"string_split({_strip('text')}, chr(10))"
    paragraphs = f"len(list_filter({lines}, lambda x: {_strip('x')} <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '|')))"
    example = _hit("text", V.EXAMPLE_PATTERN)
    out = {
        "diagnosis": f"{has(V.DIAGNOSTIC_WORDS)}::INT + (len(regexp_extract_all(text, {q(V.QUESTION_MARK)})) >= 2)::INT",
        "intuition": f"CASE WHEN {n_intuition} >= 3 THEN 2 WHEN {n_intuition} >= 1 THEN 1 ELSE 0 END",
        "formal_definition": f"greatest({_hit('text', V.FORMAL_PATTERN)}::INT + {_hit('text', V.MATH_PATTERN)}::INT, (length(text) > 300)::INT)",
        "example": f"CASE WHEN {example} AND ({_hit('text', V.STEP_PATTERN)} OR {_hit('text', V.WORKED_PATTERN)}) THEN 2 WHEN {example} THEN 1 ELSE 0 END",
        "variation": f"{any_(V.VARIATION_PATTERNS)}::INT + {_hit('text', V.TEST_PATTERN)}::INT",
        "misconception": f"CASE WHEN NOT {_hit('text', V.MISCONCEPTION_PATTERN)} THEN 0 WHEN table_rows >= 2 THEN 2 ELSE 1 END",
        "conciseness": f"CASE WHEN len({lines}) < 5 THEN 0 WHEN len({lines}) > 120 OR {paragraphs} < 3 THEN 1 ELSE 2 END",
        "audience": f"CASE WHEN {has(V.ADVANCED_TERMS)} OR {_hit('text', V.ADVANCED_PATTERN)} THEN 0 ELSE 2 END",
        "method_summary": f"CASE WHEN {has(V.SUMMARY_WORDS)} AND regexp_matches(right({_strip('text')}, 200), {q(V.CLOSING_PATTERN)}) THEN 2 WHEN {has(V.SUMMARY_WORDS)} THEN 1 ELSE 0 END",
        "no_encouragement": f"CASE WHEN {any_(V.ENCOURAGEMENT_PATTERNS + V.SKIPPED_REASONING_PATTERNS)} THEN 0 ELSE 2 END",
        "exam_relevance": f"CASE WHEN {has(V.EXAM_WORDS)} AND {_hit('text', V.EXAM_ACTION_PATTERN)} THEN 2 WHEN {has(V.EXAM_WORDS)} THEN 1 ELSE 0 END",
    }
    for name, (full, patterns) in V.SIGNALS.items():
        n = _count([_hit("text", p, "im") for p in patterns])
        out[name] = f"CASE WHEN {n} >= {full} THEN 2 WHEN {n} >= 1 THEN 1 ELSE 0 END"
    return out


def _tables() -> str:
    def full(x: str, p: str) -> str:
        return f"regexp_full_match({x}, {_re(p, 'i')})"

    key = "array_to_string(list_transform(c[1:3], lambda x: lower(" + _collapse("x") + ")), chr(1))"
    return f"""answers AS (SELECT DISTINCT case_no, rubric, text, baseline FROM smoke WHERE case_no IS NOT NULL),
      lines AS (SELECT case_no, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT case_no, string_split_regex(text, {q(LINE_ENDS)}) AS l FROM answers WHERE text IS NOT NULL)),
      barred AS (SELECT case_no, pos, pos - row_number() OVER (PARTITION BY case_no ORDER BY pos) AS island, {_strip('line')} AS s FROM lines
        WHERE {_strip('line')} LIKE '|%' AND {_strip('line')} LIKE '%|'),
      cells AS (SELECT case_no, pos, island, list_transform(string_split(CASE WHEN length(s) > 1 THEN s[2:-2] ELSE '' END, '|'), lambda x: {_strip('x')}) AS c,
        row_number() OVER (PARTITION BY case_no, island ORDER BY pos) AS k FROM barred),
      heads AS (SELECT case_no, island FROM cells WHERE k = 1 AND len(c) >= 3 AND {full('c[1]', V.ERROR_HEADER)} AND {full('c[2]', V.REASON_HEADER)} AND {full('c[3]', V.CORRECTION_HEADER)}),
      good AS (SELECT case_no, island, count(DISTINCT {key}) AS n FROM cells JOIN heads USING (case_no, island)
        WHERE k > 1 AND len(c) >= 3 AND len(list_filter(c, lambda x: NOT regexp_full_match(x, ':?-{{3,}}:?'))) > 0
          AND len(list_filter(c[1:3], lambda x: x = '' OR {full('x', V.PLACEHOLDER)})) = 0 GROUP BY ALL),
      best AS (SELECT case_no, max(n) AS n FROM good GROUP BY case_no)"""


def _inline() -> str:
    """The same answers with the rubric taken from the marker, which is part of the text; nothing after the stop marker counts."""
    plain = _rubric()
    told = f"""concat('<!-- rubric: ', trim(rubric), ' -->', chr(10), CASE WHEN baseline THEN concat('<!-- rubric: baseline -->', chr(10)) ELSE '' END, text, chr(10))"""
    old = "answers AS (SELECT DISTINCT case_no, rubric, text, baseline FROM smoke WHERE case_no IS NOT NULL)"
    new = f"""answers AS (SELECT DISTINCT case_no, CASE WHEN baseline THEN 'concept' ELSE trim(rubric) END AS rubric, {told} AS text, baseline FROM smoke
        WHERE case_no IS NOT NULL AND {_strip('text')} <> '' AND regexp_full_match(trim(coalesce(rubric, '')), '[A-Za-z][A-Za-z0-9_-]*'))"""
    assert old in plain
    return plain.replace(old, new)


def _rubric() -> str:
    by = _scorers()
    named = _code("rubric")
    alias = f"CASE {named} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in V.RUBRIC_ALIASES.items()) + f" ELSE coalesce({named}, 'concept') END"
    used = sorted({s for dims in V.RUBRICS.values() for _, s in dims})
    unions = " UNION ALL ".join(
        f"SELECT case_no, used_rubric, is_baseline, {q(d)} AS dimension, s_{s} AS score FROM scored WHERE used_rubric = {q(r)}" for r, dims in V.RUBRICS.items() for d, s in dims
    )
    return f"""{_tables()},
      cases AS (SELECT answers.case_no, {alias} AS used_rubric, text, coalesce(baseline, false) AS is_baseline, coalesce(best.n, 0) AS table_rows
        FROM answers LEFT JOIN best USING (case_no) WHERE {_strip('text')} <> ''),
      scored AS (SELECT case_no, used_rubric, is_baseline, {', '.join(f'({by[s]}) AS s_{s}' for s in used)} FROM cases WHERE used_rubric IN {_in(V.RUBRICS)}),
      long AS ({unions}),
      totals AS (SELECT case_no, used_rubric, is_baseline, sum(score)::INT AS total, max(CASE WHEN dimension IN ('常见误区', '关键误区') THEN score END) = 2 AS p0_passed,
        max(CASE WHEN dimension = '避免空泛' THEN score END) = 2 AS style_passed FROM long GROUP BY ALL),
      judged AS (SELECT *, total >= {V.PASS_SCORE} AND p0_passed AND style_passed AS passed FROM totals)"""


def _profile(source: str, fields: list[str]) -> str:
    parts = [f"SELECT {q(f)} AS field, {f} AS value, count(*) AS n FROM {source} GROUP BY {f}" for f in fields]
    return " UNION ALL ".join([*parts, f"SELECT 'total', NULL, count(*) FROM {source}"])


_SUBJECTS = f"""subjects AS (SELECT DISTINCT id, {_code('subject')} AS subject, scenario, {_code('skill')} AS skill, {_code('diagnosis')} AS diagnosis FROM subject_cases WHERE id IS NOT NULL)"""
_TOKENS = "SELECT doc_id, source, greatest(1, trunc(length(regexp_replace(coalesce(text, ''), '[^\\x{0}-\\x{7f}]', '', 'g')) / 4.0::DOUBLE + length(regexp_replace(coalesce(text, ''), '[\\x{0}-\\x{7f}]', '', 'g')) / 1.7::DOUBLE)::INT) AS tokens FROM documents"
_TOPICS = f"topic_rows AS (SELECT DISTINCT topic_id, {_code('difficulty')} AS label, lower({_collapse('topic')}) AS topic FROM topics WHERE topic_id IS NOT NULL)"


def _candidates(unit: str) -> str:
    return f"""counts AS (SELECT {unit} AS g, label AS l, count(*) AS n FROM topic_rows WHERE {unit} IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
      spread AS (SELECT candidate, g, row_number() OVER (PARTITION BY candidate ORDER BY md5('42|' || candidate || '|' || g), g) <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY candidate)) AS test
        FROM (SELECT DISTINCT g FROM counts), range(128) AS r(candidate)),
      by_label AS (SELECT candidate, l, sum(n) AS n, sum(CASE WHEN test THEN n ELSE 0 END) AS t FROM spread JOIN counts USING (g) GROUP BY ALL),
      rated AS (SELECT candidate, round_even((abs(sum(t)::DOUBLE / sum(n)::DOUBLE - 0.2) + avg(abs(t::DOUBLE / n::DOUBLE - 0.2))) * 1e9, 0) / 1e9 AS score, min(least(t, n - t)) AS least FROM by_label GROUP BY candidate)"""


_GRAMS = """rows_ AS (SELECT DISTINCT case_id, regexp_replace(lower(text), '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}][\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g') AS t FROM diagnosis_cases WHERE case_id IS NOT NULL AND text IS NOT NULL),
      lens AS (SELECT case_id, t, unnest([2, 3, 4, 5]) AS k FROM rows_),
      grams AS (SELECT case_id, substring(t, i::BIGINT, k) AS gram FROM (SELECT case_id, t, k, unnest(range(1, length(t) - k + 2)) AS i FROM lens)),
      tf AS (SELECT case_id, gram, count(*) AS n FROM grams GROUP BY ALL),
      idf AS (SELECT gram, count(*) AS df, ln((1.0::DOUBLE + (SELECT count(*) FROM rows_)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY gram)"""

_FOLD = """reviews AS (SELECT concat_ws('|', user_id, event_type) AS item, ts, event_id, floor(value)::BIGINT % 6 AS quality FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
      numbered AS (SELECT item, ts::DATE AS day, least(5, greatest(0, CASE WHEN quality < 0 THEN quality + 6 ELSE quality END)) AS q, row_number() OVER (PARTITION BY item ORDER BY ts, event_id) AS k FROM reviews),
      fold AS (
        SELECT item, k, day, (q >= 3)::INT AS streak, 1 AS days, greatest(1.3::DOUBLE, round_even((2.5::DOUBLE + 0.1 - (5 - q) * (0.08::DOUBLE + 0.02 * (5 - q))) * 1000, 0) / 1000) AS ease FROM numbered WHERE k = 1
        UNION ALL
        SELECT item, k, day, streak, CASE WHEN streak < 2 THEN 1 WHEN streak = 2 THEN 6 ELSE greatest(1, least(365000, round_even(days * ease, 0)))::INT END, ease FROM (
          SELECT n.item, n.k, n.day, CASE WHEN q >= 3 THEN streak + 1 ELSE 0 END AS streak, days, greatest(1.3::DOUBLE, round_even((ease + 0.1 - (5 - q) * (0.08::DOUBLE + 0.02 * (5 - q))) * 1000, 0) / 1000) AS ease
          FROM fold f JOIN numbered n ON n.item = f.item AND n.k = f.k + 1)),
      state AS (SELECT item, k AS reviews, streak AS correct_streak, days AS interval_days, ease AS ease_factor, streak >= 5 AS mastered, day AS last_day FROM fold
        QUALIFY row_number() OVER (PARTITION BY item ORDER BY k DESC) = 1)"""
_SCORES = f"""late AS (SELECT item AS id, reviews, correct_streak, interval_days, ease_factor, mastered, (last_day + interval_days)::DATE AS due,
        greatest(0, DATE '{TODAY}' - (last_day + interval_days)::DATE) AS days_overdue FROM state),
      risks AS (SELECT *, CASE WHEN mastered AND due > DATE '{TODAY}' THEN 0.05 ELSE {_three(
    "least(0.99::DOUBLE, greatest(0.01::DOUBLE, CASE WHEN days_overdue = 0 THEN 0.25::DOUBLE ELSE 0.45 END + 0.45::DOUBLE * days_overdue / greatest(1, interval_days) - least(0.45::DOUBLE, 0.08::DOUBLE * correct_streak) - least(0.2::DOUBLE, 0.08::DOUBLE * (ease_factor - 1.3))))"
)} END AS forgetting_risk FROM late),
      scores AS (SELECT *, CASE WHEN mastered THEN 0.98 ELSE {_three(
    "least(0.97::DOUBLE, greatest(0.03::DOUBLE, 0.2::DOUBLE + least(0.7::DOUBLE, 0.14::DOUBLE * correct_streak) + least(0.15::DOUBLE, 0.06::DOUBLE * (ease_factor - 1.3)) - 0.35::DOUBLE * forgetting_risk))"
)} END AS mastery_probability,
        CASE WHEN mastered THEN 0.0 ELSE {_three(
    "least(1.0::DOUBLE, forgetting_risk + 0.25::DOUBLE * least(1.0::DOUBLE, days_overdue / greatest(1, interval_days)) + greatest(0.0::DOUBLE, 0.12::DOUBLE * (3 - correct_streak)) + CASE WHEN correct_streak = 0 THEN least(0.25::DOUBLE, 0.02::DOUBLE * reviews) ELSE 0 END)"
)} END AS review_priority FROM risks)"""
_ITEMS = f"WITH RECURSIVE {_FOLD}, {_SCORES}"

def _generated() -> str:
    """Each template as a row, filled in by nested replaces; the first of equal texts by part, place and number."""
    topic = [(t, label, c, G.diagnosis_of(c, label), "synthetic_from_public_course_topic") for label, ts in G.TEMPLATES.items() for t, c in ts]
    topic += [(t, label, c, d, "synthetic_hard_negative") for t, label, c, d in G.HARD_NEGATIVES]
    word = [(t, "word-deep-dive", "word", None, "synthetic_word_cases") for t in G.WORD_REQUESTS]
    passage = [(t, "text-memorizer", "text", None, "synthetic_text_memory") for t in G.PASSAGE_REQUESTS]

    def values(rows) -> str:
        said = ", ".join(f"({i}, " + ", ".join("NULL::VARCHAR" if v is None else q(v) for v in r) + ")" for i, r in enumerate(rows))
        return f"(VALUES {said}) AS v(n, template, label, category, diagnosis, source)"

    def fill(fields: dict[str, str]) -> str:
        out = "template"
        for name, x in fields.items():
            out = f"replace({out}, '{{{name}}}', coalesce({x}, ''))"
        return out

    called = "CASE subject " + " ".join(f"WHEN {q(k)} THEN {q(n)}" for k, n in G.SUBJECT_NAMES.items()) + " ELSE subject END"
    of_topic = fill({"subject_cn": called, **{f: f for f in G.FIELDS[1:]}})
    columns = "label, category, v.diagnosis AS diagnosis, source"
    return f"""WITH rows_ AS (SELECT 0 AS part, topic_id AS place, n, {of_topic} AS text, {columns}
          FROM (SELECT DISTINCT topic_id, subject, topic, simple, pair, problem, mistake, prerequisite FROM topics WHERE topic_id IS NOT NULL), {values(topic)}
        UNION ALL SELECT 1, p_partkey, n, {fill({'word': 'p_name', 'other': 'p_type'})}, {columns} FROM part, {values(word)}
        UNION ALL SELECT 2, item_id, n, {fill({'text': 'h.text', 'short': 'left(h.text, 18)'})}, {columns} FROM heldout_items h, {values(passage)}
        UNION ALL SELECT 3, n_nationkey, 0, n_name, 'non-learning', 'out_of_scope', NULL, 'visible_conversation_or_platform_pattern' FROM nation),
      firsts AS (SELECT * FROM rows_ WHERE {_strip('text')} <> '' QUALIFY row_number() OVER (PARTITION BY {_strip('text')} ORDER BY part, place, n) = 1)
      {_profile('firsts', ['label', 'category', 'source', 'diagnosis'])}"""


def _centroids() -> str:
    grams = _GRAMS.replace("SELECT DISTINCT case_id, regexp_replace(lower(text)", f"SELECT DISTINCT case_id, lower(trim(split)) AS split, replace({_code('label')}, '-', '_') AS label, regexp_replace(lower(text)")
    grams = grams.replace("text IS NOT NULL)", f"{_strip('text')} <> '' AND replace({_code('label')}, '-', '_') IN {_in(V.DIAGNOSES)})", 1)
    head = grams[: grams.index("idf AS (")]
    train = "SELECT case_id FROM rows_ WHERE split = 'train'"
    return f"""WITH {head} size AS (SELECT count(*) AS n FROM rows_ WHERE split = 'train'),
      idf AS (SELECT gram, ln((1.0::DOUBLE + (SELECT n FROM size)) / (1 + count(*))) + 1 AS idf FROM tf WHERE case_id IN ({train}) GROUP BY gram
        HAVING count(*) >= greatest(5, ceil((SELECT n FROM size) / 200.0::DOUBLE))),
      raw AS (SELECT case_id, gram, (1 + ln(n)) * idf AS r FROM tf JOIN idf USING (gram)),
      w AS (SELECT case_id, gram, r / sqrt(sum(r * r) OVER (PARTITION BY case_id)) AS w FROM raw),
      sizes AS (SELECT label, count(*) AS n FROM rows_ WHERE split = 'train' GROUP BY label),
      coef AS (SELECT gram, label, sum(w) / any_value(sizes.n) AS c FROM w JOIN rows_ USING (case_id) JOIN sizes USING (label) WHERE split = 'train' GROUP BY gram, label),
      held AS (SELECT case_id FROM rows_ WHERE split IN ('validation', 'test')),
      scores AS (SELECT held.case_id, sizes.label, coalesce(d.s, 0) AS s FROM held CROSS JOIN sizes
        LEFT JOIN (SELECT case_id, label, sum(w * c) AS s FROM w JOIN coef USING (gram) GROUP BY ALL) d ON d.case_id = held.case_id AND d.label = sizes.label),
      e AS (SELECT case_id, label, exp(s - max(s) OVER (PARTITION BY case_id)) AS e FROM scores),
      p AS (SELECT case_id, label, e / sum(e) OVER (PARTITION BY case_id) AS p FROM e)
      SELECT case_id, label AS skill, {_six('p')} AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY p DESC, label) = 1"""


SQL: dict[str, str] = {
    "route_cascade": f"{_CASCADE} SELECT case_id, r.skill AS predicted, r.confidence AS confidence, array_to_string(r.rules, '|') AS matched_rules FROM routed",
    "route_counts": f"{_CASCADE} SELECT r.skill AS predicted, count(*) AS n FROM routed GROUP BY 1",
    "route_accuracy": f"{_CASCADE} SELECT count(*) AS total, count(*) FILTER (expected = predicted) AS correct, {_six('coalesce(count(*) FILTER (expected = predicted) / nullif(count(*), 0), 0.0)::DOUBLE')} AS accuracy FROM judged",
    "route_confusion": f"{_CASCADE} SELECT expected, predicted, count(*) AS n FROM judged GROUP BY ALL",
    "route_class_report": f"{_CASCADE}, {_report('judged')} SELECT label, {_six('precision')} AS precision, {_six('recall')} AS recall, {_six('f1')} AS f1, support FROM rated",
    "route_averages": f"{_CASCADE}, {_report('judged')} SELECT {_six('avg(f1)')} AS macro_f1, {_six('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM rated",
    "route_slice": f"{_CASCADE}, part AS (SELECT * FROM judged WHERE source = 'web_form'), {_report('part')} SELECT (SELECT count(*) FROM part) AS rows, {_six('(SELECT avg((expected = predicted)::INT) FROM part)')} AS accuracy, {_six('avg(f1)')} AS macro_f1 FROM rated",
    "route_matrix": _CASCADE + ", skills AS (SELECT unnest([" + ", ".join(map(q, V.SKILLS)) + f"]) AS expected, unnest(range({len(V.SKILLS)}))::INT AS place) SELECT place, skills.expected, concat_ws(',', " + ", ".join(f"count(*) FILTER (predicted = {q(s)})" for s in V.SKILLS) + ") AS row FROM skills LEFT JOIN judged USING (expected) GROUP BY ALL",
    "diagnose_rank": f"WITH {_diagnosis()} SELECT case_id, predicted, name, confidence, evidence, secondary FROM diagnosed",
    "diagnose_accuracy": f"WITH {_diagnosis()}, judged AS (SELECT predicted, replace({_code('label')}, '-', '_') AS expected FROM diagnosed) SELECT count(*) AS total, count(*) FILTER (expected = predicted) AS correct, {_six('count(*) FILTER (expected = predicted) / count(*)')} AS accuracy FROM judged WHERE expected IN {_in(V.DIAGNOSES)}",
    "rubric_scores": f"WITH {_rubric()} SELECT case_no, dimension, score::INT AS score FROM long",
    "rubric_gate": f"WITH {_rubric()} SELECT case_no, used_rubric, total, p0_passed, style_passed, passed FROM judged",
    "suite_summary": f"WITH {_rubric()} SELECT count(*) AS total, count(*) FILTER (NOT is_baseline) AS judged, count(*) FILTER (is_baseline) AS baseline, count(*) FILTER (NOT is_baseline AND passed) AS passed, {_six('count(*) FILTER (NOT is_baseline AND passed) / count(*) FILTER (NOT is_baseline)')} AS accuracy, {_six('avg(total) FILTER (NOT is_baseline)')} AS average_score, {V.MAX_SCORE}::INT AS max_score FROM judged",
    "rubric_breakdown": f"WITH {_rubric()} SELECT used_rubric AS rubric, count(*) AS cases, count(*) FILTER (passed) AS passed, {_six('avg(total)')} AS average_score FROM judged GROUP BY 1",
    "md_table_rows": f"WITH {_tables()} SELECT case_no, coalesce(n, 0)::INT AS n FROM answers LEFT JOIN best USING (case_no) WHERE text IS NOT NULL",
    "inline_rubric": f"WITH {_inline()} SELECT case_no, used_rubric, is_baseline, total, {V.MAX_SCORE}::INT AS max_score, passed FROM judged",
    "generator_profile": _generated(),
    "request_check": f"SELECT DISTINCT case_id, CASE WHEN text IS NULL THEN 'the request is no text' WHEN {_strip('text')} = '' THEN 'the request is empty' ELSE concat('the request has ', length(text), ' characters; the limit is 20000') END AS problem FROM routing_cases WHERE case_id IS NOT NULL AND (text IS NULL OR {_strip('text')} = '' OR length(text) > 20000)",
    "router_scores": _centroids(),
    "token_estimate": f"SELECT doc_id, tokens FROM ({_TOKENS})",
    "budget_greedy": f"""WITH RECURSIVE items AS (SELECT source AS grp, doc_id AS ord, tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM ({_TOKENS}) WHERE source IS NOT NULL),
      fold AS (SELECT grp, k, ord, tokens, tokens <= 20000 AS kept, CASE WHEN tokens <= 20000 THEN tokens ELSE 0 END::BIGINT AS used FROM items WHERE k = 1
        UNION ALL SELECT i.grp, i.k, i.ord, i.tokens, used + i.tokens <= 20000, CASE WHEN used + i.tokens <= 20000 THEN used + i.tokens ELSE used END FROM fold f JOIN items i ON i.grp = f.grp AND i.k = f.k + 1)
      SELECT grp, ord, tokens, used FROM fold WHERE kept""",
    "subject_summary": f"WITH {_SUBJECTS} {_profile('subjects', ['subject', 'skill', 'diagnosis'])}",
    "subject_filter": f"WITH {_SUBJECTS} SELECT id, scenario FROM subjects WHERE subject = 'calculus'",
    "dataset_profile": f"WITH {ROUTING} {_profile('routing', ['skill', 'category', 'source'])}",
    "dedup_first_wins": f"WITH {ROUTING} SELECT min(case_id) AS case_id FROM routing WHERE {_strip('text')} <> '' GROUP BY {_strip('text')}",
    "record_keys": f"WITH answers AS (SELECT DISTINCT case_no, id, text, rubric FROM smoke WHERE case_no IS NOT NULL) SELECT case_no, CASE WHEN {_strip('id')} <> '' THEN {_strip('id')} ELSE 'derived:' || sha256(case_no || chr(0) || coalesce(text, '') || chr(0) || coalesce(rubric, '')) END AS record_key FROM answers",
    "repeated_ids": "SELECT id, count(DISTINCT case_no) AS n FROM smoke WHERE id IS NOT NULL AND case_no IS NOT NULL GROUP BY id HAVING count(DISTINCT case_no) > 1",
    "label_set": f"WITH {ROUTING}, have AS (SELECT DISTINCT {_code('skill')} AS label FROM routing WHERE {_code('skill')} IS NOT NULL), want AS (SELECT unnest([{', '.join(map(q, V.LEARNED_LABELS))}]) AS label) SELECT label, 'missing' AS problem FROM (SELECT * FROM want EXCEPT SELECT * FROM have) UNION ALL SELECT label, 'unexpected' FROM (SELECT * FROM have EXCEPT SELECT * FROM want)",
    "template_expand": "SELECT topic_id, label, replace(replace(replace(template, '{topic}', coalesce(topic, '')), '{simple}', coalesce(simple, '')), '{mistake}', coalesce(mistake, '')) AS text FROM (SELECT DISTINCT topic_id, topic, simple, mistake FROM topics WHERE topic_id IS NOT NULL), (VALUES " + ", ".join(f"({q(t)}, {q(b)})" for t, b in TEMPLATES) + ") AS v(template, label)",
    "stratified_split": f"WITH {ROUTING}, labelled AS (SELECT case_id, {_code('skill')} AS label FROM routing) SELECT case_id, CASE WHEN label IS NOT NULL AND row_number() OVER (PARTITION BY label ORDER BY md5('42|' || case_id), case_id) <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split FROM labelled",
    "group_candidates": f"WITH {_TOPICS}, {_candidates('topic')}, sizes AS (SELECT candidate, count(*) FILTER (test) AS test_groups FROM spread GROUP BY candidate) SELECT candidate, score, test_groups FROM rated JOIN sizes USING (candidate) WHERE least > 0",
    "leakage_report": "WITH sides AS (SELECT submitted_by, count(*) FILTER (split = 'test') AS t, count(*) AS n FROM (SELECT DISTINCT case_id, submitted_by, split FROM routing_cases WHERE case_id IS NOT NULL) WHERE submitted_by IS NOT NULL GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (t > 0 AND t < n) AS groups_on_both_sides, coalesce(sum(n) FILTER (t > 0 AND t < n), 0)::BIGINT AS rows_in_them FROM sides",
    "holdout_replay": "SELECT doc_id, 'there' AS state FROM documents WHERE doc_id IN (SELECT doc_id FROM review_labels) UNION ALL SELECT DISTINCT doc_id, 'missing' FROM review_labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "ngram_counts": f"WITH {_GRAMS} SELECT case_id, sum(n)::BIGINT AS grams, count(*) AS different, max(n) AS most FROM tf GROUP BY case_id",
    "idf_profile": f"WITH {_GRAMS} SELECT df, count(*) AS grams, {_six('max(idf)')} AS idf FROM idf GROUP BY df",
    "tfidf_norms": f"WITH {_GRAMS}, raw AS (SELECT case_id, (1 + ln(n)) * idf AS r FROM tf JOIN idf USING (gram)), w AS (SELECT case_id, r / sqrt(sum(r * r) OVER (PARTITION BY case_id)) AS w FROM raw) SELECT case_id, {_six('max(w)')} AS most, {_six('sum(w)')} AS total FROM w GROUP BY case_id",
    "linear_softmax": f"""WITH long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS w, unnest(range(len(embedding))) AS i FROM embeddings),
      means AS (SELECT label, i, avg(w) AS m FROM long GROUP BY ALL), scores AS (SELECT vec_id, means.label AS label, sum(w * m) AS s FROM long JOIN means USING (i) GROUP BY ALL),
      p AS (SELECT vec_id, label, exp(s - max(s) OVER v) AS e FROM scores WINDOW v AS (PARTITION BY vec_id)), shares AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM p)
      SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label)::INT AS rank, label::VARCHAR AS class, {_six('p')} AS p, p < 0.35 AS needs_fallback FROM shares QUALIFY rank <= 2""",
    "sm2_fold": f"WITH RECURSIVE {_FOLD} SELECT item, reviews, correct_streak, interval_days, ease_factor, mastered, last_day::VARCHAR AS last_day FROM state",
    "sched_scores": f"{_ITEMS} SELECT id, days_overdue::INT AS days_overdue, forgetting_risk, mastery_probability, review_priority FROM scores",
    "due_queue": f"{_ITEMS} SELECT id, review_priority FROM scores WHERE NOT mastered AND due <= DATE '{TODAY}' ORDER BY review_priority DESC, due, id LIMIT 20",
    "weakest_items": f"{_ITEMS} SELECT id, review_priority FROM scores WHERE NOT mastered ORDER BY review_priority DESC, due, id LIMIT 10",
    "mastery_stats": f"{_ITEMS} SELECT split_part(id, '|', 2) AS kind, count(*) AS total, count(*) FILTER (mastered) AS mastered, count(*) FILTER (NOT mastered) AS active, count(*) FILTER (NOT mastered AND due <= DATE '{TODAY}') AS due, round_even(100.0::DOUBLE * count(*) FILTER (mastered) / count(*) * 10, 0) / 10 AS mastered_percent FROM scores GROUP BY 1",
    "review_step": f"""{_ITEMS}, stepped AS (SELECT id, reviews + 1 AS review_count, correct_streak + 1 AS correct_streak, {_three('ease_factor + 0.1::DOUBLE - (0.08::DOUBLE + 0.02)')} AS ease_factor, interval_days AS before FROM scores),
      timed AS (SELECT *, CASE WHEN correct_streak = 1 THEN 1 WHEN correct_streak = 2 THEN 6 ELSE greatest(1, least(365000, round_even(before * ease_factor, 0))) END::INT AS interval_days FROM stepped)
      SELECT id, review_count, correct_streak, interval_days, ease_factor, correct_streak >= 5 AS mastered, ((DATE '{TODAY}' + interval_days)::DATE)::VARCHAR AS next_review FROM timed""",
    "basic_interval": """WITH reviews AS (SELECT concat_ws('|', user_id, event_type) AS item, ts, event_id, CASE WHEN floor(value)::BIGINT % 6 < 0 THEN floor(value)::BIGINT % 6 + 6 ELSE floor(value)::BIGINT % 6 END AS q FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
      runs AS (SELECT item, q, sum((q < 3)::INT) OVER (PARTITION BY item ORDER BY ts DESC, event_id DESC) AS wrong_after FROM reviews)
      SELECT item, least(32, pow(2, least(5, count(*) FILTER (wrong_after = 0))))::INT AS interval_days FROM runs GROUP BY item""",
    "doc_contract_errors": f"""WITH docs AS (SELECT doc_id, kind, subject, doc_id % 3 AS m, concat(coalesce(text, ''), CASE doc_id % 3 WHEN 0 THEN {q(GOOD_TABLE)} WHEN 1 THEN {q(BAD_TABLE)} ELSE '' END) AS body FROM documents),
      lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split_regex(body, '\\r\\n|\\n|\\r') AS l FROM docs)),
      heads AS (SELECT a.doc_id, a.pos FROM lines a JOIN lines b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
        WHERE regexp_full_match(a.line, {_re(TABLE_HEADER[2:-2])}) AND regexp_full_match(b.line, {_re(TABLE_RULE[2:-2])})),
      ends AS (SELECT h.doc_id, h.pos, coalesce(min(l.pos), 1000000000) AS upto FROM heads h LEFT JOIN lines l ON l.doc_id = h.doc_id AND l.pos > h.pos + 1 AND NOT starts_with({_strip('l.line')}, '|') GROUP BY ALL),
      cells AS (SELECT e.doc_id, e.pos AS head, list_transform(string_split(regexp_replace({_strip('l.line')}, '^\\|+|\\|+$', '', 'g'), '|'), lambda x: {_strip('x')}) AS c FROM ends e JOIN lines l ON l.doc_id = e.doc_id AND l.pos > e.pos + 1 AND l.pos < e.upto),
      tables AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, head, count(*) FILTER (len(c) = 3 AND NOT list_contains(c, '')) AS n FROM cells GROUP BY ALL) GROUP BY doc_id)
      SELECT doc_id, CASE WHEN NOT regexp_matches(body, {q('[^' + SPACE[1:])}) THEN 'the body is empty' ELSE concat_ws('; ', CASE WHEN coalesce(kind, '') = '' THEN 'no name' END,
      CASE WHEN coalesce(kind, '') <> '' AND NOT regexp_full_match(kind, '[a-z0-9]+(-[a-z0-9]+)*') THEN 'name is not in lower case with hyphens' END,
      CASE WHEN contains(kind, '_') THEN 'name and directory differ' END, CASE WHEN coalesce(subject, '') = '' THEN 'no description' END,
      CASE WHEN NOT contains(body, '常见误区') THEN 'no section on misconceptions' END,
      CASE WHEN contains(body, '常见误区') AND NOT {_hit('body', LEAST_ROWS_SAID)} THEN 'the least number of misconceptions is not said' END,
      CASE WHEN coalesce(n, 0) < 2 THEN 'no table of two misconceptions' END) END AS errors FROM docs LEFT JOIN tables USING (doc_id)""",
}
