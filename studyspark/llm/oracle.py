"""The pN_ queries as DuckDB SQL, where SQL can say what must come out; written from the same character tables by other means."""

from __future__ import annotations

from . import disguise
from .terms import LOOK_ALIKES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _code(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(lower({c}), '[\\s_\\-\\x{{a0}}\\x{{2000}}-\\x{{200b}}\\x{{202f}}\\x{{3000}}\\x{{feff}}]+', '-', 'g'), '^-|-$', '', 'g'), '')"


_LISTED = f"""WITH targets AS (SELECT target_id, tab, field, {_code('value')} AS value, target_share, min_rows, sample_rate FROM sample_targets),
  rows_ AS (SELECT DISTINCT 'routing_cases' AS tab, 'skill' AS field, case_id::VARCHAR AS k, {_code('skill')} AS value FROM routing_cases WHERE case_id IS NOT NULL
    UNION ALL SELECT DISTINCT 'routing_cases', 'category', case_id::VARCHAR, {_code('category')} FROM routing_cases WHERE case_id IS NOT NULL
    UNION ALL SELECT DISTINCT 'subject_cases', 'subject', id, {_code('subject')} FROM subject_cases WHERE id IS NOT NULL),
  listed AS (SELECT r.tab, r.field, r.value, count(DISTINCT k) AS n FROM rows_ r JOIN targets t USING (tab, field, value) GROUP BY ALL),
  sizes AS (SELECT tab, field, sum(n) AS n FROM listed GROUP BY ALL),
  judged AS (SELECT target_id, tab, field, value, coalesce(listed.n, 0) AS available, greatest(min_rows, floor(target_share * floor(sample_rate * coalesce(sizes.n, 0))))::BIGINT AS wanted
    FROM targets LEFT JOIN listed USING (tab, field, value) LEFT JOIN sizes USING (tab, field))"""


def _disguised() -> str:
    """Rows with a character of the tables: invisible ones, forms, composable accents, or a look-alike and a Latin letter in one word."""
    emoji, look = disguise._EMOJI, "".join(LOOK_ALIKES.values())
    letters = r"\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}"
    latin = r"\p{Latin}"
    patterns = [
        f"[{disguise._BLANKS}{disguise._IGNORABLE}{disguise._WIDE}]",
        f"(^|[^{emoji}])‍|‍([^{emoji}]|$)",
        f"(^|[^{emoji}0-9#*])[︀-️]",
        f"[{look}][{letters}]*{latin}|{latin}[{letters}]*[{look}]",
    ]
    hit = " OR ".join(f"regexp_matches(text, {_q(p)})" for p in patterns)
    return f"({hit} OR (regexp_matches(text, {_q(f'[^0-9_ ][{disguise._MARKS}]')}) AND nfc_normalize(text) <> text))"


_WIDE_LETTERS = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN_LETTERS = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_FOREIGN = "".join(LOOK_ALIKES.values())
_OWN = "".join(plain.lower() * len(others) for plain, others in LOOK_ALIKES.items())


def _topics() -> str:
    """Topics by key, rows of one cell joined; groups by following rows that share an entity until no smaller id is met."""
    form = f"translate(nfc_normalize(topic), {_q(_WIDE_LETTERS)}, {_q(_PLAIN_LETTERS)})"
    key = f"lower(regexp_replace({form.replace('topic', 'part')}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
    key = f"CASE WHEN regexp_matches({key}, '[a-z]') THEN translate({key}, {_q(_FOREIGN)}, {_q(_OWN)}) ELSE {key} END"
    return f"""rows_ AS (SELECT DISTINCT topic_id, {_code('subject')} AS subject, topic FROM topics WHERE topic_id IS NOT NULL),
      cells AS (SELECT topic_id, subject, unnest(string_split_regex({form}, '[/&+|;、；]')) AS part FROM rows_ WHERE subject IS NOT NULL AND topic IS NOT NULL),
      entities AS (SELECT DISTINCT topic_id, subject || chr(1) || k AS entity FROM (SELECT topic_id, subject, {key} AS k FROM cells) WHERE k <> ''),
      links AS (SELECT DISTINCT a.topic_id AS a, b.topic_id AS b FROM entities a JOIN entities b USING (entity)),
      reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
      groups_ AS (SELECT a AS topic_id, min(b) AS group_id, count(DISTINCT b) AS members FROM reach GROUP BY a)"""


ORACLE: dict[str, str] = {
    "p2_found": f"""SELECT DISTINCT tab, case_id FROM (SELECT 'routing_cases' AS tab, case_id, text FROM routing_cases UNION ALL SELECT 'diagnosis_cases', case_id, text FROM diagnosis_cases)
      WHERE {_disguised()}""",
    "p3_found": f"{_LISTED} SELECT target_id FROM judged WHERE available < wanted",
    "p3_balance": f"{_LISTED} SELECT target_id, available, wanted, true AS has_minimum, true AS each_once FROM judged",
    "p4_found": f"WITH RECURSIVE {_topics()} SELECT topic_id, group_id FROM groups_ WHERE members > 1",
    "p4_balance": "SELECT count(DISTINCT topic_id) AS topics, 0::BIGINT AS groups_in_two_splits, true AS near_shares FROM topics",
    "p7_found": """WITH sizes AS (SELECT source, sum(length(text)) AS n FROM documents JOIN mix_targets USING (source) GROUP BY source)
      SELECT source FROM mix_targets LEFT JOIN sizes USING (source) WHERE coalesce(n, 0) * max_repeats < weight * (SELECT sum(n) FROM sizes)""",
    "p7_balance": """WITH sizes AS (SELECT source, sum(length(text)) AS n FROM documents JOIN mix_targets USING (source) GROUP BY source)
      SELECT source, coalesce(n, 0) * max_repeats < weight * (SELECT sum(n) FROM sizes) AS short, true AS fitted_exactly, true AS within_repeats FROM mix_targets LEFT JOIN sizes USING (source)""",
    "p8_coverage": "SELECT source, count(*) AS documents, true AS scored FROM documents GROUP BY source",
}
