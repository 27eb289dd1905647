"""One consistent form for texts whose characters only look usual (problem 2)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import ship
from .batches import slices
from .terms import LOOK_ALIKES

#: Length of the character n-grams, and the corpus' most frequent n-grams of each script that are broadcast.
ORDER, NGRAMS = 3, 60_000

_EMOJI = "\U0001f000-\U0001faff\u2600-\u27bf\u2b00-\u2bff\ufe0f\U0001f3fb-\U0001f3ff"
# Blanks other than the plain one, and characters that show nothing.
_BLANKS = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_IGNORABLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u200c\u200e\u200f\u202a-\u202e\u2060-\u206f\u3164\ufeff\uffa0\U000e0000-\U000e007f"
_JOINER = f"(?<![{_EMOJI}])\u200d|\u200d(?![{_EMOJI}])"
_VARIANT = f"(?<![{_EMOJI}0-9#*])[\ufe00-\ufe0f]"
# Wide and joined letters, digits and ideographs, and their variant codes; signs, superscripts and fractions stay.
_WIDE = (
    "\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\uff9f\uffa1-\uffdc\ufb00-\ufb06\ufb13-\ufb17\u2e80-\u2ef3\u2f00-\u2fd5\uf900-\ufaff"
    "\U0001d400-\U0001d7cb\U0001d7ce-\U0001d7ff\U0002f800-\U0002fa1f\u0132\u0133\u0149\u01c4-\u01cc\u01f1-\u01f3"
)
_MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20f0\u3099\u309a"
_OTHER_SCRIPT = "".join(LOOK_ALIKES.values())
#: A row whose text has none of these can't be a case.
SUSPECT = f"[{_BLANKS}{_IGNORABLE}\u200d\ufe00-\ufe0f{_WIDE}{_MARKS}{_OTHER_SCRIPT}]"


@lru_cache(maxsize=1)
def _patterns() -> dict[str, re.Pattern[str]]:
    return {
        "blank": re.compile(f"[{_BLANKS}]"),
        "hidden": re.compile(f"[{_IGNORABLE}]|{_JOINER}|{_VARIANT}"),
        "wide": re.compile(f"[{_WIDE}]+"),
        "marked": re.compile(f"[^\\W\\d_][{_MARKS}]+"),
        "mark": re.compile(f"[{_MARKS}]"),
        "other": re.compile(f"[{_OTHER_SCRIPT}]"),
        "word": re.compile(r"[^\W\d_\u4e00-\u9fff\u3400-\u4dbf]+"),
    }


@lru_cache(maxsize=1)
def _plain_letters() -> dict[str, str]:
    return {other: plain for plain, others in LOOK_ALIKES.items() for other in others}


def compatible(text: str) -> tuple[str, bool]:
    """The text with plain blanks, without ignorable characters, with usual forms and composed accents; whether that changed it."""
    p = _patterns()
    new = p["hidden"].sub("", text)
    new = p["blank"].sub(" ", new)
    new = p["wide"].sub(lambda m: unicodedata.normalize("NFKC", m[0]), new)
    if p["mark"].search(new):
        new = p["marked"].sub(lambda m: unicodedata.normalize("NFC", m[0]), new)
    return new, new != text


def script(ch: str) -> str:
    """latin, greek, cyrillic, or other."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    return "latin" if 0x250 <= o < 0x2B0 else "other"


class Spelling:
    """Character n-gram log-probabilities of words of one script, from counts over the whole corpus."""

    def __init__(self, counts: dict[str, int]):
        self.grams = counts
        self.before: Counter[str] = Counter()
        self.letters: dict[str, set[str]] = {}
        for gram, n in counts.items():
            self.before[gram[:-1]] += n
            self.letters.setdefault(script(gram[-1]) if gram[-1].isalpha() else "", set()).add(gram[-1])
        self.total = Counter({s: len(x) for s, x in self.letters.items()})

    def step(self, context: str, ch: str, of: str) -> float:
        """ln P(ch | the letters before it) within script ``of``; a letter of another script costs as much as an unseen gram of none."""
        own = script(ch) == of
        seen = self.grams.get(context + ch, 0) if own else 0
        return math.log((seen + (0.5 if own else 1e-4)) / (self.before.get(context, 0) + 0.5 * max(26, self.total.get(of, 0))))


def best_spelling(word: str, model: Spelling) -> str:
    """The word's likeliest spelling by its look.

    A word whose letters are all of one script other than Latin stays as it is: that is a whole word in that script. In any other
    each letter may be itself or a letter of the same look (the lattice): in Latin the plain letter, in Greek and Cyrillic any. For
    each script Viterbi search finds the path of greatest n-gram score whose letters all belong to it; the best of these is the
    spelling. Equal scores prefer Latin, then plain letters, then the letters as they are.
    """
    plain = _plain_letters()
    scripts = {script(c) for c in word}
    if "latin" not in scripts and (len(scripts) == 1 or not all(c in plain for c in word)):
        return word
    best, best_score = word, None
    for of in ("latin", "greek", "cyrillic"):
        choices = []
        for c in word:
            own = [plain[c]] if c in plain else []
            own += [c] + ([] if of == "latin" else sorted(LOOK_ALIKES.get(plain.get(c, c), "")))
            choices.append([x for x in dict.fromkeys(own) if script(x) == of])
        if not all(choices):
            continue
        paths = {"^" * (ORDER - 1): (0.0, "")}
        for options in choices:
            after: dict[str, tuple[float, str]] = {}
            for context, (score, said) in paths.items():
                for ch in options:
                    low = ch.lower()
                    s = score + model.step(context, low, of)
                    key = (context + low)[-(ORDER - 1) :]
                    if key not in after or s > after[key][0]:
                        after[key] = (s, said + ch)
            paths = after
        score, said = max(paths.values(), key=lambda x: x[0])  # the first of equals, and plain letters come first
        if best_score is None or score > best_score:
            best, best_score = said, score
    if best_score is None:  # no script can write all of it: at least its look-alikes go with the letters around them
        if "latin" in scripts:
            return "".join(plain.get(c, c) for c in word)
        return word
    return best


def _mixed_words(text: str) -> list[re.Match[str]]:
    """Words with a look-alike letter of another script, and either a Latin letter or none but look-alikes."""
    p = _patterns()
    if not p["other"].search(text):
        return []
    plain, found = _plain_letters(), []
    for m in p["word"].finditer(text):
        w = m[0]
        foreign = [c for c in w if c in plain]
        if foreign and (any(script(c) == "latin" for c in w) or len(w) > 1 and len(foreign) == len(w)):
            found.append(m)
    return found


def consistent(text: str, model: Spelling) -> tuple[str, bool]:
    """The text in one form, and whether it held a character that stands in for another or can't be seen."""
    new, changed = compatible(text)
    out, last = [], 0
    for m in _mixed_words(new):
        w = best_spelling(m[0], model)
        if w != m[0]:
            out.append(new[last : m.start()] + w)
            last = m.end()
            changed = True
    return "".join(out) + new[last:], changed


_LETTERS = 0x530


@lru_cache(maxsize=1)
def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point below _LETTERS: the lower-case letter (0: none) and its script (1 latin, 2 greek, 3 cyrillic)."""
    lower, scripts = np.zeros(_LETTERS, np.int64), np.zeros(_LETTERS, np.int8)
    for cp in range(_LETTERS):
        ch = chr(cp)
        kind = ("latin", "greek", "cyrillic").index(script(ch)) + 1 if script(ch) != "other" else 0
        if ch.isalpha() and kind:
            lower[cp], scripts[cp] = ord(ch.lower()[0]), kind
    return lower, scripts


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of all words of two or more letters of one script, with ``^`` before a word's start, and their counts."""
    lower, scripts = _letter_tables()
    codes = _codes(texts)
    inside = codes < _LETTERS
    low = np.where(inside, lower[np.where(inside, codes, 0)], 0)
    kind = np.where(inside, scripts[np.where(inside, codes, 0)], 0)
    letter = low > 0
    edge = np.flatnonzero(np.append(True, letter[1:] != letter[:-1]))
    length = np.diff(np.append(edge, len(low)))
    most, least = np.maximum.reduceat(kind, edge), np.minimum.reduceat(kind, edge)
    good = np.repeat(letter[edge] & (most == least) & (length > 1), length)
    place = np.arange(len(low)) - np.repeat(edge, length)
    packed = low.copy()
    for back in range(1, ORDER):
        before = np.append(np.zeros(back, np.int64), low)[: len(low)]
        packed |= np.where(place >= back, before, ord("^")) << (16 * back)
    return np.unique(packed[good], return_counts=True)


def spelling_model(texts: DataFrame, most: int = NGRAMS) -> Broadcast:
    """Counts all words' n-grams over all texts, added up per task; the ``most`` frequent of each script are broadcast.

    The model only ranks spellings; rarer n-grams count as unseen, so the bound drops no text and no word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for _, some in slices(batches):
            grams, counts = ngram_counts(some)
            total.update(dict(zip(grams.tolist(), counts.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["gram", "n"])

    last = F.col("gram").bitwiseAND(F.lit(0xFFFF))
    kind = F.when(last < 0x250, 1).when((last >= 0x370) & (last < 0x400), 2).when(last >= 0x400, 3).otherwise(1)
    counts = texts.where(F.col("text").isNotNull()).select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= most)
    rows = {}
    for r in ranked.collect():
        rows["".join(chr(r["gram"] >> (16 * back) & 0xFFFF) for back in reversed(range(ORDER)))] = r["n"]
    return texts.sparkSession.sparkContext.broadcast(Spelling(rows))


@lru_cache(maxsize=1)
def _suspects() -> np.ndarray:
    pattern = re.compile(SUSPECT)
    table = np.zeros(0x110000, bool)
    for cp in range(0x20000):
        if not 0xD800 <= cp < 0xE000 and pattern.match(chr(cp)):
            table[cp] = True
    table[0x2F800:0x2FA20] = True
    table[0xE0000:0xE0080] = True
    return table


def suspicious(texts: list[str]) -> np.ndarray:
    """Whether each text has any character that may be invisible, a variant or a look-alike."""
    marks = _suspects()[_codes(texts)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.diff(np.append(0, np.cumsum(marks)[ends - 1])) > 0 if texts else np.zeros(0, bool)


def plain_texts(rows: DataFrame, columns: list[str], texts: DataFrame | None = None, with_text: bool = True) -> DataFrame:
    """All ``rows`` (with ``text``): ``columns``, ``plain`` (the text in one form; only ``with_text``), and ``disguised``.

    Texts without any suspicious character, which one table look-up tells, stay as they are; the others go through normalization
    and the look-alike search. Null texts stay null and blank ones blank; neither is a case unless a blank is not the plain one.
    ``texts``: the corpus for the n-gram scores, by default the rows themselves.
    """
    ship(rows.sparkSession)
    model = spelling_model(rows if texts is None else texts)
    types = dict(rows.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in slices(batches):
            found = np.zeros(len(some), bool)
            plain = list(some)
            for i in np.flatnonzero(suspicious(some)).tolist():
                plain[i], found[i] = consistent(some[i], model.value)
            out = [*(part.column(c) for c in columns), pa.array(found)]
            if with_text:
                nulls = part.column("text").is_null().to_pylist()
                out.append(pa.array([None if no else p for no, p in zip(nulls, plain)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, [*columns, "disguised", *["plain"] * with_text])

    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", disguised boolean" + ", plain string" * with_text
    return rows.select(*columns, *([] if "text" in columns else ["text"])).mapInArrow(work, schema)
