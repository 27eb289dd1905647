"""Terms of texts as 64-bit hashes, for whole Arrow batches at once.

A batch of texts becomes one array of code points.  Table look-ups fold letter case, compatibility forms, accents and
look-alike letters, and remove invisible characters; words and ideographs are then hashed with array operations, so that no
Python code runs per document or per word.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

# Letters of other scripts by the Latin letter of the same look.
LOOK_ALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еє", "f": "ƒ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "k": "кκ",
    "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν",
    "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ", "D": "Ԁ", "G": "Ԍ", "Q": "Ԛ", "W": "Ԝ", "V": "Ѵ", "L": "Ꮮ",
}

SEPARATOR, IGNORED = 0, 0xFFFFFFFF
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLANES = 0x30000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values whose bits all depend on all bits of the input."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, re.Pattern[str], dict[str, str]]:
    """Folded code point and class (0 separator, 1 letter or digit of a word, 2 ideograph) by code point; joined forms."""
    fold = np.zeros(_PLANES, np.uint32)
    several: dict[str, str] = {}
    latin = {other: plain.lower() for plain, others in LOOK_ALIKES.items() for other in others}
    ideographs = [(0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x2F800), (0xAC00, 0xD7A4)]
    for first, last in ideographs:
        fold[first:last] = np.arange(first, last)
    for cp in (c for c in range(0x2FA20) if not any(a <= c < b for a, b in ideographs)):
        if 0xD800 <= cp < 0xF900 or 0x18000 <= cp < 0x1D400 or 0x1E000 <= cp < 0x1F000 or 0x30000 <= cp < 0x2F800:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cf", "Mn", "Me"):
            fold[cp] = IGNORED
            continue
        if kind[0] not in "LN":
            continue
        base = [c for c in unicodedata.normalize("NFKD", ch) if unicodedata.category(c)[0] in "LN"]
        base = [latin.get(c) or c.lower()[:1] for c in base]
        if len(base) > 1 and kind[0] == "L":
            several[ch] = "".join(base)
        if base and not (kind == "No" and len(base) > 1):
            fold[cp] = ord(base[0])
    kinds = np.where((fold == SEPARATOR) | (fold == IGNORED), 0, 1).astype(np.uint8)
    folded = np.where(fold == IGNORED, 0, fold)
    for first, last in ideographs:
        kinds[(folded >= first) & (folded < last) & (kinds == 1)] = 2
    return fold, kinds, re.compile("[" + "".join(map(re.escape, several)) + "]"), several


@lru_cache(maxsize=1)
def _classed() -> np.ndarray:
    """Folded code point and, above 24 bits, its class (3: ignored) by code point."""
    fold, kinds, _, _ = _tables()
    return np.where(fold == IGNORED, np.uint32(3 << 24), fold & np.uint32(0xFFFFFF) | kinds.astype(np.uint32) << np.uint32(24)).astype(np.uint32)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the prime and of its inverse (modulo 2^64), at least ``n``."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        for i, factor in enumerate((_PRIME, inverse)):
            every = np.full(size, factor, np.uint64)
            every[0] = 1
            _powers[i] = np.cumprod(every)
    return _powers[0], _powers[1]


def _run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each run of values the sum of value times prime to its place in the run: differences of one running sum."""
    powers, inverse = _power_tables(len(values))
    sums = np.cumsum(values * powers[: len(values)])
    before = np.where(starts > 0, sums[np.maximum(starts, 1) - 1], np.uint64(0))
    return mixed((sums[ends - 1] - before) * inverse[starts])


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in turn: each token's hash, its text's index, and whether it is an ideograph.

    A token is a run of letters and digits or one ideograph; punctuation, spacing and invisible characters are dropped.
    """
    _, _, joined, several = _tables()
    whole = "".join(texts)
    if joined.search(whole):
        texts = [joined.sub(lambda m: several[m[0]], t) for t in texts]
        whole = "".join(texts)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _classed().take(codes, mode="clip")  # the last entry, of a code point without a character, is a separator
    kind = (found >> np.uint32(24)).astype(np.uint8)
    ignored = kind == 3
    if ignored.any():
        keep = ~ignored
        offsets = np.append(0, np.cumsum(keep))[offsets]
        found, kind = found[keep], kind[keep]
    if not len(kind):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, bool)
    word = kind == 1
    bound = np.zeros(len(kind) + 1, bool)
    bound[offsets] = True
    first = kind == 2
    last = first.copy()
    inner = word[1:] & word[:-1] & ~bound[1:-1]  # a character and the one before it are of one word
    first[0] |= word[0]
    first[1:] |= word[1:] & ~inner
    last[-1] |= word[-1]
    last[:-1] |= word[:-1] & ~inner
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, bool)
    hashes = _run_hashes((found & np.uint32(0xFFFFFF)).astype(np.uint64) + np.uint64(1), starts, ends)
    per_text = np.diff(np.searchsorted(starts, offsets))
    return hashes, np.repeat(np.arange(len(texts), dtype=np.int32), per_text), kind[starts] == 2


def _runs(hashes: np.ndarray, of: np.ndarray, ideograph: np.ndarray, length: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    x = hashes[:n].copy()
    first = ideograph[:n]
    every = first.copy()
    some = first.copy()
    for j in range(1, length):
        x = mixed(x * np.uint64(31) + hashes[j : n + j])
        every &= ideograph[j : n + j]
        some |= ideograph[j : n + j]
    fits = (of[:n] == of[length - 1 :]) & {"words": ~some, "ideographs": every, "both": some & ~every}[kind]
    return (x + np.uint64(length))[fits], of[:n][fits]


def grams(texts: list[str], runs: tuple[tuple[str, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Terms of each text and their texts, in order of text, with repeats; ``runs`` names kinds of token and how many make a term.

    A text that is too short for any term gets its whole token sequence as its only term; a text without tokens has none.
    """
    return grams_of(*tokens(texts), len(texts), runs)


def grams_of(
    hashes: np.ndarray, of: np.ndarray, ideograph: np.ndarray, n: int, runs: tuple[tuple[str, int], ...], in_order: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """The same from the tokens of ``n`` texts; unless ``in_order``, by kind of run."""
    parts = [_runs(hashes, of, ideograph, length, kind) for kind, length in runs]
    terms, docs = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    has = np.zeros(n, bool)
    has[docs] = True
    lacking = np.flatnonzero(np.bincount(of, minlength=n).astype(bool) & ~has)
    if len(lacking):
        all_of = whole(hashes, of, n)
        terms, docs = np.concatenate([terms, all_of[lacking]]), np.concatenate([docs, lacking.astype(np.int32)])
    if not in_order:
        return terms, docs
    order = np.argsort(docs, kind="stable")  # a merge of runs that are already in order
    return terms[order], docs[order]


def keyed(terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Text number and the upper 48 bits of the term as one number, by which a batch is put in order at once; texts below 2^16."""
    return docs.astype(np.uint64) << np.uint64(48) | terms >> np.uint64(16)


def distinct(terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's terms once (``docs`` must be in order), in order of text and term; of a term's hash the upper 48 bits count and the others become 0."""
    out = []
    step = 1 << 16
    for first in range(0, int(docs[-1]) + 1 if len(docs) else 0, step):
        part = slice(*np.searchsorted(docs, (first, first + step)))
        keys = np.sort(keyed(terms[part], docs[part] - first))
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        out.append((keys << np.uint64(16), (keys >> np.uint64(48)).astype(np.int32) + np.int32(first)))
    if not out:
        return terms[:0], docs[:0]
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def whole(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """A hash of each text's token sequence; 0 where a text has no token."""
    out = np.zeros(n, np.uint64)
    if len(hashes):
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        out[of[first]] = _run_hashes(hashes + np.uint64(1), first, np.append(first[1:], len(of))) | np.uint64(1)
    return out


def both_wholes(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each text's token sequence, 127 bits in all, by which equal texts are known."""
    return whole(hashes, of, n), whole(mixed(hashes ^ _MIX1), of, n)
