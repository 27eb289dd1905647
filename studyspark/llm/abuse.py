"""Scores of abusive, hateful or sexual content (problem 8) by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import Kept, ship
from .batches import slices
from .disguise import compatible, suspicious
from .terms import grams_of, tokens

#: Most reviewed-toxic documents, other reviewed and unlabelled documents that the classifier is fitted on, and the most characters of
#: one of them and of all of each kind.
FIT_TOXIC, FIT_OTHER, FIT_UNLABELLED, FIT_LONGEST, FIT_CHARS = 1_500, 1_500, 3_000, 20_000, 4_000_000
#: Hashed features; toxic documents, or documents at all, that must have one; rounds of choosing the toxic passages of toxic
#: documents; rounds in which unlabelled passages of log-odds over SURE join the examples; steps of each fit, the step size and the
#: weights' decay.
FEATURES, LEAST_TOXIC, LEAST_DOCS, ROUNDS, MORE, SURE, STEPS, RATE, DECAY = 1 << 18, 2, 6, 2, 2, -1.0, 80, 0.05, 3e-4
#: Share of passages of documents reviewed as harmless that an example passage must exceed; bounds of the class prior.
ABOVE, PRIORS = 0.995, (5e-4, 0.05)
#: Value of a feature that tells a kind of listed word, and the score from which a document counts as toxic.
KIND, VERDICT = 0.6, 0.3
RUNS = (("words", 1), ("words", 2), ("words", 3), ("ideographs", 2), ("ideographs", 3), ("ideographs", 4))

_INSIDE = r"[^\n\r。！？!?；;.]*"
_PASSAGE = re.compile(_INSIDE + r"(?:\.(?!\s)" + _INSIDE + r")*(?:[。！？!?；;]|[\n\r]+|\.\s+|\Z)")
_MASKS = re.compile(r"[*_\-·~^.#+]+(?=[^\W\d_])")
_LEET = re.compile(r"(?<![A-Za-z])[A-Za-z]*(?:[@$]+[A-Za-z013457]|[A-Za-z][013457]+[A-Za-z]|[A-Za-z]!+[a-z])[A-Za-z013457@$!]*")
_LEET_HINT = re.compile(r"[@$]|[013457!][A-Za-z]")
# Signs and digits that stand for a letter inside a word.
_LETTERS = str.maketrans("@$!013457", "asioieast")

# Common words of each kind of abuse, as features that words never seen in reviewed documents share.
WORDS = {
    "insult": "idiot moron imbecile cretin halfwit stupid dumb loser scum trash garbage worthless pathetic ugly pig cow disgusting "
    "白痴 蠢货 废物 垃圾 笨蛋 猪脑子 没脑子 混蛋 贱人 丢人现眼 恶心 脑残",
    "swearing": "fuck fucking shit bullshit bitch bastard asshole dumbass shithead goddamn damn 操你 妈的 他妈 狗屁 滚出去 闭嘴 去死",
    "threat": "kill smash break hunt stab shoot hang yourself die fingers bones 打断 砸烂 弄死 杀了 找到你 跑不掉 等着瞧 站不起来 上路",
    "contempt": "vermin subhuman parasites rats filthy dirt breed immigrants tribe inferior scum disease 畜生 寄生虫 下等人 脏货 低贱 消灭 赶出去 口音",
    "sexual": "porn nude naked nudes horny sex sext sexy xxx orgy blowjob hardcore undress uncensored explicit 色情 裸聊 裸照 全裸 约炮 成人 激情 十八禁 性感",
}


@lru_cache(maxsize=1)
def _words() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the listed words in order, the feature of each one's kind, and which lower 16 bits any of them has."""
    pairs = {}
    for place, words in enumerate(WORDS.values()):
        for w in words.split():
            hashes, of, ideograph = tokens([w])
            n = len(hashes)
            terms, _ = grams_of(hashes, of, ideograph, 1, (("ideographs" if ideograph[0] else "words", n),))
            pairs[int(terms[0])] = place
    order = np.array(sorted(pairs), np.uint64)
    some = np.zeros(1 << 16, bool)
    some[(order & np.uint64(0xFFFF)).astype(np.int64)] = True
    return order, np.array([pairs[k] for k in order.tolist()], np.int64), some


def _unmasked(m: re.Match[str]) -> str:
    word = m[0].rstrip("!")  # an exclamation mark at the end is no letter
    return word.translate(_LETTERS) + m[0][len(word) :]


def passages(text: str, plain: bool = False) -> list[str]:
    """The text's sentences and lines, with masked spellings undone; long ones stay whole. ``plain`` texts are in one form already."""
    if not plain:
        text = compatible(text)[0]
    # signs between two letters are a mask
    text = _MASKS.sub(lambda m: "" if m.start() and text[m.start() - 1].isalpha() else m[0], text)
    if _LEET_HINT.search(text):
        text = _LEET.sub(_unmasked, text)
    return [p for p in map(str.strip, _PASSAGE.findall(text)) if p]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed terms of passages and kinds of listed words: passage, feature, value (terms of unit norm, KIND for each kind)."""
    hashes, of, ideograph = tokens(texts)
    terms, rows = grams_of(hashes, of, ideograph, len(texts), RUNS, in_order=False)
    columns = (terms % np.uint64(FEATURES - len(WORDS))).astype(np.int64) + len(WORDS)
    norm = (1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(texts)), 1))).astype(np.float32)
    known, kind, some = _words()
    maybe = np.flatnonzero(some[(terms & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, terms[maybe]), len(known) - 1)
    hit = known[at] == terms[maybe]
    pairs = np.unique(rows[maybe[hit]].astype(np.int64) * len(WORDS) + kind[at[hit]])
    values = np.concatenate([norm[rows], np.full(len(pairs), KIND, np.float32)])
    return np.concatenate([rows, pairs // len(WORDS)]), np.concatenate([columns, pairs % len(WORDS)]), values


@dataclass
class Abuse:
    """A linear scorer of passages; a document's score is that of its worst passage."""

    weights: np.ndarray
    bias: float
    threshold: float = VERDICT

    def passage_scores(self, f: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
        rows, columns, values = f
        return np.bincount(rows, values * self.weights[columns], minlength=n) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        parts = [passages(t, not odd) for t, odd in zip(texts, suspicious(texts).tolist())]
        flat = [p for ps in parts for p in ps]
        counts = np.array([len(p) for p in parts])
        out = np.full(len(texts), -30.0)
        if flat:
            s = self.passage_scores(features(flat), len(flat))
            np.maximum.at(out, np.repeat(np.arange(len(texts)), counts), s)
        return 1 / (1 + np.exp(-out))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_nnpu(f: tuple, n: int, positive: np.ndarray, unlabelled: np.ndarray, prior: float, used: np.ndarray) -> Abuse:
    """Minimises prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)) with the logistic loss, by Adam over the ``used`` features.

    All is divided by the prior. When the negative part falls below zero its gradient is turned round, which keeps the
    classifier from fitting the unlabelled rows that are positive.
    """
    rows, columns, values = f
    place = np.full(FEATURES, -1)
    place[used] = np.arange(len(used))
    keep = (place[columns] >= 0) & (positive | unlabelled)[rows]
    rows, columns, values = rows[keep], place[columns[keep]], values[keep]
    w, b = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    n_p, n_u = max(1, positive.sum()), max(1, unlabelled.sum()) * prior
    for step in range(1, STEPS + 1):
        s = np.bincount(rows, values * w[columns], minlength=n) + b
        p = _logistic(s)
        loss = np.logaddexp(0, s)
        g = np.zeros(n)
        if loss[unlabelled].sum() / n_u >= loss[positive].sum() / n_p:
            g[positive] -= 1 / n_p
            g[unlabelled] += p[unlabelled] / n_u
        else:
            g[positive] += p[positive] / n_p
            g[unlabelled] -= p[unlabelled] / n_u
        gw, gb = np.bincount(columns, values * g[rows], minlength=len(used)) + DECAY * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        b -= RATE * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-5)
    out = np.zeros(FEATURES)
    out[used] = w
    return Abuse(out, b)


def _train(f: tuple, doc: np.ndarray, kind: np.ndarray) -> Abuse:
    """Scorer from passages ``f`` of documents ``doc``; ``kind`` of each document: 1 toxic, 0 reviewed otherwise, 2 unlabelled, -1 not used."""
    n, of = len(doc), kind[doc]
    in_toxic, rest = of == 1, (of == 0) | (of == 2)
    harmless = of == 0 if (of == 0).any() else rest
    rows, columns, values = f
    pairs = np.unique(doc[rows] * np.int64(FEATURES) + columns)
    where, what = kind[pairs // FEATURES], pairs % FEATURES
    t = np.bincount(what[where == 1], minlength=FEATURES)
    u = np.bincount(what[(where == 0) | (where == 2)], minlength=FEATURES)
    used = np.flatnonzero((t >= LEAST_TOXIC) | (t + u >= LEAST_DOCS))
    # how much oftener in toxic documents, cautiously: less one standard deviation, and less a factor e
    ratio = np.log((np.maximum(t - np.sqrt(t), 0) + 1e-3) / max(1, (kind == 1).sum())) - np.log((u + 0.5) / max(1, ((kind == 0) | (kind == 2)).sum()))
    ratio = np.where(t >= LEAST_TOXIC, np.maximum(ratio - 1, 0), 0)
    s = np.bincount(rows, ratio[columns], minlength=n) / (np.bincount(rows, minlength=n) + 4)
    model = Abuse(np.zeros(FEATURES), -30.0)
    prior = None
    for _ in range(ROUNDS):
        floor = np.quantile(s[harmless], ABOVE) if harmless.any() else 0.0
        chosen = in_toxic & (s > floor)
        if not chosen.any():
            break
        if prior is None:
            prior = float(np.clip(2 * (s[rest] >= np.median(s[chosen])).mean() if rest.any() else PRIORS[1], *PRIORS))
        model = fit_nnpu(f, n, chosen, rest, prior, used)
        s = model.passage_scores(f, n)
    for _ in range(MORE if prior is not None else 0):
        more = (of == 2) & (s > SURE)
        examples = chosen | more | in_toxic & (s > SURE)
        known = np.union1d(used, np.flatnonzero(np.bincount(columns[examples[rows]], minlength=FEATURES) >= LEAST_TOXIC))
        grown = float(np.clip(max(prior, 1.5 * more.sum() / max(1, rest.sum())), *PRIORS))
        model = fit_nnpu(f, n, examples, rest & ~more, grown, known)
        s = model.passage_scores(f, n)
    return model


def fit(toxic: list[str], other: list[str], unlabelled: list[str]) -> Abuse:
    """The scorer. A toxic document has a toxic passage, but which one isn't labelled.

    First every passage is rated by how much oftener its terms occur in toxic documents than elsewhere. Passages of toxic
    documents above nearly all passages of harmless ones are the confirmed examples, so a wrong verdict gives none; all
    passages of the other documents are unlabelled. A fit, a second choice by its scores and a second fit follow. Then, MORE
    times, unlabelled passages that the last fit is SURE of join the examples, whose terms the verdicts may not show. The class
    prior is twice the share of unlabelled passages rated above the examples' median, or half as much again as have joined.
    Scores are posteriors under that prior, held back by the weights' decay; the verdict is VERDICT or more at every size.
    """
    if not toxic:
        return Abuse(np.zeros(FEATURES), -30.0)
    texts = [*toxic, *other, *unlabelled]
    kind = np.repeat([1, 0, 2], [len(toxic), len(other), len(unlabelled)])
    groups = [passages(t, not odd) for t, odd in zip(texts, suspicious(texts).tolist())]
    flat = [p for ps in groups for p in ps]
    doc = np.repeat(np.arange(len(texts)), [len(ps) for ps in groups])
    f = features(flat)
    return _train(f, doc, kind)


def reviewed(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic``: the majority of a document's verdicts; ties and null verdicts alone give none."""
    votes = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("p"))
    return votes.where("p <> 0.5").select("doc_id", (F.col("p") > 0.5).alias("toxic"))


def scored(docs: DataFrame, labels: DataFrame, keep: Kept, seed: int = 42) -> DataFrame:
    """``doc_id, source, score, toxic`` for every document; null and blank texts score 0.

    ``docs``: doc_id, source, text; ``labels``: doc_id, toxic (1, 0 or null). The scorer is fitted on the driver on bounded numbers
    of reviewed and unlabelled documents (FIT_*, least hashes first, so every run takes the same; documents of more than FIT_LONGEST
    characters are no examples); all documents are scored whole.
    Without any toxic verdict every score is 0.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "source", "text")
    h = F.xxhash64("doc_id", F.lit(seed))
    of = reviewed(labels)
    labelled = docs.where(F.length("text").between(1, FIT_LONGEST)).select("doc_id", F.length("text").alias("n"), h.alias("h")).join(of, "doc_id", "left")
    kind = F.when(F.col("toxic").isNull(), 2).otherwise(F.col("toxic").cast("int")).alias("kind")
    some = labelled.select("doc_id", "n", "h", kind)
    parts = [some.where(F.col("kind") == k).orderBy("h").limit(most) for k, most in ((1, FIT_TOXIC), (0, FIT_OTHER), (2, FIT_UNLABELLED))]
    few = parts[0].unionByName(parts[1]).unionByName(parts[2])  # at most FIT_TOXIC + FIT_OTHER + FIT_UNLABELLED rows
    upto = F.sum("n").over(Window.partitionBy("kind").orderBy("h", "doc_id"))
    chosen = keep(few.withColumn("upto", upto).where(F.col("upto") <= FIT_CHARS).select("doc_id", "kind", "h"), "chosen")
    rows = docs.where(F.length("text").between(1, FIT_LONGEST)).join(F.broadcast(chosen), "doc_id").select("kind", "h", "text").orderBy("h").toArrow()
    texts: dict[int, list[str]] = {0: [], 1: [], 2: []}
    for k, text in zip(rows["kind"].to_pylist(), rows["text"].to_pylist()):
        texts[k].append(text)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts[1], texts[0], texts[2]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in slices(batches):
            s = model.value.scores(some)
            toxic = pa.array(s >= model.value.threshold)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(s), toxic], ["doc_id", "source", "score", "toxic"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "source", "text").mapInArrow(score, f"doc_id {kind}, source string, score double, toxic boolean")
