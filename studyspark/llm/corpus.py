"""Document frequencies of terms over a whole corpus, as weights that a bounded broadcast can carry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Kept
from .batches import slices
from .terms import distinct, grams_of, tokens

#: A term is frequent if at least one text in so many has it; all others count as having this frequency.
RARE = 5_000
#: Most frequent terms that are broadcast (12 bytes each). Of P terms of all texts at most MOST are held by P / MOST texts or more, so
#: where texts are so long that RARE alone would let more through, terms count as frequent from P / MOST texts on.
MOST = 2_000_000
#: A term that at most so many texts have is no rarer than one that this many have: in a small corpus a slip of the pen must not
#: outweigh the names that two copies share.
FEW = 20


#: Counts know a term by the upper bits of its hash, and a text within its slice by the other bits.
_DOC_BITS, _TERM_BITS = np.uint64(16), 48


class Frequent:
    """The frequent terms' shares of texts, sorted by term; every other term counts as one in ``rare``.

    An idf is a whole number of steps of 1 / STEPS, so that all texts put their terms in one order by it.
    """

    STEPS = 4096

    def __init__(self, terms: np.ndarray, texts: np.ndarray, n: int, rare: float = RARE, few: int = FEW):
        order = np.argsort(terms)
        self.most = self._steps(np.log(max(2.0, n / max(few, n / rare))))
        self.terms = terms[order]
        self.logs = np.minimum(self._steps(np.log(max(n, 1) / np.maximum(texts[order], 1))), self.most).astype(np.uint16)
        # where the terms of each value of the upper bits begin, so that a look-up sees few of them
        bits = max(8, int(4 * len(terms)).bit_length())
        self._shift = np.uint64(_TERM_BITS - bits)
        starts = np.searchsorted(self.terms >> self._shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self._starts, self._longest = starts.astype(np.int32), int(np.diff(starts).max()) if len(terms) else 0

    def _steps(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(np.rint(np.maximum(x, 0) * self.STEPS), 65535).astype(np.uint16)

    def steps(self, terms: np.ndarray) -> np.ndarray:
        """ln(texts / texts with the term) in steps, where the latter are at least FEW and texts / RARE."""
        if not len(self.terms):
            return np.full(len(terms), self.most, np.uint16)
        terms = terms >> _DOC_BITS
        at = self._starts[(terms >> self._shift).astype(np.int64)]
        out = np.full(len(terms), self.most, np.uint16)
        last = len(self.terms) - 1
        for step in range(self._longest):
            here = np.minimum(at + np.int32(step), last)
            hit = np.flatnonzero(self.terms[here] == terms)
            out[hit] = self.logs[here[hit]]
        return out

    def common(self, terms: np.ndarray, share: float) -> np.ndarray:
        """Whether at least this share of texts is known to have each term."""
        steps = self.steps(terms)
        return (steps < self.most) & (steps <= self._steps(np.log(1 / share)))

    def idf(self, terms: np.ndarray) -> np.ndarray:
        """The same as a number."""
        return self.steps(terms).astype(np.float32) / np.float32(self.STEPS)


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.diff(np.append(first, len(every)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    terms, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(terms, kind="stable")
    terms, counts = terms[order], counts[order]
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
    return terms[first], np.add.reduceat(counts, first) if len(first) else counts


def term_counts(texts: DataFrame, runs: tuple[tuple[str, int], ...]) -> DataFrame:
    """``term, n``: how many rows of ``text`` have each term; each task adds its own counts up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed: list[tuple[np.ndarray, np.ndarray]] = []
        new: list[np.ndarray] = []
        waiting = 0
        for _, some in slices(batches):
            hashes, of, ideograph = tokens(some)
            new.append(distinct(*grams_of(hashes, of, ideograph, len(some), runs))[0] >> _DOC_BITS)
            waiting += len(new[-1])
            if waiting > 4_000_000:
                summed = [_merged([*summed, _counted(new)])]
                new, waiting = [], 0
                if len(summed[0][0]) > 16_000_000:
                    yield _batch(*summed.pop())
        yield _batch(*_merged([*summed, _counted(new)]))

    return texts.where(F.col("text").isNotNull()).select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def common_counts(texts: DataFrame, runs: tuple[tuple[str, int], ...], keep: Kept, rare: int = RARE, few: int = FEW) -> tuple[DataFrame, int]:
    """``term, n`` of the terms that more than FEW of ``texts`` (without nulls) and one in RARE have, as a kept table, and the number of texts."""
    n = texts.count()
    counts = term_counts(texts, runs)
    return keep(counts.where((F.col("n") * rare >= n) & (F.col("n") > few)), "frequent"), n


def shared_counts(counts: DataFrame, n: int, rare: int = RARE, few: int = FEW, most: int = MOST) -> Broadcast:
    """The counts (a kept table) of ``n`` texts as a broadcast ``Frequent`` of at most ``most`` terms."""
    least = -(-counts.agg(F.sum("n")).first()[0] // most) if counts.count() > most else 0
    rows = counts.where((F.col("n") >= least) & (F.col("n") * rare >= n) & (F.col("n") > few)).toArrow()
    found = Frequent(rows["term"].to_numpy().view(np.uint64), rows["n"].to_numpy(), n, min(rare, n / least) if least else rare, few)
    return counts.sparkSession.sparkContext.broadcast(found)


def frequent_terms(texts: DataFrame, runs: tuple[tuple[str, int], ...], keep: Kept, rare: int = RARE, few: int = FEW, most: int = MOST) -> Broadcast:
    """Counts every text of column ``text``.

    ``texts`` should hold each content once, so that a text which a third of all rows repeat doesn't make its own words common.
    """
    counts, n = common_counts(texts.where(F.col("text").isNotNull()), runs, keep, rare, few)
    found = shared_counts(counts, n, rare, few, most)
    keep.free(counts)
    return found


def _batch(terms: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], ["term", "n"])
