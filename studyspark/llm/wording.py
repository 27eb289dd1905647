"""Texts of equal common wording: versions of one text that differ by rare terms alone count once where terms are counted and posted.

Where very many different versions of one text lie in a corpus, its own words are common and each version's slips are rare, so that idf
weights make the slips outweigh what the versions share. Such texts are told by their common wording, without looking at pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Kept
from .batches import slices
from .corpus import common_counts, shared_counts, term_counts
from .terms import distinct, grams_of, mixed, tokens

#: Share of texts from which a term is common wording; share of a text's terms that must be common, and the least number of them.
#: Two texts of equal common wording so have at least that share of their terms in common.
COMMON, DOMINATED, LEAST = 1 / 200, 0.75, 5


def wordings(texts: DataFrame, frequent: Broadcast, runs: tuple[tuple[str, int], ...], others: str = "") -> DataFrame:
    """``content, one, two, others``: two hashes of the set of common terms, for texts that mostly consist of these."""
    names = [x.split()[0] for x in others.split(",") if x]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in slices(batches):
            n = len(some)
            hashes, of, ideograph = tokens(some)
            terms, docs = distinct(*grams_of(hashes, of, ideograph, n, runs))
            common = frequent.value.common(terms, COMMON)
            every, here = np.bincount(docs, minlength=n), np.bincount(docs[common], minlength=n)
            terms, docs = terms[common], docs[common]
            first = np.searchsorted(docs, np.arange(n + 1))
            columns = []
            for salt in (11, 13):
                sums = np.append(np.uint64(0), np.cumsum(mixed(terms + np.uint64(salt))))
                columns.append(pa.array(mixed(sums[first[1:]] - sums[first[:-1]]).view(np.int64)))
            rows = [part.column("content"), *columns, *(part.column(c) for c in names)]
            yield pa.RecordBatch.from_arrays(rows, ["content", "one", "two", *names]).filter(pa.array((here >= LEAST) & (here >= DOMINATED * every)))

    return texts.select("content", "text", *names).mapInArrow(work, "content long, one long, two long" + (", " + others if others else ""))


def collapsed(
    texts: DataFrame, runs: tuple[tuple[str, int], ...], keep: Kept, rare: int, few: int, others: str = ""
) -> tuple[DataFrame, DataFrame, DataFrame, Broadcast]:
    """``texts`` (kept; content, text, others) without those that have an earlier one's common wording, and what is known of these.

    Gives ``firsts`` (like ``texts``), ``later`` (content, first: a content left out and the least one of equal common wording and
    equal others), ``classes`` (first, one, two, others of every common wording) and the terms' frequencies over ``firsts``. Only
    hashes are grouped, added up per task, so a wording that a third of all texts have is one row a task; what is left out is left out
    by an anti-join. Frequencies are those of
    all texts less those of the texts left out; these alone are read again.
    """
    names = [x.split()[0] for x in others.split(",") if x]
    counts, n = common_counts(texts, runs, keep, rare, few)
    found = keep(wordings(texts, shared_counts(counts, n, rare, few), runs, others).withColumn("of", F.xxhash64("one", *names)), "wordings")
    whose = [F.first(c).alias(c) for c in ("one", *names)]
    classes = keep(found.groupBy("of", "two").agg(F.min("content").alias("first"), (F.max("content") > F.min("content")).alias("several"), *whose), "classes")
    later = found.select("content", "of", "two").join(classes.where("several").select("of", "two", "first"), ["of", "two"])
    later = keep(later.where("content <> first").select("content", "first"), "later")
    keep.free(found)
    firsts = texts.join(later.select("content"), "content", "left_anti")
    less = term_counts(texts.join(later.select("content"), "content", "left_semi"), runs).select("term", F.col("n").alias("less"))
    left = keep(counts.join(less, "term", "left").select("term", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")), "frequent")
    frequent = shared_counts(left, n - later.count(), rare, few)
    keep.free(counts, left)
    return firsts, later, classes.select("first", "one", "two", *names), frequent
