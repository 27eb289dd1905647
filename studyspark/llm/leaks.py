"""Held-out passages inside a corpus (problem 6): hashes of spaced seeds of items and documents meet in a join, overlaps around hits are verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Kept, ship
from .batches import slices
from .components import components
from .contents import bit_map, distinct_contents, in_map
from .terms import distinct, grams, mixed, tokens

#: Token positions that a seed looks at (1) or ignores (0): for runs of words and for runs with ideographs.
WORD_SEEDS = ("1111", "11011", "10111", "11101")
IDEOGRAPH_SEEDS = ("11111111", "1111011011", "1101101111", "1110110111")
#: A word, three ideographs or seed that more than so many families of items (or this share of them) hold is stock or mere phrasing.
STOCK_ITEMS, STOCK_SHARE = 2, 0.01
#: Equal tokens so many places before or after a seed's hit still count as part of the overlap.
GAP = 2
#: Share of an item's own wording that a document must hold, and the least number of its own tokens (all of them if it has fewer).
SHARE, LEAST_TOKENS = 0.34, 4
#: Items whose pairs of words and triples of ideographs agree to this Jaccard similarity are versions of one item, a family.
VERSION, VERSION_RUNS = 0.5, (("words", 2), ("ideographs", 3))
#: Tokens in a hit's window; bits for each seed, of which it sets two, in the map that documents are searched by, and bounds of its size.
_WIDE, _BITS_A_SEED, _LEAST_BITS, _MOST_BITS = max(map(len, IDEOGRAPH_SEEDS)) + 2 * GAP, 64, 20, 29


def seed_hashes(hashes: np.ndarray, of: np.ndarray, ideograph: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all seeds in turn: the hash of the tokens it looks at, the position it starts at, and its span.

    Word seeds start at runs without ideographs, ideograph seeds at runs with at least one.
    """
    out = []
    before = np.append(0, np.cumsum(ideograph))
    for number, seed in enumerate((*WORD_SEEDS, *IDEOGRAPH_SEEDS)):
        span = len(seed)
        n = len(hashes) - span + 1
        if n <= 0:
            continue
        some = before[span : n + span] > before[:n]
        at = np.flatnonzero((of[:n] == of[span - 1 :]) & (some if number >= len(WORD_SEEDS) else ~some))
        x = np.full(len(at), number + 1, np.uint64)
        for j, used in enumerate(seed):
            if used == "1":
                x = mixed(x * np.uint64(31) + hashes[at + j])
        out.append((x, at, np.full(len(at), span)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def windows(hashes: np.ndarray, of: np.ndarray, at: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each hit the tokens from GAP before it to GAP after it; 0 beyond these or the text."""
    where = at[:, None] + np.arange(-GAP, _WIDE - GAP)
    inside = (where >= 0) & (where < len(hashes)) & (np.arange(_WIDE) < (spans + 2 * GAP)[:, None])
    where = np.where(inside, where, 0)
    return np.where(inside & (of[where] == of[at][:, None]), hashes[where], 0) if len(at) else np.zeros((0, _WIDE), np.uint64)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1]))
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel().view(np.int64)))


def families(texts: DataFrame, keep: Kept) -> DataFrame:
    """``content, family``: contents (content, text) that are versions of one text, by the least content of each such group.

    Every content is compared with the least content of each list of contents that share a term, so versions meet where the wording
    is their own, and neither a stock phrase nor a text with very many versions makes more than one comparison a posting.
    """

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in slices(batches):
            terms, docs = distinct(*grams(some, VERSION_RUNS))
            offsets = np.searchsorted(docs, np.arange(len(some) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("content"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(terms.view(np.int64)))], ["content", "terms"])

    sets = keep(texts.select("content", "text").mapInArrow(terms_of, "content long, terms array<long>"), "terms")
    lists = sets.select("content", F.explode("terms").alias("term"))
    leaders = lists.groupBy("term").agg(F.min("content").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = lists.join(leaders, "term").where("content <> least").select("content", "least").distinct()
    both = pairs.join(sets, "content").join(sets.select(F.col("content").alias("least"), F.col("terms").alias("others")), "least")
    same = F.size(F.array_intersect("terms", "others"))
    alike = same >= VERSION * (F.size("terms") + F.size("others") - same)
    labels = components(both.where(alike).select(F.col("content").alias("a"), F.col("least").alias("b")), keep)
    return sets.select("content").join(labels.select(F.col("node").alias("content"), "label"), "content", "left").select(
        "content", F.coalesce("label", "content").alias("family")
    )


def item_seeds(texts: DataFrame, keep: Kept) -> tuple[DataFrame, DataFrame]:
    """``seeds`` (seed, content, place, own: the window's tokens that are the content's own wording, else 0) and ``sizes`` (content, own_size).

    Words and triples of ideographs that only few families hold are own wording; seeds that more hold are stock and left out.
    """
    known = keep(texts.join(families(texts, keep), "content").select("content", "family", "text"), "families")
    most = F.greatest(F.lit(STOCK_ITEMS), F.floor(F.lit(STOCK_SHARE) * F.lit(known.agg(F.count_distinct("family")).first()[0])))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in slices(batches):
            hashes, of, ideograph = tokens(some)
            n = max(0, len(hashes) - 2)
            three = np.flatnonzero((of[:n] == of[2:]) & ideograph[:n] & ideograph[1 : n + 1] & ideograph[2:]) if n else np.zeros(0, np.int64)
            triples = mixed(mixed(hashes[three] * np.uint64(31) + hashes[three + 1]) * np.uint64(31) + hashes[three + 2]) if n else hashes[:0]
            words = np.flatnonzero(~ideograph)
            seeds, at, spans = seed_hashes(hashes, of, ideograph)
            unit = np.concatenate([mixed(hashes[words] + np.uint64(1)), mixed(triples + np.uint64(3)), seeds])
            place = np.concatenate([words, three, at])
            length = np.concatenate([np.full(len(words), 1), np.full(len(three), 3), np.zeros(len(seeds), np.int64)])
            rows = np.zeros((len(unit), _WIDE), np.uint64)
            rows[len(words) + len(three) :] = windows(hashes, of, at, spans)
            first = np.searchsorted(of, np.arange(len(some)))
            of_text = pa.array(of[place], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(unit.view(np.int64)), part.column("content").take(of_text), part.column("family").take(of_text),
                 pa.array((place - first[of[place]]).astype(np.int32)), pa.array(length.astype(np.int32)), _lists(rows)],
                ["unit", "content", "family", "place", "length", "window"],
            )

    every = keep(known.mapInArrow(units, "unit long, content long, family long, place int, length int, window array<long>"), "units")
    few = every.select("unit", "family").distinct().groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("unit")
    good = keep(every.join(few, "unit"), "own")
    own = good.where("length > 0").select("content", F.explode(F.sequence("place", F.col("place") + F.col("length") - 1)).alias("place"))
    of = keep(own.groupBy("content").agg(F.collect_set("place").alias("places")), "places")
    marked = good.where("length = 0").join(of, "content").select(
        F.col("unit").alias("seed"), "content", "place",
        F.transform("window", lambda x, j: F.when(F.array_contains("places", F.col("place") - GAP + j), x).otherwise(0)).alias("own"),
    )
    seeds = keep(marked, "seeds")
    keep.free(every, good, known)
    return seeds, of.select("content", F.size("places").alias("own_size"))


def hits(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seed, doc_id, window``: places of documents whose seed the items' map has; all documents are read once, whatever the number of items."""
    n = seeds.count()
    bits = min(_MOST_BITS, max(_LEAST_BITS, math.ceil(math.log2(_BITS_A_SEED * max(n, 1)))))
    low = np.uint64((1 << bits) - 1)
    two = [F.col("seed").bitwiseAND(F.lit(int(low))), F.shiftright("seed", 32).bitwiseAND(F.lit(int(low)))]
    known = docs.sparkSession.sparkContext.broadcast(bit_map(seeds.select(F.explode(F.array(*two)).alias("place")), F.col("place"), bits))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            hashes, of, ideograph = tokens(texts)
            found, at, spans = seed_hashes(hashes, of, ideograph)
            for shift in (0, 32):  # both of a seed's bits must be set
                maybe = in_map(known.value, (found >> np.uint64(shift) & low).astype(np.int64))
                found, at, spans = found[maybe], at[maybe], spans[maybe]
            ids = part.column("doc_id").take(pa.array(of[at], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), ids, _lists(windows(hashes, of, at, spans))], ["seed", "doc_id", "window"])

    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(search, "seed long, doc_id long, window array<long>")


def leaked(docs: DataFrame, heldout: DataFrame, keep: Kept, share: float = SHARE, least: int = LEAST_TOKENS) -> DataFrame:
    """``doc_id, item_id, share, tokens``: every document with at least ``share`` of an item's own wording.

    ``docs``: ``doc_id`` bigint, ``text``; ``heldout``: ``item_id`` bigint, ``text``. An id given twice counts once, with its least
    text; items of equal content are searched for once and reported under each id. Null and blank texts leak nothing, and an item
    without any wording of its own can't leak. A null doc_id is no document.

    1. Items are grouped into families of versions; what more than a few families hold is stock. This counts all items at once.
    2. Documents are read once; seeds that a bit map of the items' seeds has are joined with these on the seed's hash.
    3. Around each hit the tokens of both texts are compared place by place, so that substituted tokens cost only themselves. Equal
       own tokens of an item, wherever in the document, add up to its share.
    """
    ship(docs.sparkSession)
    chosen = heldout.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy(F.col("item_id").alias("doc")).agg(F.min("text").alias("text"))
    rows, contents, texts = distinct_contents(chosen, keep)
    seeds, sizes = item_seeds(texts, keep)
    met = hits(docs.where(F.col("doc_id").isNotNull()), seeds).join(seeds, "seed")
    equal = F.filter(F.sequence(F.lit(0), F.lit(_WIDE - 1)), lambda j: (F.get("own", j) != 0) & (F.get("own", j) == F.get("window", j)))
    places = met.select("doc_id", "content", F.explode(F.transform(equal, lambda j: F.col("place") - GAP + j)).alias("place")).distinct()
    found = places.groupBy("doc_id", "content").agg(F.count("*").alias("tokens")).join(sizes, "content")
    found = found.withColumn("share", F.col("tokens") / F.col("own_size")).where((F.col("share") >= share) & (F.col("tokens") >= F.least(F.lit(least), "own_size")))
    items = rows.join(contents, ["one", "two"]).select("content", F.col("doc").alias("item_id"))
    return found.join(items, "content").select("doc_id", "item_id", "share", "tokens")
