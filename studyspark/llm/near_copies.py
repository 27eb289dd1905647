"""Groups of texts that go back to one text (problem 5): signature-coordinate inverted join, then an exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Kept, ship
from .batches import slices
from .components import components
from .contents import distinct_contents, needed
from .corpus import FEW, RARE, Frequent
from .terms import distinct, grams, grams_of, keyed, mixed, tokens
from .wording import collapsed

#: Terms: single words and three ideographs in a row.
RUNS = (("words", 1), ("ideographs", 3))
#: Coordinates of a signature, how many of them are posted together, how many such postings two texts must share to be compared,
#: how sharply a coordinate prefers rare terms, and how much less idf than a text's rarest term a term may have to be drawn.
COORDINATES, JOINED, MATCHES, SHARP, REACH = 48, 2, 2, 2.0, 3.5
#: Least cosine of two copies' vectors, whose weights are idf to this power.
COSINE, POWER = 0.44, 2.0


Runs = tuple[tuple[str, int], ...]


def vectors(texts: list[str], frequent: Frequent, runs: Runs = RUNS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, their texts and their idf."""
    terms, docs = distinct(*grams(texts, runs))
    return terms, docs, frequent.idf(terms)


def signatures(terms: np.ndarray, docs: np.ndarray, idf: np.ndarray, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with terms, and for each its coordinates: the term of least exponential key, of rate e^(SHARP idf).

    Two texts share a coordinate with the probability of their weighted Jaccard similarity; as a term's weight is a power of the
    inverse of its share of texts, phrases that many texts have are hardly ever drawn.
    """
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
    if len(first):
        drawable = idf >= np.repeat(np.maximum.reduceat(idf, first), np.diff(np.append(first, len(docs)))) - REACH
        terms, docs, idf = terms[drawable], docs[drawable], idf[drawable]
        first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    out = np.zeros((len(first), coordinates), np.uint64)
    rate = np.exp(-SHARP * idf).astype(np.float32)
    lengths = np.diff(np.append(first, len(docs)))
    for c in range(coordinates):
        if c % 2 == 0:  # two draws of 24 bits from one mixing
            drawn = mixed(terms ^ mixed(np.full(1, c // 2 + 1, np.uint64)))
        draw = drawn >> np.uint64(40) if c % 2 == 0 else drawn >> np.uint64(8) & np.uint64(0xFFFFFF)
        keys = -np.log((draw.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)) * rate
        least = np.minimum.reduceat(keys, first) if len(first) else keys
        at = np.flatnonzero(keys == np.repeat(least, lengths))
        if len(at) > len(first):  # ties: the first one
            at = at[np.append(True, docs[at][1:] != docs[at][:-1])]
        out[:, c] = mixed(terms[at] + np.uint64(c))
    return docs[first], out


def joint(values: np.ndarray, joined: int) -> np.ndarray:
    """Values of ``joined`` consecutive coordinates as one."""
    n = values.shape[1] // joined
    out = values[:, 0 : n * joined : joined].copy()
    for j in range(1, joined):
        out = mixed(out * np.uint64(31) + values[:, j : n * joined : joined])
    return out


def cosine(a: str, b: str, frequent: Frequent) -> float:
    """Cosine of the two texts' vectors."""
    terms, docs, idf = vectors([a, b], frequent)
    return float(_cosines(terms, docs, idf.astype(np.float64) ** POWER + 1e-6, 1)[0])


def _cosines(terms: np.ndarray, docs: np.ndarray, weights: np.ndarray, pairs: int) -> np.ndarray:
    """Of texts 2i and 2i+1 for each i."""
    norms = np.sqrt(np.bincount(docs, weights**2, minlength=2 * pairs))
    pair = docs // 2
    order = np.argsort(keyed(terms, pair)) if pairs <= 1 << 16 else np.lexsort((terms, pair))
    p, t, w = pair[order], terms[order], weights[order]
    same = np.flatnonzero((p[1:] == p[:-1]) & (t[1:] == t[:-1]))
    dots = np.bincount(p[same], w[same] * w[same + 1], minlength=pairs)
    return dots / np.maximum(norms[0::2] * norms[1::2], 1e-9)


def similar(pairs: DataFrame, frequent: Broadcast, columns: str, cosine_least: float, runs: Runs = RUNS, power: float = POWER) -> DataFrame:
    """Rows of ``pairs`` (columns ``left`` and ``right`` hold the texts) whose texts have the cosine, without the texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lefts in slices(batches, "left"):
            rights = part.column("right").to_pylist()
            terms, docs, idf = vectors([t for two in zip(lefts, rights) for t in two], frequent.value, runs)
            found = _cosines(terms, docs, idf.astype(np.float64) ** power + 1e-6, len(lefts))
            keep = pa.array(found >= cosine_least)
            rest = part.select([c for c in part.schema.names if c not in ("left", "right")])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found)], [*rest.schema.names, "cosine"]).filter(keep)

    return pairs.mapInArrow(check, f"{columns}, cosine double")


def postings(texts: DataFrame, frequent: Broadcast, coordinates: int, joined: int) -> DataFrame:
    """``value, content``: a posting of every content under each joint value of its coordinates."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in slices(batches):
            hashes, of, ideograph = tokens(some)
            terms, where = distinct(*grams_of(hashes, of, ideograph, len(some), RUNS))
            which, values = signatures(terms, where, frequent.value.idf(terms), coordinates)
            values = joint(values, joined)
            own = part.column("content").to_numpy()[which].repeat(values.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(values.ravel().view(np.int64)), pa.array(own)], ["value", "content"])

    return texts.select("content", "text").mapInArrow(posted, "value long, content long")


def with_texts(pairs: DataFrame, texts: DataFrame, keep: Kept) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with ``left`` and ``right``, the texts (``content, text``) of ``a`` and ``b``; and the kept table of these texts.

    ``pairs`` must be a kept table.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("content"))
    some = keep(needed(texts, ids), "needed")
    one, two = some.select(F.col("content").alias("a"), F.col("text").alias("left")), some.select(F.col("content").alias("b"), F.col("text").alias("right"))
    return pairs.join(one, "a").join(two, "b"), some


def near_copies(docs: DataFrame, keep: Kept, coordinates: int = COORDINATES, joined: int = JOINED, matches: int = MATCHES, cosine_least: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """Groups of texts that go back to one text.

    ``docs``: ``doc`` bigint, ``text`` string. Redelivered rows may be there; null texts and texts without letters or digits are
    in no group. Gives ``members`` (doc, content, group: every doc that has a partner; group is the least doc of it,
    content the least doc of the same content) and ``links`` (a, b, cosine between two different contents; without a cosine where b has
    a's common wording).

    1. Equal contents (apart from case, spacing, punctuation, form of characters) meet under two hashes and count as one; terms'
       frequencies, postings and pairs are those of contents, so the result doesn't depend on how files are cut.
    2. Contents of equal common wording (``wording``) are linked to the first of them. Terms are counted over firsts alone, so that very
       many versions of one text don't make its words common, and later ones are not paired with each other inside a group.
    3. Each content gets a signature of weighted min-hash coordinates and is posted under the joint values of each ``joined``
       consecutive ones. Equal values meet in an equi-join of two exchanges that Spark itself plans, so it splits the partition of
       a long list among tasks; a list is never gathered in one row. Collisions are counted, and contents that share ``matches``
       postings are candidates.
    4. Candidates whose whole texts have a weighted cosine of ``cosine_least`` are links; groups are the links' components.
    5. Later contents are posted too: they are compared with firsts, and with each other, wherever that can join two of these groups.
       Links of later contents inside one group are not listed, but for that with their first.
    """
    ship(docs.sparkSession)
    docs = docs.where(F.col("text").isNotNull() & F.col("doc").isNotNull()).select("doc", "text")
    rows, contents, texts = distinct_contents(docs, keep)
    firsts, later, _, frequent = collapsed(texts, RUNS, keep, RARE, FEW)
    # new names, so that both sides of the self-join differ in these alone and share one exchange
    lists = postings(firsts, frequent, coordinates, joined).select(F.col("value").alias("at"), F.col("content").alias("a"))
    late = keep(postings(texts.join(later.select("content"), "content", "left_semi"), frequent, coordinates, joined), "late")
    others = lists.select("at", F.col("a").alias("b"))
    pairs = lists.join(others, "at").where(F.col("a") < F.col("b")).select("a", "b", F.lit(False).alias("late"))
    mixed_pairs = lists.select("at", F.col("a").alias("b")).hint("merge").join(late.select(F.col("value").alias("at"), F.col("content").alias("a")), "at")
    mixed_pairs = mixed_pairs.where(F.col("a") != F.col("b"))  # always so, but asks the same of the lists as above: all joins share one exchange
    met = pairs.unionByName(mixed_pairs.select("a", "b", F.lit(True).alias("late"))).groupBy("a", "b", "late").agg(F.count("*").alias("n"))
    found = keep(met.where(F.col("n") >= matches).select("a", "b", "late"), "candidates")

    def checked(pairs: DataFrame) -> DataFrame:
        both, some = with_texts(pairs, texts, keep)
        out = keep(similar(both.select("a", "b", "left", "right"), frequent, "a long, b long", cosine_least), "checked")
        keep.free(some)
        return out

    first = checked(found.where("not late").select("a", "b"))
    equal = later.select(F.col("first").alias("a"), F.col("content").alias("b"), F.lit(None).cast("double").alias("cosine"))
    links = keep(first.unionByName(equal), "links")
    groups = components(links, keep)
    across = keep(_across(found.where("late").select("a", "b"), late, groups, matches), "across")
    keep.free(first, found, late)
    if not across.isEmpty():
        more = checked(across)
        every = keep(links.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")), "links")
        keep.free(links, groups, more)
        links = every
        groups = components(links, keep)
    keep.free(across, texts, later)
    linked = contents.join(groups, contents.content == groups.node, "left").where(F.col("label").isNotNull() | F.col("several"))
    linked = linked.select("one", "two", "content", F.coalesce("label", "content").alias("group"))
    members = keep(rows.join(linked, ["one", "two"]).select("doc", "content", "group").dropDuplicates(["doc"]), "members")
    keep.free(rows, contents, groups)
    return members, links


def _across(mixed_pairs: DataFrame, late: DataFrame, groups: DataFrame, matches: int) -> DataFrame:
    """``a, b``: candidates with a later content on one side (``mixed_pairs``) or on both whose groups differ; later ones are in ``a``.

    ``late``: postings of later contents. The groups meet in their lists before their members do, so a group's own versions don't.
    """
    of = groups.select(F.col("node").alias("content"), F.col("label").alias("group"))
    far = mixed_pairs.join(of.select(F.col("content").alias("a"), F.col("group").alias("ga")), "a")
    far = far.join(of.select(F.col("content").alias("b"), F.col("group").alias("gb")), "b", "left")
    far = far.where(F.col("ga") != F.coalesce("gb", "b")).select("a", "b")
    known = late.join(of, "content")
    one, two = (known.select("value", F.col("group").alias(g), F.col("content").alias(c)) for g, c in (("ga", "a"), ("gb", "b")))
    met = one.select("value", "ga").distinct().join(two.select("value", "gb").distinct(), "value").where(F.col("ga") < F.col("gb"))
    both = met.join(one, ["value", "ga"]).join(two, ["value", "gb"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    return far.unionByName(both.where(F.col("n") >= matches).select("a", "b"))


def pairs_of(members: DataFrame) -> DataFrame:
    """All pairs inside each group, by an equi-join on the group."""
    one, two = members.select("group", F.col("doc").alias("a")), members.select("group", F.col("doc").alias("b"))
    return one.join(two, "group").where(F.col("a") < F.col("b")).select("a", "b")
