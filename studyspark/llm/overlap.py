"""Same and near-same records across splits (problem 1): weighted cosine join by pruned inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Kept, brief_shuffles, ship
from .batches import slices
from .contents import distinct_contents, needed
from .corpus import Frequent
from .near_copies import similar, with_texts
from .terms import distinct, grams_of, mixed, tokens
from .wording import collapsed

#: Terms: single words and four ideographs in a row; a term's weight is its idf to this power.
RUNS, POWER = (("words", 1), ("ideographs", 4)), 1.75
#: Least cosine of the vectors.
COSINE = 0.44
#: Parts of the vocabulary in which a content's norms are known, to bound the cosine of two contents before their texts are fetched.
PARTS = 128
#: Terms in fewer than one text of RARE, or in fewer than FEW, count as equally rare.
RARE, FEW = 20_000, 10
#: Weights and norms are posted as 16-bit parts of one number, rounded up, so that sums and products are never below the true ones;
#: sums of weights go up to SUMS.
_UNIT, SUMS = 65535, 64.0
#: Bands of idf, by how far below the greatest one they begin, and the bits that a sketch has for the terms of each; the rest is one norm.
BANDS, BITS = (0.5, 2.0, 4.0), (128, 64, 64)
#: A sketch's columns: the bands' bits, and greatest weights and the rest's norm (parts of _FINE) with counts of terms that share a bit.
SKETCH = ["rare_one", "rare_two", "middle", "low", "scale"]
_FINE, _CROWDED = 4095, 31
#: Contents whose postings meet in one round, up to so many rounds, and beyond these; each round reads the texts again.
ROUND, FEW_ROUNDS, LONG_ROUND = 1_000_000, 5, 8_000_000
#: Pairs whose parts, and pairs whose texts, meet in one round: so many, or a share of the number of contents.
PARTS_ROUND, TEXTS_ROUND = (2_000_000, 1.0), (500_000, 0.25)
#: Classes of terms by hash whose greatest residual norm on the held-out side is known (4 MB, whatever the number of terms).
_CLASSES = 1 << 21


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    return (np.arange(1 << 16) / Frequent.STEPS) ** POWER + 1e-6


def weighed(steps: np.ndarray) -> np.ndarray:
    """Weights of terms by their idf in steps."""
    return _weights()[steps]


def prefixes(terms: np.ndarray, docs: np.ndarray, steps: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """Of each text's unit vector the terms that must be posted: terms, texts, weights, norms from that term on, sums of weights after it.

    All texts order their terms alike (greatest weight first, then by hash), so of two texts the first common term stands in both
    prefixes unless the product of the norms from there on (residual norms), which bounds their dot product, is below ``least``.
    """
    down = np.uint64(65535) - steps
    if len(docs) and docs[-1] >= 1 << 16:
        order = np.lexsort((terms, down, docs))
    else:
        order = np.argsort(docs.astype(np.uint64) << np.uint64(48) | down << np.uint64(32) | terms >> np.uint64(32))
    t, d, w = terms[order], docs[order], weighed(steps[order])
    first = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(first, len(d)))

    def before(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.cumsum(x)
        return sums - x - np.repeat(sums[first] - x[first], lengths), np.repeat(np.add.reduceat(x, first) if len(first) else x, lengths)

    spent, total = before(w**2)
    norm = np.sqrt(np.maximum(1 - spent / total, 0))
    passed, every = before(w)
    unit = np.sqrt(total)
    keep = norm >= least
    return t[keep], d[keep], (w / unit)[keep], norm[keep], ((every - passed - w) / unit)[keep]


def packed(weights: np.ndarray, norms: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Weight, norm and sum after as one 48-bit number; each is rounded up, and a sum over SUMS counts as unknown."""
    up = [np.minimum(np.ceil(x * _UNIT + 0.01), _UNIT).astype(np.int64) for x in (weights, norms, np.maximum(after, 0) / SUMS)]
    return up[0] << 32 | up[1] << 16 | up[2]


def _parts(column: str) -> tuple[Column, Column, Column]:
    c = F.col(column)
    unit = F.lit(float(_UNIT))
    low = c.bitwiseAND(F.lit(_UNIT))
    total = F.when(low < _UNIT, low * (SUMS / _UNIT)).otherwise(F.lit(1e9))
    return F.shiftright(c, 32) / unit, F.shiftright(c, 16).bitwiseAND(F.lit(_UNIT)) / unit, total


def sketches(terms: np.ndarray, docs: np.ndarray, steps: np.ndarray, most: int, n: int) -> np.ndarray:
    """Of each of ``n`` texts a row of the five numbers of SKETCH, by which ``_sketched`` bounds the cosine of two texts.

    Terms of one band of idf weigh nearly the same in a text, so how many two texts can share there bounds what they gain by it: not
    more than the bits that both have, and the terms beyond one a bit that both have.
    """
    w = weighed(steps)
    unit = np.sqrt(np.bincount(docs, w**2, minlength=n))
    w = w / unit[docs]
    below = [most - x * Frequent.STEPS for x in BANDS]
    band = sum((steps < x).astype(np.int8) for x in below)
    marks, scale, start = np.zeros((n, sum(BITS)), bool), np.zeros(n, np.int64), 0
    for i, bits in enumerate(BITS):
        d, t, top = docs[band == i], terms[band == i], np.zeros(n)
        marks[d, start + ((t >> np.uint64(22)) % np.uint64(bits)).astype(np.int64)] = True
        crowd = np.bincount(d, minlength=n) - marks[:, start : start + bits].sum(axis=1)
        np.maximum.at(top, d, w[band == i])
        scale |= _fine(top) << 12 * i | np.minimum(crowd, _CROWDED) << 48 + 5 * i
        start += bits
    rest = band == len(BITS)
    scale |= _fine(np.sqrt(np.bincount(docs[rest], w[rest] ** 2, minlength=n))) << 36
    return np.column_stack([np.packbits(marks, axis=1, bitorder="little").view(np.int64), scale])


def _fine(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(x * _FINE + 0.01 * (x > 0)), _FINE).astype(np.int64)


def _sketched(a: list[str], b: list[str]) -> Column:
    """A bound of the cosine of two contents from the columns of their sketches; never below the cosine."""

    def part(column: str, shift: int, most: int) -> Column:
        return F.shiftright(column, shift).bitwiseAND(F.lit(most))

    bound, at = part(a[-1], 36, _FINE) * part(b[-1], 36, _FINE), 0
    for i, bits in enumerate(BITS):
        shared = sum((F.bit_count(F.col(a[j]).bitwiseAND(F.col(b[j]))) for j in range(at + 1, at + bits // 64)), F.bit_count(F.col(a[at]).bitwiseAND(F.col(b[at]))))
        crowd = F.least(part(a[-1], 48 + 5 * i, _CROWDED), part(b[-1], 48 + 5 * i, _CROWDED))
        crowd = F.when(crowd < _CROWDED, crowd).otherwise(1 << 20)
        bound = bound + (shared + crowd) * part(a[-1], 12 * i, _FINE) * part(b[-1], 12 * i, _FINE)
        at += bits // 64
    return bound / float(_FINE * _FINE)


def postings(
    texts: DataFrame, frequent: Broadcast, least: float, most: Broadcast | None = None, sketch: bool = False, turn: tuple[int, int] = (0, 1)
) -> DataFrame:
    """``term, content, packed`` of each content, with the columns of SKETCH if wanted; tables never share a term.

    ``turn``: i, n: only the terms of the i-th of n rounds (``_in_turn``).

    ``most``: the greatest residual norm that the other side has at a term, by class of terms; where its product with a content's
    own is below ``least``, the posting can start no pair and is left out.
    """

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in slices(batches):
            tab, content = part.column("tab").to_numpy(), part.column("content").to_numpy()
            hashes, of, ideograph = tokens(some)
            terms, where = distinct(*grams_of(hashes, of, ideograph, len(some), RUNS))
            found: Frequent = frequent.value
            steps = found.steps(terms)
            t, at, w, norm, after = prefixes(terms, where, steps, least)
            own = mixed(t ^ mixed(tab[at].astype(np.uint64) + np.uint64(77)))
            if most is not None:
                keep = (norm + 1 / _UNIT) * most.value[(own & np.uint64(_CLASSES - 1)).astype(np.int64)] >= least * _UNIT
                own, at, w, norm, after = own[keep], at[keep], w[keep], norm[keep], after[keep]
            if turn[1] > 1:
                keep = own.view(np.int64) % turn[1] == turn[0]
                own, at, w, norm, after = own[keep], at[keep], w[keep], norm[keep], after[keep]
            columns = [pa.array(own.view(np.int64)), pa.array(content[at]), pa.array(packed(w, norm, after))]
            if sketch:
                columns += [pa.array(x) for x in sketches(terms, where, steps, int(found.most), len(some))[at].T]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["term", "content", "packed", *(SKETCH if sketch else [])]
    return texts.select("content", "tab", "text").mapInArrow(posted, ", ".join(f"{x} long" for x in names))


def _in_turn(lists: DataFrame, turn: tuple[int, int]) -> DataFrame:
    """The lists of the terms of one round."""
    return lists.where(F.pmod("term", F.lit(turn[1])) == turn[0]) if turn[1] > 1 else lists


def greatest(lists: DataFrame) -> np.ndarray:
    """By class of terms the greatest residual norm of any posting, in parts of _UNIT; 0 where no posting has such a term."""
    norm = F.shiftright("packed", 16).bitwiseAND(F.lit(_UNIT)).cast("int")
    with brief_shuffles(lists.sparkSession):
        by = lists.groupBy(F.col("term").bitwiseAND(F.lit(_CLASSES - 1)).cast("int").alias("class")).agg(F.max(norm).alias("most")).toArrow()
    out = np.zeros(_CLASSES, np.uint16)
    out[by["class"].to_numpy()] = by["most"].to_numpy()
    return out


def candidates(ours: DataFrame, theirs: DataFrame, cosine: float, every: bool = True) -> DataFrame:
    """``a, b``: contents of the two sides (their postings) whose common postings allow the cosine.

    The lists meet in an equi-join of exchanges that Spark plans, so it splits a long list among tasks. A pair's products are added
    up; after its last common posting it can gain no more than the product of the residual norms, and no more than one side's sum
    of weights times the other's greatest weight, which is that of the last common term, since weights only fall from there on. All
    parts are rounded up, so no pair that has the cosine is lost. Where the lists aren't ``every`` one, products can't be added up.
    """
    a, b = _named(ours, "a"), _named(theirs, "b")
    return _allowed(a.join(b, "term"), cosine, every)


def _named(lists: DataFrame, end: str, *others: Column) -> DataFrame:
    """Postings of one side, with the side's name in those of the columns."""
    return lists.select("term", *others, F.col("content").alias(end), *(F.col(x).alias(f"{x}_{end}") for x in ("packed", *SKETCH) if x in lists.columns))


def _allowed(met: DataFrame, cosine: float, every: bool = True) -> DataFrame:
    """``a, b`` of common postings (``_named``) that allow the cosine; unless these are ``every`` one, by each alone.

    Sketches tell of nearly all pairs where they meet, before anything is shuffled, that they don't have the cosine.
    """
    (wa, na, sa), (wb, nb, sb) = _parts("packed_a"), _parts("packed_b")
    met = met.where(na * nb >= cosine)
    if "scale_a" in met.columns:
        met = met.where(_sketched([f"{x}_a" for x in SKETCH], [f"{x}_b" for x in SKETCH]) >= cosine - 1e-6)
    if not every:
        return met.select("a", "b").distinct()
    rest = [F.sqrt(F.greatest(F.lit(0.0), (n + 2 / _UNIT) * (n + 2 / _UNIT) - w * w + 4 / _UNIT)) for n, w in ((na, wa), (nb, wb))]
    after = F.least(rest[0] * rest[1], sa * wb, sb * wa)
    products = met.select("a", "b", (wa * wb).alias("product"), after.alias("after"))
    sums = products.groupBy("a", "b").agg(F.sum("product").alias("dot"), F.min("after").alias("after"))
    return sums.where(F.col("dot") + F.least(F.lit(cosine), F.col("after")) >= cosine).select("a", "b")


def candidates_apart(ours: DataFrame, theirs: DataFrame, same: DataFrame, cosine: float, every: bool = True) -> DataFrame:
    """The same of postings that name their content's class (``first``), but for pairs of the classes ``same`` (a, b).

    Classes meet before their members do, so the versions of one text, which share most lists, are not paired with each other.
    """
    a, b = (_named(side, end, F.col("first").alias(f"u{end}")) for side, end in ((ours, "a"), (theirs, "b")))
    units = a.select("term", "ua").distinct().join(b.select("term", "ub").distinct(), "term")
    units = units.join(same.select(F.col("a").alias("ua"), F.col("b").alias("ub")), ["ua", "ub"], "left_anti")
    return _allowed(units.join(a, ["term", "ua"]).join(b, ["term", "ub"]), cosine, every)


def parted(texts: DataFrame, frequent: Broadcast) -> DataFrame:
    """``content, parts``: the norms of each unit vector in each part of the vocabulary, rounded up to 255ths, as ``_bytes`` reads them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in slices(batches):
            n = len(some)
            hashes, of, ideograph = tokens(some)
            terms, where = distinct(*grams_of(hashes, of, ideograph, n, RUNS))
            squares = weighed(frequent.value.steps(terms)) ** 2
            total = np.bincount(where, squares, minlength=n)
            place = where * np.int64(PARTS) + (terms >> np.uint64(20)).astype(np.int64) % PARTS
            norms = np.sqrt(np.bincount(place, squares / total[where], minlength=n * PARTS))
            raw = np.minimum(np.ceil(norms * 255 + 0.01 * (norms > 0)), 255).astype(np.uint8)
            offsets, data = _sparse(raw.reshape(n, PARTS))
            parts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("content"), parts], ["content", "parts"])

    return texts.select("content", "text").mapInArrow(work, "content long, parts binary")


def _sparse(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the rows of a matrix, for each a bit map of the places that aren't 0 and these places' values."""
    bits = np.packbits(raw > 0, axis=1)
    row, place = np.nonzero(raw)
    count = np.bincount(row, minlength=len(raw))
    offsets = np.append(0, np.cumsum(count + PARTS // 8))
    data = np.empty(offsets[-1], np.uint8)
    maps = np.zeros(len(data), bool)
    maps[(offsets[:-1, None] + np.arange(PARTS // 8)).ravel()] = True
    data[maps], data[~maps] = bits.ravel(), raw[row, place]
    return offsets.astype(np.int32), data


def _bytes(column: pa.Array) -> np.ndarray:
    """The matrix of a binary column that ``_sparse`` made."""
    n = len(column)
    out = np.zeros((n, PARTS), np.uint8)
    if n:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        maps = np.zeros(len(data), bool)
        maps[(offsets[:-1, None] - offsets[0] + np.arange(PARTS // 8)).ravel()] = True
        out[np.unpackbits(data[maps].reshape(n, PARTS // 8), axis=1).astype(bool)] = data[~maps]
    return out


def within_bound(pairs: DataFrame, texts: DataFrame, frequent: Broadcast, cosine: float, keep: Kept) -> DataFrame:
    """``a, b``: the pairs whose parts allow the cosine: the sum of two texts' products, part by part, is never below it.

    ``pairs`` must be a kept table; the parts of texts that are in no pair are left out (some may stay).
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("content"))
    parts = keep(parted(needed(texts, ids), frequent), "parts")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = np.einsum("ij,ij->i", _bytes(batch.column("one")).astype(np.float32), _bytes(batch.column("two")).astype(np.float32))
            yield batch.select(["a", "b"]).filter(pa.array(most >= (cosine - 1e-4) * 255 * 255))

    one, two = (parts.select(F.col("content").alias(end), F.col("parts").alias(name)) for end, name in (("a", "one"), ("b", "two")))
    found = keep(pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(bounded, "a long, b long"), "pairs")
    keep.free(parts)
    return found


def _rounds(pairs: DataFrame, contents: int, limits: tuple[int, float]) -> list[DataFrame]:
    """A kept table of pairs, cut by ``b`` so that a part has about the greater of a number and a share of the contents."""
    n = -(-pairs.count() // max(limits[0], int(limits[1] * contents))) or 1
    return [pairs.where(F.pmod(F.xxhash64("b"), F.lit(n)) == i) for i in range(n)] if n > 1 else [pairs]


def _together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def split_links(docs: DataFrame, keep: Kept, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """``links`` (a, b, cosine, wording) between training rows and held-out rows, and ``rows`` (tab, held, content, unit, doc; repeated rows once).

    ``docs``: ``doc`` bigint (unique over all tables), ``tab`` int, ``held`` boolean (null: in no split), ``text``. Rows may be
    repeated. Null texts and texts without letters or digits overlap with none. A content is known by its least doc, apart for
    each table and side. A link with ``wording`` is one of all rows of unit ``a`` with all of unit ``b``, whose common wording is the
    same; any other is one of two contents. No two rows are linked both ways.

    Vectors of idf-weighted terms are posted in inverted lists, greatest weights first, as long as the norm from there on (residual
    norm) is at least ``cosine``, and on the training side as long as its product with the greatest residual norm of the held-out
    side's list allows it; ``candidates`` joins the lists of the two sides and prunes. The cosines of what is left are
    computed from the whole texts. All bounds are exact, so no pair is lost. Equal contents meet under their hashes, and contents of
    equal common wording (``wording``) under those of that. Lists of a large
    corpus meet in rounds of terms, and its pairs in rounds of held-out contents, so that what lies on disk at once grows with the
    corpus alone. Terms are counted over the first content of each wording alone; the later
    ones are posted too, and meet all contents but those of their own wording. For that each of their lists is one of its own, which
    firsts join as well; later ones of two sides meet by their classes.
    """
    ship(docs.sparkSession)
    docs = docs.where(F.col("text").isNotNull() & F.col("doc").isNotNull()).select("doc", "tab", "held", "text")
    rows, contents, kept = distinct_contents(docs, keep, "tab int, held boolean")
    firsts, later, classes, frequent = collapsed(kept, RUNS, keep, RARE, FEW, "tab int, held boolean")

    def equal(of: DataFrame, unit: str) -> DataFrame:
        ours, theirs = of.where(~F.col("held")), of.where(F.col("held"))
        both = ours.select("one", "two", "tab", F.col(unit).alias("a")).join(theirs.select("one", "two", "tab", F.col(unit).alias("b")), ["one", "two", "tab"])
        return both.select("a", "b", F.lit(1.0).alias("cosine"))

    same = keep(equal(classes, "first"), "same")
    late = keep(kept.where(F.col("held").isNotNull()).join(later, "content"), "late")
    late_theirs = keep(postings(late.where("held"), frequent, cosine, sketch=True).join(later, "content"), "held")
    lists = postings(firsts.where("held"), frequent, cosine)
    most = docs.sparkSession.sparkContext.broadcast(greatest(lists.unionByName(late_theirs.select("term", "content", "packed"))))
    late_ours = keep(postings(late.where("not held"), frequent, cosine, most, sketch=True).join(later, "content"), "late")
    own = F.bitwise_not("term").alias("term")
    n = contents.count()
    turns, found = max(1, min(-(-n // ROUND), FEW_ROUNDS), -(-n // LONG_ROUND)), []
    for turn in ((i, turns) for i in range(turns)):
        theirs = keep(postings(firsts.where("held"), frequent, cosine, sketch=True, turn=turn), "held")
        ours_apart, theirs_apart = _in_turn(late_ours, turn), _in_turn(late_theirs, turn)
        ours = postings(firsts.where("not held"), frequent, cosine, most, sketch=True, turn=turn)
        ours = ours.unionByName(ours_apart.select(own, "content", "packed", *SKETCH))
        again = theirs.join(ours_apart.select("term").distinct(), "term", "left_semi").select(own, "content", "packed", *SKETCH)
        every = theirs.unionByName(theirs_apart.drop("first")).unionByName(again)
        pairs = candidates(ours, every, cosine, turns == 1).unionByName(candidates_apart(ours_apart, theirs_apart, same, cosine, turns == 1))
        found.append(keep(pairs, "candidates"))
        keep.free(theirs)
    keep.free(late_theirs, late_ours, late)
    if turns > 1:
        met, found = found, [keep(_together(found).distinct(), "candidates")]
        keep.free(*met)
    texts = kept.select("content", "text")
    sides = kept.where(F.col("held").isNotNull()).select("content", "text")
    bounded = []
    for some in _rounds(found[0], n, PARTS_ROUND):
        bounded.append(within_bound(some, sides, frequent, cosine, keep))
    keep.free(*found)
    near = []
    for pairs in bounded:
        for part in _rounds(pairs, n, TEXTS_ROUND):
            both, some = with_texts(part, texts, keep)
            near.append(keep(similar(both.select("a", "b", "left", "right"), frequent, "a long, b long", cosine, RUNS, POWER), "near"))
            keep.free(some)
        keep.free(pairs)
    units = contents.where(F.col("held").isNotNull()).join(later, "content", "left").select("one", "two", "tab", "held", "content", F.coalesce("first", "content").alias("unit"))
    linked = _together(near).select("a", "b", "cosine").unionByName(equal(units, "content")).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    for end in ("a", "b"):
        of = later.select(F.col("content").alias(end), F.col("first").alias(f"first_{end}"))
        linked = linked.join(of, end, "left").withColumn(f"unit_{end}", F.coalesce(f"first_{end}", end))
    linked = linked.join(same.select(F.col("a").alias("unit_a"), F.col("b").alias("unit_b")), ["unit_a", "unit_b"], "left_anti")
    links = linked.select("a", "b", "cosine", F.lit(False).alias("wording")).unionByName(same.withColumn("wording", F.lit(True)))
    links = keep(links, "links")
    keep.free(*near, kept, same)
    ends = links.select(F.explode(F.array("a", "b")).alias("content"), "wording").distinct()
    others = later.join(ends.where("wording").select(F.col("content").alias("first")), "first").select("content")
    needed = ends.select("content").unionByName(others)
    members = rows.join(units.join(needed, "content", "left_semi"), ["one", "two", "tab", "held"]).select("tab", "held", "content", "unit", "doc").dropDuplicates(["doc"])
    members = keep(members, "members")
    keep.free(rows, contents, later)
    return links, members


def _sides(links: DataFrame, rows: DataFrame) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """Links of contents and of units, each with training rows as ``a`` and held-out rows as ``b``."""
    ours, theirs = rows.where(~F.col("held")), rows.where(F.col("held"))
    return [
        (links.where(F.col("wording") == wording), ours.select("tab", "doc", F.col(by).alias("a")), theirs.select("doc", F.col(by).alias("b")))
        for by, wording in (("content", False), ("unit", True))
    ]


def split_overlaps(docs: DataFrame, keep: Kept, cosine: float = COSINE) -> DataFrame:
    """``tab, train, held, cosine``: all pairs of a training row and a held-out row of one table whose texts are the same or nearly so."""
    found = [
        of.join(ours.withColumnRenamed("doc", "train"), "a").join(theirs.withColumnRenamed("doc", "held"), "b").select("tab", "train", "held", "cosine")
        for of, ours, theirs in _sides(*split_links(docs, keep, cosine))
    ]
    return found[0].unionByName(found[1])


def overlap_counts(docs: DataFrame, keep: Kept, cosine: float = COSINE) -> DataFrame:
    """``held, pairs``: each held-out row that overlaps with training rows, and with how many; pairs are counted by content or unit, never listed."""
    found = []
    for of, ours, theirs in _sides(*split_links(docs, keep, cosine)):
        hits = of.join(ours.groupBy("a").agg(F.count("*").alias("copies")), "a").groupBy("b").agg(F.sum("copies").alias("pairs"))
        found.append(theirs.join(hits, "b").select(F.col("doc").alias("held"), "pairs"))
    return found[0].unionByName(found[1]).groupBy("held").agg(F.sum("pairs").alias("pairs"))
