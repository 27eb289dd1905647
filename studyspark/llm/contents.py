"""Distinct contents of texts: equal ones (apart from case, spacing, punctuation, form of characters) are found once and count as one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..plans.shared import Kept, brief_shuffles
from .batches import slices
from .terms import both_wholes, tokens

#: Bits of the map by which texts that no pair needs are left out before their shuffle (8 MB, whatever the number of pairs).
_BITS = 26


def hashed(docs: DataFrame, others: str = "") -> DataFrame:
    """``doc, one, two``: two hashes of each text's token sequence; texts without letters or digits have no row.

    ``others``: columns of ``docs`` that go along, as DDL.
    """
    names = [x.split()[0] for x in others.split(",") if x]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            hashes, of, _ = tokens(texts)
            one, two = both_wholes(hashes, of, len(texts))
            columns = [part.column("doc"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *(part.column(c) for c in names)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "one", "two", *names]).filter(pa.array(one != 0))

    return docs.select("doc", "text", *names).mapInArrow(work, "doc long, one long, two long" + (", " + others if others else ""))


def distinct_contents(docs: DataFrame, keep: Kept, others: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` (doc, one, two, others; as often as delivered), ``contents`` (content, several, n rows, one, two, others) ``texts`` (content, text, others), all kept.

    A content is known by its least doc; rows that differ in ``others`` are different contents; ``several`` says that more than one
    doc has it. Only hashes are grouped, and added up per task before the shuffle. Texts of rows that surely are the only ones of
    their content (a bit map of fixed size tells) stay where they are; the others meet their content's doc in a join. What follows
    reads every content once, however the files are cut.
    """
    names = [x.split()[0] for x in others.split(",") if x]
    rows = keep(hashed(docs, others), "rows")
    grouped = rows.groupBy("one", "two", *names).agg(F.min("doc").alias("content"), (F.max("doc") > F.min("doc")).alias("several"), F.count("*").alias("n"))
    contents = keep(grouped, "contents")
    again = rows.select("doc", "one", "two").join(contents.where("n > 1").select("one", "two"), ["one", "two"], "left_semi").select(F.col("doc").alias("content"))
    every = docs.select(F.col("doc").alias("content"), "text", *names)
    maybe = _marked(again)
    least = every.where(maybe).join(contents.select("content"), "content", "left_semi").groupBy("content").agg(F.min(F.struct(*names, "text")).alias("t"))
    sure = every.where(~maybe & (F.length("text") > 0))
    texts = sure.unionByName(least.select("content", F.col("t.text").alias("text"), *(F.col(f"t.{n}").alias(n) for n in names)))
    return rows, contents, keep(texts, "texts")


def bit_map(ids: DataFrame, place: Column, bits: int) -> np.ndarray:
    """A map of 2^bits bits, as 64-bit words, with a bit set for each ``place`` of ``ids``.

    The words are made by an aggregate, so at most 2^(bits - 6) rows of 16 bytes reach the driver, whatever the number of ids.
    """
    rows = ids.select(F.shiftright(place, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    with brief_shuffles(ids.sparkSession):
        found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return words


def in_map(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bits at the places are set."""
    return (words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1


def _marked(ids: DataFrame) -> Column:
    place = F.xxhash64("content").bitwiseAND(F.lit((1 << _BITS) - 1))
    known = ids.sparkSession.sparkContext.broadcast(bit_map(ids, place, _BITS))

    @pandas_udf("boolean")
    def there(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in places:
            yield pd.Series(in_map(known.value, p.to_numpy()))

    return there(place)


def needed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``texts`` (content, text) that ``ids`` (content) may name, by a bit map of fixed size; a few others may stay."""
    return texts.where(_marked(ids))
