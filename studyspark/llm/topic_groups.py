"""Splits that keep related records together (problem 4): minimum labels over the record-entity graph, then group assignment."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..plans.shared import Kept, code, ship
from .components import components
from .disguise import compatible
from .terms import LOOK_ALIKES

#: Signs that join two topics in one cell.
JOINS = re.compile(r"[/&+|;\u3001\uff1b\uff0b\uff0f\uff06\uff5c]")
#: Largest subjects that are balanced by themselves, hash classes of all other subjects (each class is balanced), hash buckets of
#: groups, and the share of rows from which a group is placed by itself. They bound the driver's table, not what is balanced.
STRATA, CLASSES, BUCKETS, LARGE = 512, 512, 1024, 0.0005


def topic_key(name: str) -> str:
    """A topic's name apart from case, spacing, punctuation, quotation signs and form of characters; blank if nothing is left."""
    text = unicodedata.normalize("NFKC", compatible(name)[0]).casefold()
    plain = {o: p.lower() for p, others in LOOK_ALIKES.items() for o in others}
    words = re.findall(r"[^\W_]+", text)
    return "".join("".join(plain.get(c, c) for c in w) if any("a" <= c <= "z" for c in w) else w for w in words)


def topic_keys(cell: str | None) -> list[str]:
    """Keys of the topics that a cell names, without repeats and in order of key; a cell of signs alone names none."""
    if cell is None:
        return []
    return sorted({k for k in map(topic_key, JOINS.split(compatible(cell)[0])) if k})


def _keys_of(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in cells:
        yield s.map(topic_keys)


def topic_groups(rows: DataFrame, keep: Kept) -> DataFrame:
    """``id, subject, group_id, members``: every row's group, the least id of it, and how many rows it has.

    ``rows``: ``id`` bigint, ``subject``, ``topic``. Redelivered ids count once. A row with null or blank subject or topic is
    alone. Rows with the same topics in one subject are one record node; only nodes with several topics can join entities, so
    labels spread over these alone, from record to entity and back, by the least label. A topic that a third of all rows name
    is one entity with one label; what meets on it is counted per task before any shuffle. Entities are known by 64-bit hashes
    of subject and key.
    """
    ship(rows.sparkSession)
    rows = rows.where(F.col("id").isNotNull()).dropDuplicates(["id"]).select("id", code("subject").alias("subject"), "topic")
    named = rows.withColumn("keys", F.when(F.col("subject").isNotNull(), pandas_udf(_keys_of, "array<string>")("topic")))
    entities = F.transform("keys", lambda k: F.xxhash64(F.col("subject"), k))
    nodes = keep(named.select("id", "subject", F.when(F.size("keys") > 0, F.array_sort(entities)).alias("entities")), "topics")
    several = nodes.where(F.size("entities") > 1).select("entities").distinct()
    record = F.xxhash64(F.col("entities"), F.lit("record"))
    labels = components(several.select(record.alias("a"), F.explode("entities").alias("b")), keep)
    known = nodes.where(F.col("entities").isNotNull()).select("id", F.col("entities")[0].alias("entity"))
    of = known.groupBy("entity").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    of = of.join(labels, of.entity == labels.node, "left").select("entity", "least", "n", F.coalesce("label", "entity").alias("label"))
    groups = of.groupBy("label").agg(F.min("least").alias("group_id"), F.sum("n").alias("members"))
    by_entity = of.join(groups, "label").select("entity", "group_id", "members")
    found = known.join(by_entity, "entity").select("id", "group_id", "members")
    alone = nodes.where(F.col("entities").isNull()).select("id", F.col("id").alias("group_id"), F.lit(1).cast("bigint").alias("members"))
    return nodes.select("id", "subject").join(found.unionByName(alone), "id")


def place(units: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each unit (a row of row counts by stratum) the split it goes to, largest units first.

    Each goes where the sum of squared deviations, of every stratum relative to its size and of the whole, ends up least. The whole
    counts as much as all strata together, since strata of few rows can't have the shares.
    """
    sizes = np.maximum(units.sum(0), 1).astype(float)
    total = max(float(units.sum()), 1.0)
    have = np.zeros((len(want), units.shape[1]))
    out = np.zeros(len(units), np.int64)
    n_of = units.sum(1)
    for u in np.lexsort((np.arange(len(units)), -n_of)):
        row = np.flatnonzero(units[u])
        n = units[u, row].astype(float)
        off = have[:, row] - want[:, None] * sizes[row]
        cost = ((2 * off + n) * n / sizes[row]).sum(1) + (2 * (have.sum(1) - want * total) + n_of[u]) * n_of[u] / total * units.shape[1]
        out[u] = int(np.argmin(cost))
        have[out[u], row] += n
    return out


def assign_splits(groups: DataFrame, targets: DataFrame, keep: Kept, seed: int = 42) -> DataFrame:
    """``id, group_id, split``: all rows of a group in one split, the splits' shares near ``targets`` (split, share) in all and per subject.

    What is placed is a group of at least LARGE of all rows, or a hash bucket of smaller groups, as a whole: a group whose rows lie
    in several subjects is one unit with a count for each. Strata are the STRATA largest subjects and CLASSES hash classes of all
    others (rows without subject are one class more), so the driver sees at most (BUCKETS + 1 / LARGE) * (STRATA + CLASSES + 1)
    counts, whatever the number of rows, groups or subjects. Empty tables give no rows; without targets the split is null.
    """
    groups = keep(groups, "groups")
    total = groups.count()
    want = {r["split"]: r["share"] for r in targets.where("split is not null").groupBy("split").agg(F.max("share").alias("share")).collect()}
    names = sorted(want, key=lambda s: (-(want[s] or 0.0), s))
    if not total or not names:
        return groups.select("id", "group_id", F.lit(None).cast("string").alias("split"))
    by_subject = groups.where("subject is not null").groupBy("subject").agg(F.count("*").alias("n"))
    top = by_subject.orderBy(F.desc("n"), "subject").limit(STRATA).withColumn("own", F.concat(F.lit("s"), "subject")).drop("n")
    other = F.concat(F.lit("h"), F.pmod(F.xxhash64("subject"), F.lit(CLASSES)))
    stratum = F.when(F.col("subject").isNull(), "").otherwise(F.coalesce("own", other))
    large = F.col("members") >= max(2, LARGE * total)
    unit = F.when(large, F.concat(F.lit("g"), F.col("group_id"))).otherwise(
        F.concat(F.lit("b"), F.pmod(F.xxhash64(F.col("group_id"), F.lit(seed)), F.lit(BUCKETS)))
    )
    marked = groups.join(F.broadcast(top), "subject", "left").select("id", "group_id", stratum.alias("stratum"), unit.alias("unit"))
    counts = marked.groupBy("unit", "stratum").agg(F.count("*").alias("n")).toArrow().sort_by([("unit", "ascending"), ("stratum", "ascending")])
    units, at = np.unique(np.array(counts["unit"].to_pylist(), object), return_inverse=True)
    strata, where = np.unique(np.array(counts["stratum"].to_pylist(), object), return_inverse=True)
    table = np.zeros((len(units), len(strata)), np.int64)
    np.add.at(table, (at, where), counts["n"].to_numpy())
    chosen = place(table, np.array([float(want[s] or 0.0) for s in names]))
    splits = groups.sparkSession.createDataFrame([(u, names[c]) for u, c in zip(units.tolist(), chosen.tolist())], "unit string, split string")
    return marked.join(F.broadcast(splits), "unit").select("id", "group_id", "split")
