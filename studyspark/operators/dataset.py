"""Training sets: expansion of templates, removal of repeats, keys, profiles and checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V


#: Templates that are gathered in one row.
TEMPLATES_A_BLOCK = 1_000


def expand(topics: DataFrame, templates: DataFrame, fields: list[str]) -> DataFrame:
    """Every topic with every template (``template``, ``label``): ``text`` with ``{field}`` filled in from the topic's columns.

    Templates are gathered in blocks of at most TEMPLATES_A_BLOCK; topics meet each block in a join and expand it where they lie. A
    null field leaves an empty place.
    """
    blocks = max(1, -(-templates.count() // TEMPLATES_A_BLOCK))
    of = F.pmod(F.xxhash64(*templates.columns), F.lit(blocks)).cast("int")
    lists = templates.groupBy(of.alias("__block")).agg(F.collect_list(F.struct(*templates.columns)).alias("__templates"))
    met = topics.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(lists, "__block")
    all_ = met.withColumn("__template", F.explode("__templates")).select(*topics.columns, "__template.*")
    text = F.col("template")
    for f in fields:
        text = F.replace(text, F.lit("{" + f + "}"), F.coalesce(F.col(f), F.lit("")))
    return all_.withColumn("text", text)


def first_of_each(df: DataFrame, order: list[Column], text: str = "text") -> DataFrame:
    """One row per stripped text, the first by ``order``; null and blank texts are dropped.

    The least row is found by an aggregate, which is summed up per task, so that one text held by very many rows makes no large group.
    """
    columns = df.columns
    key = T.stripped(F.col(text))
    rows = df.where(key != "").select(key.alias("__key"), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), *columns).alias("__row"))
    return rows.groupBy("__key").agg(F.min("__row").alias("__row")).select("__row.*").select(columns)


def record_keys(df: DataFrame, id_column: str, position: str, text: str, label: str) -> Column:
    """The stripped id; without one, ``derived:`` and the SHA-256 of position, text and label."""
    own = T.stripped(F.col(id_column).cast("string"))
    derived = F.concat(F.lit("derived:"), F.sha2(F.concat_ws("\u0000", F.col(position).cast("string"), F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(label), F.lit(""))), 256))
    return F.when(own.isNotNull() & (own != ""), own).otherwise(derived)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def profile(df: DataFrame, *fields: str) -> DataFrame:
    """``field, value, n``: counts by each of ``fields`` and in all (field ``total``), from one pass with grouping sets."""
    sets = df.groupingSets([[F.col(f)] for f in fields] + [[]], *fields).agg(F.count("*").alias("n"), *(F.grouping(f).alias(f"g_{f}") for f in fields))
    field, value = F.lit("total"), F.lit(None).cast("string")
    for f in fields:
        field = F.when(F.col(f"g_{f}") == 0, F.lit(f)).otherwise(field)
        value = F.when(F.col(f"g_{f}") == 0, F.col(f).cast("string")).otherwise(value)
    return sets.select(field.alias("field"), value.alias("value"), "n")


CASE_FIELDS = ["id", "subject", "scenario", "prompt", "skill", "diagnosis", "rubric"]


def case_library(good: DataFrame) -> DataFrame:
    """Cases with ``path`` and ``line`` (as strict JSON Lines give them); raises for the first repeated id, unknown skill or unknown diagnosis."""
    wrong = F.when(~F.col("skill").isin(V.SKILLS), F.concat(F.lit("unknown skill "), "skill")).when(~F.col("diagnosis").isin(list(V.DIAGNOSES)), F.concat(F.lit("unknown diagnosis "), "diagnosis"))
    twice = repeated_keys(good, "id").select(F.col("id").alias("twice"))
    bad = good.join(twice, good["id"] == F.col("twice"), "left").withColumn("problem", F.coalesce(wrong, F.when(F.col("twice").isNotNull(), F.concat(F.lit("repeated id "), "id"))))
    first = bad.where("problem is not null").orderBy("path", "line").first()
    if first is not None:
        raise ValueError(f"{first['path']}:{first['line']}: {first['problem']}")
    return good


def filtered(df: DataFrame, **values: str | None) -> DataFrame:
    """Rows equal to all given values; a null or empty value asks for nothing."""
    for c, v in values.items():
        if v:
            df = df.where(F.col(c) == v)
    return df


def label_set_differences(df: DataFrame, label: str, expected: list[str]) -> DataFrame:
    """``label, problem``: labels that are missing or not expected; no rows if the sets are equal."""
    want = df.sparkSession.createDataFrame([(x,) for x in expected], "label string")
    have = df.select(F.col(label).alias("label")).distinct()
    return want.exceptAll(have).withColumn("problem", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("problem", F.lit("unexpected")))


def numbered(df: DataFrame, order: list[Column], keep: Callable[[DataFrame, str], DataFrame], name: str = "id", form: str = "%04d") -> DataFrame:
    """``df`` with consecutive ids from 1 in the given order, as ``form`` writes them.

    The order is made by a range-partitioned sort that is kept (``keep`` writes and reads a table); only the partitions' row counts
    reach the driver, so no task numbers all rows.
    """
    parts = keep(df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "sorted")
    upto, start = 0, []
    for r in parts.groupBy("__part").count().orderBy("__part").collect():
        start.append((r["__part"], upto))
        upto += r["count"]
    starts = df.sparkSession.createDataFrame(start, "__part int, __start long")
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return parts.join(F.broadcast(starts), "__part").withColumn(name, F.format_string(form, place)).select(*df.columns, name)
