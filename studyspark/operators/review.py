"""The review dashboard: items checked and named, summaries of several stores, bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scheduler

LONGEST_TEXT, LONGEST_TITLE = 100_000, 40
COUNTS = {"review_count": (0, 1_000_000), "correct_streak": (0, 1_000_000), "interval_days": (1, 365_000)}
ITEM = (
    "id string, word string, content string, title string, question string, review_count int, correct_streak int, interval_days int, "
    "ease_factor double, mastered boolean, created_at string, last_reviewed string, next_review string"
)


def violations(items: DataFrame) -> DataFrame:
    """``items`` with ``problem`` where a count, day or text is out of bounds; null fields are fine."""
    problem = F.lit(None).cast("string")
    for c, (low, high) in COUNTS.items():
        problem = F.when(~F.col(c).between(low, high), f"{c} is out of bounds").otherwise(problem)
    for c in ("created_at", "last_reviewed", "next_review"):
        problem = F.when(F.col(c).isNotNull() & (F.trim(c) != "") & scheduler.day(F.col(c)).isNull(), f"{c} is no day").otherwise(problem)
    for c in ("id", "word", "content", "title", "question"):
        problem = F.when(F.length(c) > LONGEST_TEXT, f"{c} is too long").otherwise(problem)
    return items.withColumn("problem", problem).where("problem is not null")


def state(items: DataFrame, today: str) -> DataFrame:
    """Items with full states and scores; days as dates, unknown ones null."""
    dated = items.withColumn("next_review", scheduler.day(F.col("next_review")))
    return scheduler.with_scores(scheduler.with_defaults(dated), today)


def _first_key(names: list[str], default: str) -> Column:
    """The value of the first of the keys that an item has, even if it is empty; ``keys`` (array) names those it has, if there is such a column."""
    out = F.lit(default)
    for name in reversed(names):
        out = F.when(F.array_contains("keys", name), F.coalesce(F.col(name), F.lit("None"))).otherwise(out)
    return out


def word_name() -> Column:
    """What a word item (with ``keys``) is called: word, content or id, by the first key that is there, else ``?``."""
    return _first_key(["word", "content", "id"], "?")


def text_name() -> Column:
    """What a text item (with ``keys``) is called: title, content, id or question, by the first key that is there, cut at 40 characters."""
    return F.left(_first_key(["title", "content", "id", "question"], "?"), F.lit(LONGEST_TITLE))


def bar(value: Column, total: Column, width: int = 20) -> Column:
    """A bar of ``width`` characters, filled in proportion; empty without a total."""
    filled = F.coalesce(F.try_divide(F.lit(width) * value, total), F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def summary(stores: dict[str, DataFrame], today: str) -> DataFrame:
    """``store, total, mastered, active, due, mastered_percent, bar`` for each store of states and for ``all`` of them."""
    parts = [df.select(F.lit(name).alias("store"), "mastered", "next_review") for name, df in stores.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    both = every.unionByName(every.withColumn("store", F.lit("all")))
    return scheduler.mastery_stats(both, today, "store").withColumn("bar", bar(F.col("mastered"), F.col("total")))


def learning_report(stores: dict[str, DataFrame], today: str, analytical: DataFrame | None = None, most: int = 5) -> DataFrame:
    """``section, rank, store, name, value``: one report over all stores of states (with ``name``).

    Sections: ``memory`` (items, mastered and due of each store, ``no data`` for an empty one), ``weak`` (each store's ``most`` weakest),
    ``attention`` (the ``most`` weakest of all stores together), ``stable`` (mastered items with the longest streaks) and ``analysis``
    (files of each directory, from ``analytical``: directory, files).
    """
    spark = next(iter(stores.values())).sparkSession
    shape = "section string, rank int, store string, name string, value string"
    out = spark.createDataFrame([], shape)
    counts = {r["store"]: r for r in summary(stores, today).collect()}
    lines = []
    for i, name in enumerate(stores, 1):
        c = counts.get(name)
        lines.append(("memory", i, name, name, f"{c['total']} in all, {c['mastered']} mastered ({c['mastered_percent']} %), {c['due']} due" if c else "no data"))
    out = out.unionByName(spark.createDataFrame(lines, shape))

    def ranked(df: DataFrame, section: str, order: list[Column], value: Column) -> DataFrame:
        first = df.orderBy(*order).limit(most)
        return first.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("rank"), "store", "name", value.alias("value"))

    open_ = [df.where(~F.col("mastered")).withColumn("store", F.lit(name)) for name, df in stores.items()]
    said = F.format_string("streak %d, %d reviews", F.col("correct_streak"), F.col("review_count"))
    columns = ["store", "name", "review_priority", "next_review", "correct_streak", "review_count"]
    for df in open_:
        out = out.unionByName(ranked(df, "weak", scheduler.review_order(df), said))
    every = reduce(DataFrame.unionByName, [df.select(*columns) for df in open_])
    order = [F.desc("review_priority"), F.coalesce(F.col("next_review").cast("string"), F.lit("0000-00-00")), F.col("store"), F.col("name")]
    out = out.unionByName(ranked(every, "attention", order, said))
    done = reduce(DataFrame.unionByName, [df.where("mastered").withColumn("store", F.lit(name)).select(*columns) for name, df in stores.items()])
    out = out.unionByName(ranked(done, "stable", [F.desc("correct_streak"), F.col("store"), F.col("name")], said))
    if analytical is not None:
        found = analytical.select(F.lit("analysis").alias("section"), F.row_number().over(Window.orderBy("directory")).alias("rank"), F.col("directory").alias("store"), F.col("directory").alias("name"), F.concat(F.col("files").cast("string"), F.lit(" files")).alias("value"))
        out = out.unionByName(found)
    return out
