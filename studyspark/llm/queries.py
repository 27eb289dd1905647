"""The queries of problems 1 to 8."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import Kept, table
from . import abuse, disguise, leaks, mixing
from . import near_copies as nc
from . import overlap, sampling, topic_groups
from .oracle import ORACLE

# Two tables in one corpus: a row's doc is twice its key, plus its table's number.


def _docs(spark: SparkSession, sf_dir: str, tables: list[tuple[str, str]]) -> DataFrame:
    parts = [table(spark, sf_dir, t).select((F.col(k) * 2 + i).alias("doc"), "text") for i, (t, k) in enumerate(tables)]
    return parts[0].unionByName(parts[1])


def _table(doc: str, tables: list[tuple[str, str]]):
    return F.when(F.pmod(F.col(doc), F.lit(2)) == 0, tables[0][0]).otherwise(tables[1][0])


P5 = [("routing_cases", "case_id"), ("smoke", "case_no")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows of one table whose texts go back to the same text."""
    members, _ = nc.near_copies(_docs(spark, sf_dir, P5), Kept(spark))
    split = members.select("doc", F.concat_ws(":", F.pmod("doc", F.lit(2)), "group").alias("group"))
    pairs = nc.pairs_of(split)
    return pairs.select(_table("a", P5).alias("tab"), F.floor(F.col("a") / 2).alias("key_a"), F.floor(F.col("b") / 2).alias("key_b"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that has a copy, with its group's least row, the size of the group, and to how many rows it is linked itself.

    Links between contents stay pairs of contents; copies are counted, not paired.
    """
    members, links = nc.near_copies(_docs(spark, sf_dir, P5), Kept(spark))
    members = members.withColumn("t", F.pmod("doc", F.lit(2)))
    classes = members.groupBy("group", "t").agg(F.min("doc").alias("least"), F.count("*").alias("members")).where("members > 1")
    sizes = members.groupBy("content", "t").agg(F.count("*").alias("copies"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.withColumnRenamed("content", "b"), "b").groupBy(F.col("a").alias("content"), "t").agg(F.sum("copies").alias("others"))
    linked = sizes.join(others, ["content", "t"], "left").select("content", "t", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return members.join(classes, ["group", "t"]).join(linked, ["content", "t"]).select(
        _table("doc", P5).alias("tab"), F.floor(F.col("doc") / 2).alias("key"), F.floor(F.col("least") / 2).alias("class_key"), "members", "links"
    )


CASES = [("routing_cases", "case_id"), ("diagnosis_cases", "case_id")]


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.lower(F.trim("split"))
    held = F.when(split == "train", False).when(split.isin("validation", "test"), True)
    parts = [
        table(spark, sf_dir, t).select((F.col(k) * 2 + i).alias("doc"), F.lit(i).alias("tab"), held.alias("held"), "text", split.alias("split"), "source")
        for i, (t, k) in enumerate(CASES)
    ]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training row and a validation or test row of one table whose texts are the same or nearly so."""
    pairs = overlap.split_overlaps(_split_rows(spark, sf_dir).drop("split", "source"), Kept(spark))
    a, b = F.floor(F.least("train", "held") / 2), F.floor(F.greatest("train", "held") / 2)
    return pairs.select(_table("train", CASES).alias("tab"), a.alias("case_id_a"), b.alias("case_id_b"))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By table, split and source of the held-out row: rows that overlap with training rows, and pairs."""
    rows = _split_rows(spark, sf_dir)
    hits = overlap.overlap_counts(rows.drop("split", "source"), Kept(spark))
    of = rows.where(F.col("held")).select("doc", "split", "source").dropDuplicates(["doc"])
    return of.join(hits.withColumnRenamed("held", "doc"), "doc", "left").groupBy(_table("doc", CASES).alias("tab"), "split", "source").agg(
        F.count("*").alias("held_rows"), F.count("pairs").alias("overlapping_rows"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")
    )


def _plain(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tab"), F.col(k).alias("case_id"), "text") for t, k in CASES]
    return disguise.plain_texts(parts[0].unionByName(parts[1]), ["tab", "case_id"], with_text=with_text)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text holds a character that is invisible or stands in for a common one of the same look."""
    return _plain(spark, sf_dir, False).where("disguised").select("tab", "case_id").dropDuplicates(["tab", "case_id"])


def p2_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in one consistent form."""
    return _plain(spark, sf_dir, True).dropDuplicates(["tab", "case_id"])


def _topic_groups(spark: SparkSession, sf_dir: str, keep: Kept) -> DataFrame:
    return topic_groups.topic_groups(table(spark, sf_dir, "topics").select(F.col("topic_id").alias("id"), "subject", "topic"), keep)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of topics that must share a split with another row, with the least topic_id of their group."""
    return _topic_groups(spark, sf_dir, Kept(spark)).where("members > 1").select(F.col("id").alias("topic_id"), "group_id")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic with its group and split."""
    keep = Kept(spark)
    found = topic_groups.assign_splits(_topic_groups(spark, sf_dir, keep), table(spark, sf_dir, "split_targets"), keep)
    return found.select(F.col("id").alias("topic_id"), "group_id", "split")


def p4_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with a split, groups in two splits, and whether all shares are within 2 % (or ten rows) of their targets."""
    placed = p4_splits(spark, sf_dir)
    targets = table(spark, sf_dir, "split_targets").select("split", "share")
    groups = placed.groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("b"), F.count("*").alias("n"))
    shares = placed.groupBy("split").agg(F.count("*").alias("n")).join(targets, "split", "full")
    off = F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * F.sum("n").over(Window.partitionBy(F.lit(1))))
    near = shares.select((off <= F.greatest(F.lit(10.0), 0.02 * F.sum("n").over(Window.partitionBy(F.lit(1))))).alias("near")).agg(F.coalesce(F.bool_and("near"), F.lit(True)).alias("near_shares"))
    whole = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("topics"), F.count_if(F.col("a") != F.col("b")).alias("groups_in_two_splits"))
    return whole.where("topics > 0").crossJoin(F.broadcast(near))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"), Kept(spark))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the held-out items whose own wording they contain."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the share of the item's own wording and its tokens."""
    return _leaks(spark, sf_dir)


SAMPLED = {"routing_cases": ("case_id", ["skill", "category"]), "subject_cases": ("id", ["subject"])}


def _samples(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, DataFrame]]:
    keep, targets = Kept(spark), table(spark, sf_dir, "sample_targets")
    return [
        (t, *sampling.sample_to_targets(table(spark, sf_dir, t), key, fields, targets.where(F.col("tab") == t).drop("tab"), keep))
        for t, (key, fields) in SAMPLED.items()
    ]


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target with rows available, wanted and sampled, the share reached and its gap."""
    reports = [r.select(F.lit(t).alias("tab"), "*") for t, _, r in _samples(spark, sf_dir)]
    return reports[0].unionByName(reports[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that the rows can't meet."""
    return p3_report(spark, sf_dir).where("unmet").select("target_id")


def p3_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's rows available and wanted, and whether the sample has the least rows that there are, and none twice."""
    out = None
    for t, sample, report in _samples(spark, sf_dir):
        of = table(spark, sf_dir, "sample_targets").where(F.col("tab") == t).select("target_id", "min_rows")
        once = sample.count() == sample.select(sample.columns[0]).distinct().count()
        r = report.join(of, "target_id").select(
            "target_id", "available", "wanted", (F.col("sampled") >= F.least("available", "min_rows")).alias("has_minimum"),
            ((F.col("sampled") <= F.col("available")) & F.lit(once)).alias("each_once"),
        )
        out = r if out is None else out.unionByName(r)
    return out


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that were drawn."""
    parts = [s.select(F.lit(t).alias("tab"), F.col(SAMPLED[t][0]).cast("string").alias("key")) for t, s, _ in _samples(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), Kept(spark))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that can't supply their weight."""
    return _mix(spark, sf_dir)[1].where("short").select("source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's tokens, need, and actual share."""
    return _mix(spark, sf_dir)[1]


def p7_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source: whether it falls short, whether the fitted rates give what it needs or all it has, and whether no document is used too often."""
    copies, report = _mix(spark, sf_dir)
    most = copies.groupBy("source").agg(F.max("copies").alias("used"))
    needed = F.least("needed", "most")
    exact = F.abs(F.col("fitted_tokens") - needed) <= 1e-6 * F.greatest(F.lit(1.0), needed)
    return report.join(most, "source", "left").select("source", "short", exact.alias("fitted_exactly"), (F.coalesce("used", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"))


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: documents and how often each is used."""
    return _mix(spark, sf_dir)[0].select("doc_id", "source", "tokens", "copies")


def _abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"), Kept(spark))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an insulting, threatening, demeaning or sexually explicit passage."""
    return _abuse(spark, sf_dir).where("toxic").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    return _abuse(spark, sf_dir)


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: documents, and whether every one has a score between 0 and 1."""
    return _abuse(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.bool_and(F.coalesce(F.col("score").between(0, 1), F.lit(False))).alias("scored"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: documents, toxic ones, and their rate."""
    by = _abuse(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("toxic").alias("toxic"))
    return by.withColumn("rate", F.col("toxic") / F.col("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_counts": p1_counts, "p2_found": p2_found, "p2_plain": p2_plain, "p3_found": p3_found, "p3_report": p3_report, "p3_sample": p3_sample, "p3_balance": p3_balance, "p4_found": p4_found, "p4_splits": p4_splits, "p4_balance": p4_balance, "p5_found": p5_found, "p5_classes": p5_classes,
    "p6_found": p6_found, "p6_shares": p6_shares, "p7_found": p7_found, "p7_report": p7_report, "p7_copies": p7_copies, "p7_balance": p7_balance,
    "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates, "p8_coverage": p8_coverage,
}

__all__ = ["ORACLE", "QUERIES"]
