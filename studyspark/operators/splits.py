"""Hold-outs: per-label, and by groups with the best balance among many candidates; replay of a recorded one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import Kept


def _rank_hash(seed: int, *columns):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def first_share(rows: DataFrame, by: list[str], h: str, tie: str, share: float) -> DataFrame:
    """``rows`` with ``first``: whether a row is among the first ceil(share * n) of its ``by`` values, in order of the hash ``h``.

    No set of rows is sorted as a whole: 4096 ranges of the hash are counted, the cut lies in one of them, and only that range is
    ranked.
    """
    ranged = rows.withColumn("__range", F.substring(h, 1, 3))
    counts = ranged.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    upto = counts.withColumns({"__upto": F.sum("__n").over(w.orderBy("__range")), "__all": F.sum("__n").over(w)})
    upto = upto.withColumn("__want", F.ceil(F.lit(share) * F.col("__all")))
    cut = upto.where(F.col("__upto") >= F.col("__want")).groupBy(*by).agg(F.min(F.struct("__range", F.col("__upto") - F.col("__n"), "__want")).alias("c"))
    cut = cut.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("c").getField("__range").alias("__cut"), (F.col("c.__want") - F.col("c.col2")).alias("__more"))
    if by:
        marked = ranged.join(cut, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], "left")
    else:
        marked = ranged.crossJoin(F.broadcast(cut))
    edge = F.col("__range") == F.col("__cut")
    place = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(h, tie))
    sure = marked.where(~edge).withColumn("first", F.col("__range") < F.col("__cut"))
    ranked = marked.where(edge).withColumn("first", place <= F.col("__more"))
    return sure.unionByName(ranked).select(*rows.columns, "first")


def stratified(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: of each label's rows the first ceil(test_size * n) by hash are test. Rows with a null label are train."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    rows = df.withColumn("__h", _rank_hash(seed, F.col(key).cast("string")))
    marked = first_share(rows.where(F.col(label).isNotNull()), [label], "__h", key, test_size)
    named = marked.withColumn("split", F.when(F.col("first"), "test").otherwise("train")).select(*df.columns, "split")
    return named.unionByName(df.where(F.col(label).isNull()).withColumn("split", F.lit("train")))


def group_candidates(df: DataFrame, group: str, label: str, test_size: float = 0.2, seed: int = 42, candidates: int = 128) -> DataFrame:
    """``candidate, score, test_groups``: for each candidate shuffle of the groups how far test shares are off, over all rows and labels.

    Candidates that leave a label out of either side are not listed. Rows are first counted by group and label. A group meets all
    candidates where it lies, and its rows are added up there by candidate, range of hashes and label: ranges below that of a
    candidate's cut are test as a whole. Only the groups of that one range are shuffled (candidates / 256 of a group on the average).
    """
    counts = df.dropna(subset=[group, label]).groupBy(F.col(group).alias("g"), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    return _rated(counts, Kept(df.sparkSession), test_size, seed, candidates)[0].select("candidate", "score", "test_groups")


def _rated(counts: DataFrame, keep: Kept, test_size: float, seed: int, candidates: int) -> tuple[DataFrame, DataFrame]:
    """The candidates with their cuts, and the groups (``g``, ``labels``) as a kept table; counts: rows by group ``g`` and label ``l``."""
    groups = keep(counts.groupBy("g").agg(F.collect_list(F.struct("l", "n")).alias("labels")), "groups")
    spread = groups.withColumn("candidate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(candidates - 1).cast("bigint"))))
    spread = spread.withColumn("h", _rank_hash(seed, F.col("candidate").cast("string"), F.col("g"))).withColumn("range", F.substring("h", 1, 2))
    each = spread.select("candidate", "range", F.posexplode("labels").alias("place", "x"))
    summed = keep(each.groupBy("candidate", "range", F.col("x.l").alias("l")).agg(F.sum("x.n").alias("n"), F.count_if(F.col("place") == 0).alias("groups")), "ranges")
    w = Window.partitionBy("candidate")
    upto = summed.groupBy("candidate", "range").agg(F.sum("groups").alias("groups"))
    upto = upto.withColumns({"upto": F.sum("groups").over(w.orderBy("range")), "test_groups": F.ceil(F.lit(test_size) * F.sum("groups").over(w))})
    cut = upto.where(F.col("upto") >= F.col("test_groups")).groupBy("candidate", "test_groups").agg(F.min(F.struct("range", F.col("upto") - F.col("groups"))).alias("c"))
    cut = keep(cut.select("candidate", "test_groups", F.col("c.range").alias("cut"), (F.col("test_groups") - F.col("c.col2")).alias("more")), "cut")
    edge = spread.join(F.broadcast(cut), "candidate").where(F.col("range") == F.col("cut"))
    edge = edge.withColumn("rank", F.row_number().over(w.orderBy("h", "g"))).where(F.col("rank") <= F.col("more"))
    edge = edge.select("candidate", F.explode("labels").alias("x")).select("candidate", F.col("x.l").alias("l"), F.lit(0).cast("bigint").alias("n"), F.col("x.n").alias("t"))
    below = F.when(F.col("range") < F.col("cut"), F.col("n")).otherwise(F.lit(0))
    whole = summed.join(F.broadcast(cut), "candidate").select("candidate", "l", "n", below.alias("t"))
    by_label = whole.unionByName(edge).groupBy("candidate", "l").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    scores = by_label.groupBy("candidate").agg(
        F.abs(F.sum("t") / F.sum("n") - test_size).alias("all_off"), F.avg(F.abs(F.col("t") / F.col("n") - test_size)).alias("label_off"),
        F.min(F.least("t", F.col("n") - F.col("t"))).alias("least"),
    )
    found = scores.where("least > 0").join(F.broadcast(cut), "candidate")
    return found.withColumn("score", F.rint((F.col("all_off") + F.col("label_off")) * 1e9) / 1e9), groups


def grouped(df: DataFrame, key: str, group: str, label: str, test_size: float = 0.2, seed: int = 42, candidates: int = 128) -> DataFrame:
    """``df`` with ``split``: whole groups in train or test, by the candidate of least (score, number).

    Labels with fewer than two groups are split by row; rows without group or label are train. Key, group and label are kept as a
    table, and so is each later step, so that ``df`` isn't worked out again for each and every plan stays small.
    """
    keep = Kept(df.sparkSession)
    rows = keep(df.select(*dict.fromkeys([key, group, label])), "rows")
    named = rows.select(F.col(key).cast("string").alias("k"), F.col(group).cast("string").alias("g"), F.col(label).alias("l"))
    pairs = keep(named.dropna(subset=["g", "l"]).groupBy("g", "l").agg(F.count("*").alias("n")), "pairs")
    few = keep(pairs.groupBy("l").agg(F.count("*").alias("n")).where("n < 2").select("l"), "few")
    by_row, by_group = F.concat(F.lit("record-id:"), F.col("k")), F.concat(F.lit("field:"), F.col("g"))
    alone = named.dropna(subset=["k"]).join(few, "l", "left_semi").groupBy(by_row.alias("g"), "l").agg(F.count("*").alias("n"))
    found, groups = _rated(pairs.join(few, "l", "left_anti").select(by_group.alias("g"), "l", "n").unionByName(alone), keep, test_size, seed, candidates)
    best = found.agg(F.min(F.struct("score", "candidate", "cut", "more")).alias("b")).collect()[0]["b"]
    if best is None:
        raise ValueError("no candidate has every label on both sides")
    units = groups.select(F.col("g").alias("__unit"), _rank_hash(seed, F.lit(str(best["candidate"])), F.col("g")).alias("h")).withColumn("range", F.substring("h", 1, 2))
    edge = units.where(F.col("range") == best["cut"]).withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy("h", "__unit")))
    test = units.where(F.col("range") < best["cut"]).select("__unit").unionByName(edge.where(F.col("rank") <= best["more"]).select("__unit"))
    test = keep(test.withColumn("__test", F.lit(True)), "test")
    keep.free(pairs, groups)
    whole = rows.select(*df.columns) if set(df.columns) == set(rows.columns) else df
    marked = whole.join(few.withColumnRenamed("l", "__few"), F.col(label) == F.col("__few"), "left")
    unit = F.when(F.col("__few").isNotNull(), F.concat(F.lit("record-id:"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("field:"), F.col(group).cast("string")))
    marked = marked.withColumn("__unit", F.when(F.col(label).isNotNull(), unit)).join(test, "__unit", "left")
    return marked.withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).select(*df.columns, "split")


def leakage(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """One row: groups, groups on both sides, and rows in such groups."""
    by = df.dropna(subset=[group]).groupBy(group).agg(F.count_if(F.col(split) == "test").alias("t"), F.count("*").alias("n"))
    both = (F.col("t") > 0) & (F.col("t") < F.col("n"))
    return by.agg(F.count("*").alias("groups"), F.count_if(both).alias("groups_on_both_sides"), F.coalesce(F.sum(F.when(both, F.col("n"))), F.lit(0)).alias("rows_in_them"))


def replay(df: DataFrame, key: str, holdout: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key a recorded hold-out (column ``key``) lists, and the listed keys that no row has."""
    ids = holdout.select(F.col("key").alias(key)).distinct()
    return df.join(ids, key, "left_semi"), ids.join(df.select(key), key, "left_anti")
