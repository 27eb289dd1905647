"""Samples that match target category proportions (problem 3): raked weights, exponential keys, repaired minimums."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import Kept, code

#: Buckets that each cell's keys are counted in to find the cuts, and rounds of proportional fitting.
BUCKETS, ROUNDS = 4096, 500
#: Most combinations of listed values that occur in the rows; they are raked on the driver, and more raise.
MOST_CELLS = 200_000


def _listed(field: str, values: list[str]) -> Column:
    c = code(field)
    return F.when(c.isin(values), c) if values else F.lit(None).cast("string")


def rake(counts: dict[tuple, int], margins: list[dict[str, float]], size: int) -> dict[tuple, float]:
    """Rows wanted of each cell, so that every margin's values get their shares of ``size``; never more than the cell has.

    Iterative proportional fitting over the margins in turn, starting from the cells' counts. A cell whose row count is reached
    stays there, and the others of its value take over what is missing as far as they can.
    """
    cells = sorted(c for c, n in counts.items() if n and all(v is not None for v in c))
    if not cells or size <= 0:
        return {}
    have = np.array([counts[c] for c in cells], float)
    want = have * min(1.0, size / have.sum())
    codes = [np.array([sorted(m).index(c[i]) if c[i] in m else -1 for c in cells]) for i, m in enumerate(margins)]
    for _ in range(ROUNDS):
        before = want.copy()
        for values, m in zip(codes, margins):
            for k, v in enumerate(sorted(m)):
                mine = np.flatnonzero(values == k)
                goal = min(m[v] * size, have[mine].sum())
                open_ = mine
                for _ in range(20):  # caps
                    now = want[mine].sum()
                    if not len(mine) or now <= 0 or abs(now - goal) < 1e-9 * max(1.0, goal):
                        break
                    if now > goal:
                        want[mine] *= goal / now
                    else:
                        open_ = mine[want[mine] < have[mine]]
                        rest = want[open_].sum()
                        if rest <= 0:
                            break
                        want[open_] = np.minimum(have[open_], want[open_] * (1 + (goal - now) / rest))
        if np.abs(want - before).max() < 1e-9:
            break
    return dict(zip(cells, want.tolist()))


def drawn(buckets: dict[tuple, dict[int, int]], size: int) -> dict[tuple, int]:
    """Rows of each cell among the ``size`` least keys of all cells, from the counts of keys by bucket.

    The bucket that holds the cut is shared out in proportion to the cells' rows in it, largest remainders first.
    """
    total: dict[int, int] = {}
    for per in buckets.values():
        for b, n in per.items():
            total[b] = total.get(b, 0) + n
    out = dict.fromkeys(buckets, 0)
    left = size
    for b in sorted(total):
        part = {c: per[b] for c, per in buckets.items() if b in per}
        if total[b] <= left:
            for c, n in part.items():
                out[c] += n
            left -= total[b]
            continue
        exact = {c: left * n / total[b] for c, n in part.items()}
        low = {c: math.floor(x) for c, x in exact.items()}
        rest = left - sum(low.values())
        for c in sorted(part, key=lambda c: (low[c] - exact[c], str(c)))[:rest]:
            low[c] += 1
        for c, n in low.items():
            out[c] += n
        break
    return out


def repaired(have: dict[tuple, int], got: dict[tuple, int], want: dict[tuple, float], least: list[dict[str, int]], size: int) -> dict[tuple, int]:
    """Rows of each cell so that every field's values have their ``least`` rows, as far as there are any, and about ``size`` in all.

    What a value lacks comes from its cells (also such with a null in another field) that are furthest below their raked share;
    then cells furthest above theirs give up rows that none of their values needs.
    """
    out = {c: got.get(c, 0) for c in have}
    sums = [dict.fromkeys(m, 0) for m in least]

    def add(c: tuple, n: int) -> None:
        out[c] += n
        for i, v in enumerate(c):
            if v in sums[i]:
                sums[i][v] += n

    for c, n in got.items():
        for i, v in enumerate(c):
            if v in sums[i]:
                sums[i][v] += n
    for i, m in enumerate(least):
        for v in sorted(m):
            mine = sorted((c for c in have if c[i] == v), key=lambda c: (None in c, out[c] - want.get(c, 0.0), str(c)))
            for step in (0, 1):  # first up to the raked share, then from any
                for c in mine:
                    room = have[c] - out[c] if step else min(have[c], math.ceil(want.get(c, 0.0))) - out[c]
                    add(c, max(0, min(m[v] - sums[i][v], room)))
    over = sum(n for c, n in out.items() if None not in c) - size
    for c in sorted((c for c in out if None not in c), key=lambda c: (want.get(c, 0.0) - out[c], str(c))):
        spare = min([out[c] - math.floor(want.get(c, 0.0)), *(sums[i][v] - least[i][v] for i, v in enumerate(c) if v in least[i])])
        n = max(0, min(over, spare))
        add(c, -n)
        over -= n
    return {c: n for c, n in out.items() if n > 0}


def sample_to_targets(rows: DataFrame, key: str, fields: list[str], targets: DataFrame, keep: Kept, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A sample of ``rows`` by the targets of its ``fields``, and a report.

    ``targets``: target_id, field, value, target_share, min_rows, sample_rate. Variants of a value count as one; keys repeat and
    count once; rows with a null or unlisted value in a field are drawn only to repair a minimum. The sample has the least of the
    fields' sizes floor(sample_rate * rows with a listed value). Gives ``sample`` (key, fields, ``weight``: the cell's raked share)
    and ``report`` (a row per target: rows available, rows wanted = greater of min_rows and floor(target_share * size of its field),
    rows sampled, its share of the sample, the gap to target_share, and ``unmet``: fewer available than wanted).

    1. The cells' counts (all combinations of values that occur) are raked to the margins' shares, which gives each cell the
       probability p of its rows.
    2. Every row has an exponential key of rate -ln(1 - p), from its own hash, so that it stays below 1 with probability p; the rows of
       least keys are drawn, in one draw over all cells. Cuts are found by counts in buckets of keys; nothing is ordered as a whole.
    3. ``repaired`` settles how many rows each cell gives in the end: minimums first, then the size. A cell's least keys are taken, so
       the draw stays the same but for what is repaired.
    """
    spark = rows.sparkSession
    asked = [r.asDict() for r in targets.select("target_id", "field", code("value").alias("value"), "target_share", "min_rows", "sample_rate").orderBy("target_id").collect()]
    by = {f: {t["value"]: t for t in asked if t["field"] == f and t["value"] is not None} for f in fields}
    names = [f"field_{i}" for i in range(len(fields))]
    coded = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *(_listed(f, sorted(by[f])).alias(n) for f, n in zip(fields, names)))
    coded = keep(coded.dropDuplicates(["key"]), "coded")
    found = coded.groupBy(*names).agg(F.count("*").alias("n")).limit(MOST_CELLS + 1).collect()
    if len(found) > MOST_CELLS:
        raise ValueError(f"the fields' listed values occur in more than {MOST_CELLS} combinations")
    counts = {tuple(r[n] for n in names): r["n"] for r in found}
    available = [{v: sum(n for c, n in counts.items() if c[i] == v) for v in by[f]} for i, f in enumerate(fields)]
    sizes = [math.floor((next(iter(by[f].values()))["sample_rate"] or 0) * sum(available[i].values()) + 1e-9) if by[f] else 0 for i, f in enumerate(fields)]
    size = min(sizes, default=0)
    want = rake(counts, [{v: t["target_share"] or 0.0 for v, t in by[f].items()} for f in fields], size)
    share = {c: min(1.0, want.get(c, 0.0) / n) for c, n in counts.items()}

    cells = sorted(counts, key=str)
    numbers = spark.createDataFrame(
        [(*c, i, float(-math.log1p(-share[c])) if share[c] < 1 else None, float(share[c])) for i, c in enumerate(cells)],
        ", ".join(f"{n} string" for n in names) + ", cell int, rate double, weight double",
    )
    u = (F.shiftrightunsigned(F.xxhash64(F.col("key"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    same = [F.col(f"c.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names]
    keyed = coded.alias("r").join(F.broadcast(numbers.alias("c")), same).select("r.*", "cell", "rate", "weight").withColumn("u", u)
    # a rate of null stands for infinity: the key is 0; rows of rate 0 come last, in order of u
    at = F.when(F.col("rate").isNull(), 0.0).when(F.col("rate") > 0, -F.log1p(-F.col("u")) / F.col("rate"))
    low = F.floor((1 - F.exp(-at)) * (BUCKETS - 1))
    keyed = keyed.withColumn("bucket", F.when(at.isNotNull(), F.least(low, F.lit(BUCKETS - 2))).otherwise(BUCKETS - 1 + F.floor(F.col("u") * BUCKETS)).cast("int"))
    buckets: dict[tuple, dict[int, int]] = {c: {} for c in cells}
    for r in keyed.groupBy("cell", "bucket").agg(F.count("*").alias("n")).collect():
        buckets[cells[r["cell"]]][r["bucket"]] = r["n"]
    least = [{v: min(available[i][v], max(t["min_rows"] or 0, math.floor((t["target_share"] or 0.0) * size + 1e-12))) for v, t in by[f].items()} for i, f in enumerate(fields)]
    whole = round(sum(want.values()))  # less than the size where values have fewer rows than their share
    first = drawn({c: {b: n for b, n in per.items() if b < BUCKETS - 1} for c, per in buckets.items() if share[c] > 0}, whole)
    take = repaired(counts, first, want, least, whole)
    cuts = []
    for i, c in enumerate(cells):
        left, cut = take.get(c, 0), 1 << 30
        for b in sorted(buckets[c]):
            if buckets[c][b] > left:
                cut = b
                break
            left -= buckets[c][b]
        cuts.append((i, cut, left))
    marked = keyed.join(F.broadcast(spark.createDataFrame(cuts, "cell int, cut int, more int")), "cell")
    sure = marked.where(F.col("bucket") < F.col("cut"))
    order = Window.partitionBy("cell").orderBy("u", "key")
    edge = marked.where((F.col("bucket") == F.col("cut")) & (F.col("more") > 0)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("more")).drop("r")
    chosen = keep(sure.unionByName(edge).select("key", *names, "weight"), "chosen")
    got_cells = {tuple(r[n] for n in names): r["n"] for r in chosen.groupBy(*names).agg(F.count("*").alias("n")).collect()}
    got = [{v: sum(n for c, n in got_cells.items() if c[i] == v) for v in by[f]} for i, f in enumerate(fields)]
    drawn_rows = [sum(g.values()) for g in got]
    report = []
    for i, f in enumerate(fields):
        for v, t in by[f].items():
            wanted = max(t["min_rows"] or 0, math.floor((t["target_share"] or 0.0) * sizes[i] + 1e-12))
            reached = got[i][v] / drawn_rows[i] if drawn_rows[i] else 0.0
            report.append((t["target_id"], f, v, available[i][v], wanted, got[i][v], reached, reached - (t["target_share"] or 0.0), available[i][v] < wanted))
    schema = "target_id long, field string, value string, available long, wanted long, sampled long, share double, gap double, unmet boolean"
    renamed = chosen.select(F.col("key").alias(key), *(F.col(n).alias(f) for n, f in zip(names, fields)), "weight")
    return renamed, spark.createDataFrame(report, schema)
