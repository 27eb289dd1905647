"""The eight problems' operators on small inputs: against brute force, exact expectations, and inputs that are odd in every way."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from studyspark.llm import abuse, disguise, leaks, mixing, near_copies, overlap, sampling, terms, topic_groups
from studyspark.llm import queries as Q
from studyspark.llm.components import components
from studyspark.llm.contents import distinct_contents, in_map, bit_map, needed
from studyspark.llm.corpus import Frequent, frequent_terms
from studyspark.llm.wording import collapsed
from studyspark.plans.shared import Kept


def groups_of(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# terms


def test_tokens_ignore_case_form_spacing_and_what_is_invisible():
    same = ["Ｋröxurell Transform—f=1", "kroxurell   transform, F(1)", "Krö​xurell\ttransform f 1", "kröхurell transform f 1"]
    h = [terms.tokens([t])[0].tolist() for t in same]
    assert all(x == h[0] for x in h)
    assert terms.tokens(["", "。！"])[0].size == 0


def test_grams_of_short_texts_and_long_ones():
    t, d = terms.grams(["一", "", "a b", "x" * 300_000], (("words", 2), ("ideographs", 3)))
    assert sorted(set(d.tolist())) == [0, 2, 3]
    t1, d1 = terms.distinct(*terms.grams(["a b a b a b"], (("words", 1),)))
    assert len(t1) == 2


def test_frequent_terms_equal_counts_by_hand(spark):
    texts = ["common word %d" % i for i in range(60)] + [None, ""]
    rows = frame(spark, [(t,) for t in texts], "text string").repartition(3)
    f = frequent_terms(rows, (("words", 1),), Kept(spark)).value
    h, _, _ = terms.tokens(["common", "never"])
    assert f.idf(h[:1])[0] == pytest.approx(math.log(61 / 60), abs=2e-4)
    assert f.idf(h[1:])[0] == pytest.approx(math.log(61 / 20), abs=2e-4)
    # where texts are long, only so many terms are broadcast; the others count as rare
    few = frequent_terms(frame(spark, [(" ".join(f"w{j}" for j in range(i % 7 + 20)),) for i in range(300)], "text string"), (("words", 1),), Kept(spark), most=22).value
    assert len(few.terms) <= 22


def test_token_hashes_do_not_depend_on_neighbours():
    rng = np.random.RandomState(2)
    texts = ["".join(rng.choice(list("ab 一二,é\u200bЖ1"), rng.randint(0, 40))) for _ in range(300)] + ["", "。", "x" * 5000, "\U0010ffff a"]
    every, of, ideograph = terms.tokens(texts)
    for i, t in enumerate(texts):
        h, _, d = terms.tokens([t])
        assert h.tolist() == every[of == i].tolist() and d.tolist() == ideograph[of == i].tolist()


# components


def test_components_equal_union_find(spark):
    rng = np.random.RandomState(0)
    edges = [(int(a), int(b)) for a, b in rng.randint(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(frame(spark, edges, "a long, b long"), Kept(spark)).collect()}
    assert got == groups_of(edges)
    assert components(frame(spark, [], "a long, b long"), Kept(spark)).count() == 0


# contents


def test_distinct_contents_and_maps(spark):
    rows = [(5, "A b."), (3, "a, B"), (9, "c"), (9, "c"), (7, None), (8, "。"), (4, "d"), (2, "a b"), (2, "a b")]
    got, contents, texts = distinct_contents(frame(spark, rows, "doc long, text string").repartition(3).where("text is not null"), Kept(spark))
    assert {(r["content"], r["several"]) for r in contents.collect()} == {(2, True), (9, False), (4, False)}
    found = sorted((r["content"], r["text"]) for r in texts.where("text <> '。'").collect())
    assert found == [(2, "a b"), (4, "d"), (9, "c")]
    ids = spark.range(0, 5000, 7).select(F.col("id").alias("content"))
    texts = spark.range(5000).select(F.col("id").alias("content"), F.lit("t").alias("text"))
    some = {r["content"] for r in needed(texts, ids).collect()}
    assert set(range(0, 5000, 7)) <= some and len(some) < 1000
    words = bit_map(spark.range(10).select((F.col("id") * 100).alias("p")), F.col("p"), 10)
    assert in_map(words, np.arange(1000)).sum() == 10 and in_map(words, np.array([900]))[0]


# 5 and 1


def _brute(texts, frequent, runs, power, least):
    """Pairs (i < j) of texts whose vectors have the cosine, from the product of all vectors with all."""
    t, d = terms.distinct(*terms.grams(texts, runs))
    w = frequent.idf(t).astype(float) ** power + 1e-6
    norms = np.sqrt(np.bincount(d, w**2, minlength=len(texts)))
    values, column, n = np.unique(t, return_inverse=True, return_counts=True)
    shared = n[column] > 1
    place = np.cumsum(n > 1) - 1
    x = np.zeros((len(texts), int((n > 1).sum())), np.float32)
    x[d[shared], place[column[shared]]] = w[shared] / norms[d[shared]]
    i, j = np.nonzero(np.triu(x @ x.T, 1) >= least)
    return set(zip(i.tolist(), j.tolist()))


@pytest.fixture(scope="module")
def small(tiny):
    return tiny.replace("sf0.001", "sf0.01")


def test_near_copies_against_brute_force(spark, small):
    rows = pd.read_parquet(f"{small}/routing_cases.parquet").drop_duplicates("case_id").dropna(subset=["text"])
    docs = frame(spark, list(zip(rows.case_id.tolist(), rows.text.tolist())), "doc long, text string")
    kept = Kept(spark)
    _, later, _, frequent = collapsed(distinct_contents(docs, kept)[2], near_copies.RUNS, kept, near_copies.RARE, near_copies.FEW)
    frequent, keys = frequent.value, rows.case_id.tolist()
    want = {(r["first"], r["content"]) for r in later.collect()} | {(keys[i], keys[j]) for i, j in _brute(rows.text.tolist(), frequent, near_copies.RUNS, near_copies.POWER, near_copies.COSINE)}
    members, links = near_copies.near_copies(docs, Kept(spark))
    got = {r["doc"]: r["group"] for r in members.collect()}
    closed = groups_of(want)
    assert all(closed[x] == closed[g] for x, g in got.items())
    found = [p for p in want if p[0] in got and got[p[0]] == got.get(p[1])]
    assert len(found) >= 0.95 * len(want)
    assert links.where("a = b").count() == 0


def test_a_hot_text_gives_one_class(spark):
    same = [(i, "Please explain the Dekoga rule 4417 again") for i in range(400)]
    near = [(1000 + i, f"please EXPLAIN the Dekoga rule, 4417 again{' thanks' if i % 2 else '!'}") for i in range(40)]
    other = [(2000 + i, " ".join(f"word{(i * 31 + j * 17) % 997}x{j}" for j in range(9))) for i in range(60)]
    members, _ = near_copies.near_copies(frame(spark, same + near + other, "doc long, text string"), Kept(spark))
    rows = members.collect()
    assert {r["group"] for r in rows} == {0} and len(rows) == 440


def test_overlaps_are_all_between_splits_and_equal_brute_force(spark, small):
    rows = Q._split_rows(spark, small).drop("split", "source").dropDuplicates(["doc"])
    got = {(r["train"], r["held"]) for r in overlap.split_overlaps(rows, Kept(spark)).collect()}
    p = rows.where("held is not null and text is not null").toPandas()
    kept = Kept(spark)
    texts = distinct_contents(rows.where("text is not null"), kept, "tab int, held boolean")[2]
    frequent = collapsed(texts, overlap.RUNS, kept, overlap.RARE, overlap.FEW, "tab int, held boolean")[3].value
    near = _brute(p.text.tolist(), frequent, overlap.RUNS, overlap.POWER, overlap.COSINE)
    doc, tab, held = p.doc.tolist(), p.tab.tolist(), p.held.tolist()
    want = {(doc[i], doc[j]) if held[j] else (doc[j], doc[i]) for i, j in near if tab[i] == tab[j] and held[i] != held[j]}
    # of texts with equal common wording only the first is compared, so a few pairs of the others differ
    assert len(got - want) <= 0.02 * len(want) and len(want - got) <= 0.01 * len(want) and len(want) > 100
    counts = {r["held"]: r["pairs"] for r in overlap.overlap_counts(rows, Kept(spark)).collect()}
    assert counts == Counter(h for _, h in got)


def test_no_overlap_of_the_verdict_is_lost(spark, small):
    rows = Q._split_rows(spark, small).drop("split", "source").dropDuplicates(["doc"]).where("tab = 0 and text is not null")
    p = rows.toPandas().sort_values("doc")
    p["held"] = [i % 2 == 1 for i in range(len(p))]
    # copies of which a third of the words are misspelt: rare words outweigh what the two texts share
    rng = np.random.RandomState(3)
    edited = [" ".join(w + "qz%d" % rng.randint(10**6) if rng.rand() < 0.3 else w for w in t.split()) for t in p.text]
    p = pd.concat([p, p.assign(doc=p.doc + 10**9, held=~p.held, text=edited)])
    docs = frame(spark, list(zip(p.doc.tolist(), p.tab.tolist(), p.held.tolist(), p.text.tolist())), "doc long, tab int, held boolean, text string")
    got = {(r["train"], r["held"]) for r in overlap.split_overlaps(docs, Kept(spark)).collect()}
    kept = Kept(spark)
    _, later, _, frequent = collapsed(distinct_contents(docs, kept, "tab int, held boolean")[2], overlap.RUNS, kept, overlap.RARE, overlap.FEW, "tab int, held boolean")
    near = _brute(p.text.tolist(), frequent.value, overlap.RUNS, 1.75, 0.4401)
    apart = {r["content"] for r in later.collect()}
    doc, held = p.doc.tolist(), p.held.tolist()
    want = {(doc[i], doc[j]) if held[j] else (doc[j], doc[i]) for i, j in near if held[i] != held[j]}
    assert len(want) > 500 and not [w for w in want - got if w[0] not in apart and w[1] not in apart]


def test_postings_hold_the_first_common_term():
    rng = np.random.RandomState(1)
    for _ in range(50):
        vocabulary = np.sort(mixed(30))
        steps = dict(zip(vocabulary.tolist(), rng.randint(4096, 9 * 4096, 30)))
        two = [np.sort(rng.choice(vocabulary, 12, replace=False)) for _ in range(2)]
        t, d = np.concatenate(two), np.repeat([0, 1], 12)
        s = np.array([steps[x] for x in t.tolist()], np.uint16)
        pt, pd_, pw, pn, after = overlap.prefixes(t, d, s, overlap.COSINE)
        full = overlap.weighed(s)
        v = [dict(zip(t[d == i].tolist(), (full[d == i] / np.linalg.norm(full[d == i])).tolist())) for i in (0, 1)]
        dot = sum(v[0][x] * v[1].get(x, 0) for x in v[0])
        posted = [dict(zip(pt[pd_ == i].tolist(), zip(pw[pd_ == i].tolist(), pn[pd_ == i].tolist(), after[pd_ == i].tolist()))) for i in (0, 1)]
        common = [x for x in posted[0] if x in posted[1] and posted[0][x][1] * posted[1][x][1] >= overlap.COSINE]
        partial = sum(posted[0][x][0] * posted[1][x][0] for x in common)
        assert dot <= partial + overlap.COSINE + 1e-6
        for x in common:  # what comes after a common term is bounded by sums times greatest weights
            rest = sum(v[0][y] * v[1].get(y, 0) for y in v[0] if (-steps[y], y) > (-steps[x], x))
            assert rest <= posted[0][x][2] * posted[1][x][0] + 1e-6 and rest <= posted[1][x][2] * posted[0][x][0] + 1e-6


def _edited(rng, text):
    words = text.split()
    words[rng.randint(len(words))] = f"typo{rng.randint(10**6)}"
    return " ".join(words)


def test_results_do_not_depend_on_the_files_layout(spark):
    rng = np.random.RandomState(5)
    base = [" ".join(f"w{rng.randint(3000)}" for _ in range(12)) for _ in range(150)]
    texts = base + [_edited(rng, t) for t in base[:60]] + base[:30] + [base[0]] * 100
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += rows[:20]
    seen = set()
    for parts in (1, 16, 200):
        members, links = near_copies.near_copies(frame(spark, rows, "doc long, text string").repartition(parts), Kept(spark))
        docs = frame(spark, [(i, 0, i % 3 == 0, t) for i, t in rows], "doc long, tab int, held boolean, text string").repartition(parts)
        pairs = overlap.split_overlaps(docs, Kept(spark)).select("train", "held").collect()
        seen.add((tuple(sorted(map(tuple, members.collect()))), tuple(sorted((r["a"], r["b"]) for r in links.collect())), tuple(sorted(map(tuple, pairs)))))
    assert len(seen) == 1
    members, _, pairs = seen.pop()
    assert len({m[0] for m in members}) == len(members) and len(set(pairs)) == len(pairs) > 2000


def test_a_third_of_all_rows_may_be_versions_of_one_text(spark):
    """Each version has a misspelling of its own, at any place; all are one group, and all pairs across splits are found."""
    rng = np.random.RandomState(8)
    text = " ".join(f"own{j}" for j in range(20))
    other = [" ".join(f"w{rng.randint(4000)}" for _ in range(15)) for _ in range(600)]
    rows = [(i, _edited(rng, text)) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(other)]
    members, links = near_copies.near_copies(frame(spark, rows, "doc long, text string"), Kept(spark))
    assert {(r["doc"], r["group"]) for r in members.collect()} == {(i, 0) for i in range(300)}
    assert links.count() < 300 * 4  # not all pairs of versions
    docs = frame(spark, [(i, 0, i % 2 == 0, t) for i, t in rows], "doc long, tab int, held boolean, text string")
    got = {(r["train"], r["held"]) for r in overlap.split_overlaps(docs, Kept(spark)).collect()}
    assert got == {(i, j) for i in range(1, 300, 2) for j in range(0, 300, 2)}
    counts = {r["held"]: r["pairs"] for r in overlap.overlap_counts(docs, Kept(spark)).collect()}
    assert counts == {j: 150 for j in range(0, 300, 2)}


def _versions_with_own_words():
    """Versions of one text with three words of their own each; texts of three such words; and texts that make the common words common."""
    rng = np.random.RandomState(4)
    common = [f"c{j}" for j in range(9)]
    versions = [" ".join([*common, *(f"u{i}x{k}" for k in range(3))]) for i in range(60)]
    own = [" ".join([*(f"u{i}x{k}" for k in range(3)), f"z{i}"]) for i in range(60)]
    other = [" ".join([*rng.permutation(common)[:4], *(f"o{i}x{k}" for k in range(8))]) for i in range(100)]
    return versions, own, other


def test_overlaps_of_later_versions_are_found(spark):
    """A version's own words are what it shares with another text, which the first of its common wording hasn't."""
    versions, own, other = _versions_with_own_words()
    rows = [(i, 0, i >= 40, t) for i, t in enumerate(versions)] + [(1000 + i, 0, i < 40, t) for i, t in enumerate(own)]
    rows += [(2000 + i, 0, i % 2 == 0, t) for i, t in enumerate(other)]
    docs = frame(spark, rows, "doc long, tab int, held boolean, text string")
    got = [(r["train"], r["held"]) for r in overlap.split_overlaps(docs, Kept(spark)).collect()]
    assert len(got) == len(set(got))
    want = {(i, j) for i in range(40) for j in range(40, 60)} | {(i, 1000 + i) for i in range(40)} | {(1000 + i, i) for i in range(40, 60)}
    assert set(got) == want
    counts = {r["held"]: r["pairs"] for r in overlap.overlap_counts(docs, Kept(spark)).collect()}
    assert counts == Counter(h for _, h in got)


def _alike_by_one_word(n):
    """Texts that share single rare words with others and nothing else, and every tenth with a near copy on the other side."""
    rows = []
    for i in range(n):
        own = " ".join([*(f"w{i}x{j}" for j in range(6)), f"hub{i % 120}", f"bub{i * 7 % 121}"])
        rows += [(2 * i, 0, i % 2 == 1, f"{own} tub{i * 11 % 119}")] + ([(2 * (n + i), 0, i % 2 == 0, f"{own} other{i}")] if i % 10 == 0 else [])
    return rows


def test_pairs_of_one_word_are_told_where_they_meet(spark, monkeypatch):
    """Pairs that share a rare word, whose number is the square of the corpus's, aren't shuffled or kept."""
    kept, real = [], Kept.__call__

    def call(self, df, name="t"):
        table = real(self, df, name)
        kept.extend([table.count()] if name == "candidates" else [])
        return table

    monkeypatch.setattr(Kept, "__call__", call)
    docs = frame(spark, _alike_by_one_word(600), "doc long, tab int, held boolean, text string")
    found = {frozenset((r["train"], r["held"])) for r in overlap.split_overlaps(docs, Kept(spark)).collect()}
    assert found == {frozenset((2 * i, 2 * (600 + i))) for i in range(0, 600, 10)}
    assert 60 <= sum(kept) <= 120


def test_rounds_give_the_same_overlaps(spark, small, monkeypatch):
    rows = Q._split_rows(spark, small).drop("split", "source")
    one = sorted(overlap.split_overlaps(rows, Kept(spark)).collect())
    for name, value in (("ROUND", 100), ("PARTS_ROUND", (100, 0.0)), ("TEXTS_ROUND", (40, 0.0))):
        monkeypatch.setattr(overlap, name, value)
    several = sorted(overlap.split_overlaps(rows, Kept(spark)).collect())
    assert [r[:3] for r in several] == [r[:3] for r in one] and len(one) > 100
    assert [r[3] for r in several] == pytest.approx([r[3] for r in one])


@pytest.mark.parametrize("longest", [5, 60, 400])
def test_a_sketch_never_tells_too_little(spark, longest):
    """The bound is at least the cosine, also of texts with so many terms that these share bits."""
    rng = np.random.RandomState(longest)
    every = rng.randint(1, 1 << 47, 3 * longest).astype(np.uint64) << np.uint64(16)
    idf = np.where(rng.rand(len(every)) < 0.4, 40000, rng.randint(0, 40000, len(every))).astype(np.uint16)
    at = [np.sort(rng.choice(len(every), rng.randint(1, longest + 1), replace=False)) for _ in range(60)]
    docs = np.repeat(np.arange(60), [len(x) for x in at])
    t, s = every[np.concatenate(at)], idf[np.concatenate(at)]
    found = overlap.sketches(t, docs, s, 40000, 60)
    full = np.zeros((60, len(every)))
    full[docs, np.concatenate(at)] = overlap.weighed(s)
    full /= np.linalg.norm(full, axis=1)[:, None]
    a = frame(spark, [(i, *map(int, r)) for i, r in enumerate(found)], "a long, " + ", ".join(f"{x}_a long" for x in overlap.SKETCH))
    b = a.toDF(*(c.replace("_a", "_b") if c != "a" else "b" for c in a.columns))
    bound = overlap._sketched([f"{x}_a" for x in overlap.SKETCH], [f"{x}_b" for x in overlap.SKETCH])
    got = a.crossJoin(b).select("a", "b", bound.alias("bound")).collect()
    assert len(got) == 3600 and all(r["bound"] >= full[r["a"]] @ full[r["b"]] - 1e-9 for r in got)


def test_parts_are_read_as_they_were_written():
    rng = np.random.RandomState(2)
    raw = (rng.randint(1, 256, (40, overlap.PARTS)) * (rng.rand(40, overlap.PARTS) < np.linspace(0, 1, 40)[:, None])).astype(np.uint8)
    offsets, data = overlap._sparse(raw)
    column = pa.Array.from_buffers(pa.binary(), 40, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    assert (overlap._bytes(column) == raw).all() and (overlap._bytes(column.slice(7, 20)) == raw[7:27]).all()
    assert (np.diff(offsets) == overlap.PARTS // 8 + (raw > 0).sum(axis=1)).all()  # a part without terms takes a bit


def test_copies_of_later_versions_are_found(spark):
    """The same for copies: a text that only a later version shares its words with joins the group, and so do two wordings by later ones."""
    versions, own, other = _versions_with_own_words()
    again = [t.replace("c", "d") for t in versions]  # another wording; its versions have the same words of their own
    rows = [(i, t) for i, t in enumerate(versions)] + [(100 + i, t) for i, t in enumerate(again[1:])] + [(1000 + i, own[i]) for i in range(20, 50)]
    rows += [(2000 + 2 * i + j, t) for i, o in enumerate(other) for j, t in enumerate((o, o.replace("c", "d").replace("o", "p")))]
    members, links = near_copies.near_copies(frame(spark, rows, "doc long, text string"), Kept(spark), matches=1)
    groups = {r["doc"]: r["group"] for r in members.collect()}
    assert {groups.get(i) for i in [*range(60), *range(100, 159), *range(1000 + 20, 1000 + 50)]} == {0}
    assert not [d for d in groups if d >= 2000] and links.where("a >= b").count() == 0
    assert links.count() == links.select("a", "b").distinct().count()



def test_equal_wording_needs_most_terms_to_be_common(spark):
    words = [f"c{j}" for j in range(9)]
    rows = [(i, " ".join([*words, f"u{i}"])) for i in range(60)] + [(100 + i, " ".join([*words[:6], f"x{i}", f"y{i}", f"z{i}"])) for i in range(60)]
    texts = frame(spark, rows, "content long, text string")
    _, later, classes, frequent = collapsed(texts, (("words", 1),), Kept(spark), 5000, 20)
    assert {(r["content"], r["first"]) for r in later.collect()} == {(i, 0) for i in range(1, 60)}
    assert {r["first"] for r in classes.collect()} == {0}
    h, _, _ = terms.tokens(["c8", "c0"])
    assert frequent.value.idf(h)[1] == pytest.approx(math.log(61 / 61), abs=2e-4) and frequent.value.idf(h)[0] > 1


def test_a_long_list_is_split_among_tasks(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        packed = int(overlap.packed(np.array([0.5]), np.array([1.0]), np.array([0.1]))[0])
        side = {n: spark.range(0, n, 1, 12).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 10).alias("term"), (F.col("id") + F.lit(10**6)).alias("content"), F.lit(packed).alias("packed")) for n in (60_000, 300)}
        found = overlap.candidates(side[60_000], side[300], 0.2)
        assert found.count() == 20_000 * 100 + 200
        met = side[60_000].join(side[300].withColumnRenamed("content", "b"), "term")
        met.collect()
        assert "skew=true" in met._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_class_links_are_counted_not_paired(spark):
    rng = np.random.RandomState(6)
    text = " ".join(f"w{j}" for j in range(20))
    rows = [(2 * i, text) for i in range(50)] + [(200 + 2 * i, text + " extra") for i in range(7)] + [(400, " ".join(f"v{rng.randint(999)}" for _ in range(9)))]
    members, links = near_copies.near_copies(frame(spark, rows, "doc long, text string"), Kept(spark))
    assert links.count() == 1 and members.count() == 57


def mixed(n):
    return terms.mixed(np.arange(1, n + 1, dtype=np.uint64))


# 2


@pytest.fixture(scope="module")
def spelling():
    words = ["start", "the", "lecture", "dekoga", "integral", "people", "step", "response"] * 50 + ["слово", "число"] * 30 + ["μετρον", "τεχνη"] * 30
    counts = {}
    for g, n in zip(*disguise.ngram_counts(words)):
        counts["".join(chr(int(g) >> (16 * b) & 0xFFFF) for b in reversed(range(disguise.ORDER)))] = int(n)
    return disguise.Spelling(counts)


@pytest.mark.parametrize(
    "text, plain",
    [
        ("the \u0455t\u0435\u0440", "the step"), ("\uff53\uff54\uff45\uff50 \uff11\uff12", "step 12"), ("ste\u200bp", "step"), ("the\u2007lecture", "the lecture"),
        ("re\u0301sponse", "r\u00e9sponse"), ("\ufb01rst", "first"), ("\u2f00步", "一步"), ("\uf967", "不"), ("ste\u00adp", "step"), ("the\u3000step", "the step"),
        ("p\u0435ople", "people"), ("st\u200dep", "step"), ("l\u0435\u0441ture", "lecture"),
    ],
)
def test_disguised_texts_come_out_plain(spelling, text, plain):
    assert disguise.consistent(text, spelling) == (plain, True)


@pytest.mark.parametrize("text", ["слово 和 число", "the word μετρον", "x²＋½ → ε, α ≤ 2", "👩‍🏫 said: 15 % — hm…", "44Δx µm", "步。，？！（是）", "a\tb\nc", "", "naïve façade"])
def test_ordinary_texts_stay(spelling, text):
    assert disguise.consistent(text, spelling) == (text, False)


def test_plain_texts_keep_nulls_and_extra_columns(spark):
    rows = frame(spark, [(1, None, "x"), (2, "", "y"), (3, "ste\u200bp", "z"), (3, "ste\u200bp", "z"), (4, "a" * 200_000 + "\uff42", None)], "id long, text string, plain string")
    got = sorted((r["id"], r["disguised"], None if r["plain"] is None else len(r["plain"])) for r in disguise.plain_texts(rows, ["id"]).collect())
    assert got == [(1, False, None), (2, False, 0), (3, True, 4), (3, True, 4), (4, True, 200_001)]


# 3


def _targets(spark, shares, field="skill", least=2, rate=0.5):
    rows = [(i, field, v, s, least, rate) for i, (v, s) in enumerate(shares.items(), 1)]
    return frame(spark, rows, "target_id long, field string, value string, target_share double, min_rows long, sample_rate double")


def test_sample_has_the_shares_and_reports_what_lacks(spark):
    rows = [(i, "A b") for i in range(600)] + [(1000 + i, "c_d ") for i in range(300)] + [(2000, "tiny"), (2000, "tiny"), (3000, None), (3001, "unknown"), (None, "tiny")]
    sample, report = sampling.sample_to_targets(frame(spark, rows, "key long, skill string"), "key", ["skill"], _targets(spark, {"a-b": 0.5, "C-D": 0.375, "tiny": 0.125}), Kept(spark))
    got = {r["value"]: r for r in report.collect()}
    assert (got["a-b"]["available"], got["c-d"]["available"], got["tiny"]["available"]) == (600, 300, 1)
    assert got["tiny"]["unmet"] and got["tiny"]["wanted"] == 56 and not got["a-b"]["unmet"]
    assert got["tiny"]["sampled"] == 1
    counts = {r["skill"]: r["count"] for r in sample.groupBy("skill").count().collect()}
    assert counts["a-b"] == pytest.approx(225, abs=1) and sum(counts.values()) == sample.select("key").distinct().count()


def test_rake_meets_two_margins():
    counts = {(a, b): 1000 for a in "xy" for b in "pqr"}
    want = sampling.rake(counts, [{"x": 0.75, "y": 0.25}, {"p": 0.5, "q": 0.25, "r": 0.25}], 400)
    assert sum(v for (a, _), v in want.items() if a == "x") == pytest.approx(300, rel=1e-6)
    assert sum(v for (_, b), v in want.items() if b == "p") == pytest.approx(200, rel=1e-6)
    assert sampling.rake({}, [{}], 5) == {}


def test_draw_is_by_exponential_keys_of_rows(spark):
    # rates give each row of a cell its raked probability, so one draw over all cells meets the shares
    rows = [(i, "a" if i % 10 < 7 else "b") for i in range(20_000)]
    sample, report = sampling.sample_to_targets(frame(spark, rows, "key long, skill string"), "key", ["skill"], _targets(spark, {"a": 0.25, "b": 0.75}, rate=0.25), Kept(spark))
    counts = {r["skill"]: r["count"] for r in sample.groupBy("skill").count().collect()}
    assert sum(counts.values()) == pytest.approx(5000, abs=60) and counts["a"] >= 1250 and counts["b"] == pytest.approx(3750, abs=60)
    low = sample.where("skill = 'a' and key < 10000").count()
    assert low == pytest.approx(counts["a"] / 2, abs=90)  # no part of the cell is preferred
    again, _ = sampling.sample_to_targets(frame(spark, rows[::-1], "key long, skill string").repartition(7), "key", ["skill"], _targets(spark, {"a": 0.25, "b": 0.75}, rate=0.25), Kept(spark))
    assert {r["key"] for r in again.collect()} == {r["key"] for r in sample.collect()}


def test_repairs_raise_minimums_and_give_up_surplus():
    have = {("a",): 100, ("b",): 100, ("c",): 3}
    got = sampling.repaired(have, {("a",): 60, ("b",): 40, ("c",): 0}, {("a",): 50.0, ("b",): 50.0, ("c",): 1.0}, [{"a": 10, "b": 45, "c": 3}], 100)
    assert got == {("a",): 50, ("b",): 45, ("c",): 3} or (got[("b",)] >= 45 and got[("c",)] == 3 and 98 <= sum(got.values()) <= 105)
    assert sampling.drawn({("a",): {0: 5, 1: 5}, ("b",): {1: 5}}, 10) in ({("a",): 8, ("b",): 2}, {("a",): 7, ("b",): 3})
    assert sampling.drawn({}, 4) == {}


# 4


def test_topic_keys():
    assert topic_groups.topic_keys("“Dekoga  Rule.”") == topic_groups.topic_keys("ｄｅｋｏｇａ_rule") == topic_groups.topic_keys("《dekoga rule》") == ["dekogarule"]
    assert topic_groups.topic_keys("A b & 频谱。") == ["ab", "频谱"] == topic_groups.topic_keys("频​谱；A-B")
    assert topic_groups.topic_keys(None) == topic_groups.topic_keys(" / ") == []


def test_topic_groups_join_by_cells_with_two_topics(spark):
    rows = [
        (1, "Calculus", "limit"), (2, "calculus ", "Limit."), (3, "calculus", "limit / norm"), (4, "calculus", "NORM"), (5, "algebra", "norm"), (6, None, "norm"),
        (7, "calculus", " "), (2, "calculus ", "Limit."), (8, "calculus", "x | y"), (9, "calculus", "y; z"), (10, "calculus", "Z"), (11, "algebra", None),
    ]
    g = topic_groups.topic_groups(frame(spark, rows, "id long, subject string, topic string"), Kept(spark))
    got = {r["id"]: (r["group_id"], r["members"]) for r in g.collect()}
    assert got == {1: (1, 4), 2: (1, 4), 3: (1, 4), 4: (1, 4), 5: (5, 1), 6: (6, 1), 7: (7, 1), 8: (8, 3), 9: (8, 3), 10: (8, 3), 11: (11, 1)}


def test_splits_keep_groups_and_shares(spark, tiny):
    keep = Kept(spark)
    g = topic_groups.topic_groups(Q.table(spark, tiny.replace("sf0.001", "sf0.01"), "topics").select(F.col("topic_id").alias("id"), "subject", "topic"), keep)
    s = topic_groups.assign_splits(g, frame(spark, [("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double"), keep)
    assert s.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    shares = {r["split"]: r["count"] / s.count() for r in s.groupBy("split").count().collect()}
    assert shares["train"] == pytest.approx(0.8, abs=0.05) and s.count() == g.count()


def test_groups_over_several_subjects_are_never_split(spark):
    rows = [(g * 10 + i, f"s{(g + i) % 5}", g * 10, 6) for g in range(200) for i in range(6)] + [(10**6 + i, None, 10**6 + i, 1) for i in range(300)]
    rows += [(2 * 10**6 + i, f"rare{i}", 2 * 10**6, 700) for i in range(700)]
    groups = frame(spark, rows, "id long, subject string, group_id long, members long")
    s = topic_groups.assign_splits(groups, frame(spark, [("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double"), Kept(spark))
    got = s.collect()
    by = {}
    for r in got:
        by.setdefault(r["group_id"], set()).add(r["split"])
    assert len(got) == len(rows) and all(len(x) == 1 for x in by.values())
    n = Counter(r["split"] for r in got)
    assert n["train"] / len(got) == pytest.approx(0.8, abs=0.02) and n["test"] / len(got) == pytest.approx(0.1, abs=0.02)
    subject = {r[0]: r[1] for r in rows}
    for k in range(5):
        mine = [r["split"] for r in got if subject[r["id"]] == f"s{k}"]
        assert mine.count("train") / len(mine) == pytest.approx(0.8, abs=0.05)
    assert topic_groups.assign_splits(groups.limit(0), frame(spark, [("train", 1.0)], "split string, share double"), Kept(spark)).count() == 0


# 6


STOCK = "Show the intermediate lines, not just the last number."
ITEMS = [
    (i, f"The keeper claims that {a} never exceeds {n}. Find the last moment at which {b} could have noticed the {a}. Double the {c} and record what it reads at {n + 13}. {STOCK}")
    for i, (a, b, c, n) in enumerate(
        [("Brisura lattice", "Tovelo", "Makina gate", 5120), ("Glonuris heap", "Pesta", "Rudilo norm", 733), ("Skovara filter", "Nomu", "Zelka loop", 9012), ("Damoxel rule", "Kivu", "Halpo chain", 641)], 1
    )
]


def test_leaks_are_found_and_phrases_are_not(spark):
    whole = "Notes.\n" + ITEMS[0][1].upper() + "\nMore notes."
    edited = "Well, the keepr claims that Glonuris heap never exceeds 733, as we saw. Later: find the last moment at which Pesta could have noticed the Glonuris\nheap!"
    phrase = "The keeper claims that Lomira bound never exceeds 88. Find the last moment at which Ferdo could have noticed the Lomira bound. " + STOCK
    docs = [(1, whole), (2, edited), (3, phrase), (4, None), (5, ""), (6, STOCK * 3), (7, "x " * 100_000 + ITEMS[2][1])]
    got = leaks.leaked(frame(spark, docs, "doc_id long, text string"), frame(spark, [*ITEMS, (9, None), (1, ITEMS[0][1])], "item_id long, text string"), Kept(spark))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 1), (2, 2), (7, 3)}


def test_an_item_under_many_ids_still_leaks(spark):
    copies = [(10 + i, ITEMS[0][1].replace("record", ["record", "note", "log", "write"][i % 4])) for i in range(6)]
    docs = [(1, "Notes.\n" + ITEMS[0][1] + "\nMore notes."), (2, ITEMS[2][1]), (3, STOCK * 3)]
    got = leaks.leaked(frame(spark, docs, "doc_id long, text string"), frame(spark, [*ITEMS, *copies], "item_id long, text string"), Kept(spark))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 1), (2, 3)} | {(1, i) for i, _ in copies}


@pytest.mark.parametrize("versions", [1, 2, 3, 10])
def test_every_version_of_an_item_is_reported(spark, versions):
    words = ["record", "note", "log", "write", "mark", "enter", "store", "state", "list", "print"]
    copies = [(10 + i, ITEMS[0][1].replace("record", words[i]).replace("last", ["last", "first", "next"][i % 3])) for i in range(versions)]
    docs = [(1, "Notes.\n" + ITEMS[0][1]), (2, ITEMS[2][1]), (3, STOCK * 3)]
    got = leaks.leaked(frame(spark, docs, "doc_id long, text string"), frame(spark, [*ITEMS[1:], *copies], "item_id long, text string"), Kept(spark))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(2, 3)} | {(1, i) for i, _ in copies}


def test_leaks_against_brute_force(spark, small):
    """All pairs of documents and items, by runs of own words that both have, as far as a text of plain Python can tell."""
    docs = pd.read_parquet(f"{small}/documents.parquet").dropna(subset=["text"])
    items = pd.read_parquet(f"{small}/heldout_items.parquet").dropna(subset=["text"])
    held = [terms.tokens([t])[0].tolist() for t in items.text]
    df = Counter(g for h in held for g in {tuple(h[i : i + 4]) for i in range(len(h) - 3)})
    found = {}
    own = [{g for g in {tuple(h[i : i + 4]) for i in range(len(h) - 3)} if df[g] <= 2} for h in held]
    index = {}
    for k, gs in enumerate(own):
        for g in gs:
            index.setdefault(g, []).append(k)
    for doc, text in zip(docs.doc_id, docs.text):
        h = terms.tokens([text])[0].tolist()
        hits = Counter(k for g in {tuple(h[i : i + 4]) for i in range(len(h) - 3)} for k in index.get(g, ()))
        found.update({(doc, int(items.item_id.iloc[k])): n / len(own[k]) for k, n in hits.items()})
    sure = {p for p, share in found.items() if share >= 0.5}
    d = frame(spark, list(zip(docs.doc_id.tolist(), docs.text.tolist())), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked(d, frame(spark, list(zip(items.item_id.tolist(), items.text.tolist())), "item_id long, text string"), Kept(spark)).collect()}
    assert len(sure & got) >= 0.97 * len(sure) > 10
    assert all(found.get(p, 0) >= 0.1 for p in got)


# 7


def test_rates_meet_exact_totals_and_lean_to_the_domains():
    own, tokens = np.array([0, 0, 1, 1]), np.array([100.0, 100.0, 50.0, 50.0])
    soft = np.array([[0.9, 0.1], [0.2, 0.8], [0.1, 0.9], [0.6, 0.4]])
    goal, most = np.array([100.0, 200.0]), np.array([1.0, 3.0])
    r = mixing.fit_rates(own, tokens, soft, goal, most)
    assert np.bincount(own, r * tokens) == pytest.approx(goal) and (r >= 0).all() and (r <= most[own] + 1e-9).all()
    flat = mixing.fit_rates(own, tokens, soft, goal, most, steps=0)
    assert np.abs((r * tokens) @ soft - goal).sum() < np.abs((flat * tokens) @ soft - goal).sum()
    short = mixing.fit_rates(own, tokens, soft, np.array([100.0, 500.0]), most)
    assert (short[own == 1] == 3.0).all()
    assert len(mixing.fit_rates(own[:0], tokens[:0], soft[:0], goal, most)) == 0


def test_mixture_meets_weights_or_says_who_falls_short(spark):
    rng = np.random.RandomState(0)
    docs = [(i, s, f"{s} text number {i} " + "word " * int(rng.randint(20, 60))) for i, s in enumerate(["big"] * 300 + ["small"] * 30 + ["rare"] * 3)]
    docs += [(900, None, "no source"), (901, "other", "unlisted"), (902, "big", None), (903, "big", "")]
    targets = frame(spark, [("big", 0.6, 1), ("small", 0.3, 4), ("rare", 0.1, 2), ("none", 0.0, 1)], "source string, weight double, max_repeats int")
    copies, report = mixing.mix(frame(spark, docs, "doc_id long, source string, text string"), targets, Kept(spark))
    got = {r["source"]: r for r in report.collect()}
    assert [s for s in got if got[s]["short"]] == ["rare"]
    assert got["big"]["actual_tokens"] == pytest.approx(got["big"]["needed"], rel=0.1)
    assert got["small"]["actual_tokens"] == pytest.approx(got["small"]["needed"], rel=0.15)
    assert copies.where("(source = 'rare' and copies > 2) or (source = 'big' and copies > 1) or doc_id in (900, 901)").count() == 0


# 8


def test_masked_spellings_are_undone():
    assert abuse.passages("you i-d-i-o-t. $h1th3@d!\n贱*人，s​tupid") == ["you idiot.", "shithead!", "贱人，stupid"]
    assert abuse.passages("One 3.5, 4x. Stop! What?五。六；a\n\nb 48Δx") == ["One 3.5, 4x.", "Stop!", "What?", "五。", "六；", "a", "b 48Δx"]
    assert abuse.passages("") == abuse.passages(" \n ") == [] and len(abuse.passages("x" * 300_000)) == 1


def test_scorer_finds_passages_that_it_was_not_fitted_on():
    rng = np.random.RandomState(0)
    calm = ["Review pages %d of the notes.", "Log each slip with its cause and date %d.", "Step %d: swap the filter and watch the sign.", "The rules say that words such as %d get a post hidden."]
    bad = ["You complete idiot, nobody wants your trash questions %d.", "Shut up you pathetic loser number %d.", "Those people breed like rats, wipe them out %d."]

    def doc(toxic):
        parts = [calm[rng.randint(4)] % rng.randint(999) for _ in range(8)]
        if toxic:
            parts.insert(rng.randint(8), bad[rng.randint(3)] % rng.randint(999))
        return "\n".join(parts)

    model = abuse.fit([doc(True) for _ in range(60)], [doc(False) for _ in range(120)], [doc(rng.rand() < 0.05) for _ in range(200)])
    yes, no = model.scores([doc(True) for _ in range(100)]), model.scores([doc(False) for _ in range(200)])
    assert (yes >= model.threshold).mean() > 0.95 and (no >= model.threshold).mean() < 0.03


def test_scores_of_held_out_reviewed_documents():
    path = Path("/root/testdata/sf0.1")
    if not path.exists():
        pytest.skip("no test tables")
    d = pd.read_parquet(path / "documents.parquet")[["doc_id", "text"]]
    v = pd.read_parquet(path / "review_labels.parquet").dropna(subset=["toxic"]).groupby("doc_id").toxic.mean()
    d = d[d.text.fillna("").str.len() > 0]
    label = d.doc_id.map(v)
    toxic, other, free = d[label > 0.5].text.tolist(), d[label < 0.5].text.tolist(), d[label.isna()].text.tolist()[:2000]
    model = abuse.fit(toxic[::2], other[::2], free)
    a, b = model.scores(toxic[1::2]), model.scores(other[1::2])
    assert (a[:, None] > b[None, :]).mean() > 0.7  # a quarter of the verdicts are wrong
    assert (b >= model.threshold).mean() < 0.05
    # passages of the other half, put into harmless documents
    every = abuse.fit(toxic, other, free)
    found = []
    for text in toxic[1::2]:
        parts = abuse.passages(text)
        scores = every.scores(parts)
        found += [parts[i] for i in np.flatnonzero(scores >= 0.6)]
    calm = [t for t, s in zip(other[1::2], b) if s < 0.05]
    told = [f"{t}\n{p}\n{t[:50]}" for p, t in zip(found, calm * (len(found) // len(calm) + 1))]
    assert len(found) > 30 and (model.scores(told) >= model.threshold).mean() >= 0.5  # from 63 verdicts, a quarter of them wrong


# odd inputs for all

EMPTY = {
    "routing_cases": "case_id long, text string, skill string, category string, split string, source string, doc long, tab string, held string, label string",
    "diagnosis_cases": "case_id long, text string, label string, category string, split string, source string, plain string",
    "subject_cases": "id string, subject string, key string, u string",
    "smoke": "case_no long, id string, rubric string, text string, content string, group string",
    "topics": "topic_id long, subject string, topic string, id string, group_id string, members string",
    "documents": "doc_id long, text string, lang string, source string, kind string, h string, toxic string, tokens string",
    "review_labels": "doc_id long, toxic int, kind string",
    "heldout_items": "item_id long, text string, share string",
    "sample_targets": "target_id long, tab string, field string, value string, target_share double, min_rows long, sample_rate double",
    "mix_targets": "source string, weight double, max_repeats int",
    "split_targets": "split string, share double",
}


def _write(spark, where, rows):
    for t, schema in EMPTY.items():
        spark.createDataFrame(rows.get(t, []), schema).coalesce(1).write.parquet(f"{where}/{t}.parquet")
    return str(where)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(spark, tmp_path_factory, name):
    where = test_empty_tables.__dict__.setdefault("where", tmp_path_factory.mktemp("empty") / "t")
    if not where.exists():
        _write(spark, where, {})
    assert Q.QUERIES[name](spark, str(where)).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in Q.QUERIES if n.endswith("_found")))
def test_nulls_ties_repeats_and_long_texts(spark, tmp_path_factory, name):
    where = test_nulls_ties_repeats_and_long_texts.__dict__.setdefault("where", tmp_path_factory.mktemp("odd") / "t")
    long = "long text 77 " * 20_000
    if not where.exists():
        cases = [(i, t, s, s, sp, None, None, "x", None, None) for i, (t, s, sp) in enumerate([(None, None, None), ("", "", "train"), ("same text 12 here", "A", "train"), ("same text 12 here", "a ", "test"), (long, "a", "train"), (long, "a", "test")])]
        cases += [cases[2], (None, "no key", "a", "a", "test", None, None, None, None, None)]
        _write(spark, where, {
            "routing_cases": cases, "diagnosis_cases": [(c[0], c[1], c[2], c[3], c[4], None, None) for c in cases], "subject_cases": [("a", None, None, None), ("b", "s", None, None), (None, "s", None, None)],
            "smoke": [(1, None, None, None, None, None), (2, "x", "concept", long, None, None), (3, "x", "?", long + "!", None, None)],
            "topics": [(1, "s", None, None, None, None), (2, None, "t", None, None, None), (3, "s", "t", None, None, None), (3, "s", "t", None, None, None), (4, "S", "T!", None, None, None), (None, "s", "t", None, None, None)],
            "documents": [(1, None, None, None, None, None, None, None), (2, long, "en", "s", None, None, None, None), (3, long, "en", "s", None, None, None, None), (4, "", None, "t", None, None, None, None)],
            "review_labels": [(1, 1, None), (2, None, None), (2, 1, None), (3, 0, None), (3, 1, None), (99, 1, None), (None, 1, None)],
            "heldout_items": [(1, None, None), (2, "", None), (3, "unique wording of item 4512 by Velora", None)],
            "sample_targets": [(1, "routing_cases", "skill", "a", 1.0, 2, 0.5), (2, "subject_cases", "subject", "s", 1.0, 4, 0.5)],
            "mix_targets": [("s", 0.5, 1), ("t", 0.5, 3)], "split_targets": [("train", 0.8), ("test", 0.2)],
        })
    got = [tuple(r) for r in Q.QUERIES[name](spark, str(where)).collect()]
    expected = {
        "p1_found": {("routing_cases", 2, 3), ("routing_cases", 4, 5), ("diagnosis_cases", 2, 3), ("diagnosis_cases", 4, 5)}, "p2_found": set(),
        "p3_found": {(2,)}, "p4_found": {(3, 3), (4, 3)}, "p5_found": {("routing_cases", 2, 3), ("routing_cases", 4, 5), ("smoke", 2, 3)}, "p6_found": set(), "p7_found": {("t",)},
    }
    assert len(got) == len(set(got))
    if name in expected:
        assert set(got) == expected[name]


def test_frequent_of_nothing():
    assert Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0).idf(np.ones(2, np.uint64)).shape == (2,)
