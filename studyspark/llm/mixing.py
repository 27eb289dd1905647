"""Mixtures of sources with target weights (problem 7): token counts, predicted domains, rates by projected gradient."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Kept, ship
from .batches import slices
from .terms import grams

#: Rows with a listed source that the domain classifier is fitted on, the longest of them in characters, its hashed features, and steps
#: of its fit.
FIT_ROWS, FIT_LONGEST, FEATURES, FIT_STEPS = 6_000, 20_000, 1 << 13, 60
#: Levels of the greatest posterior that documents are told apart by, and steps of the rates' fit.
LEVELS, STEPS = 20, 400
RUNS = (("words", 1), ("ideographs", 2))


def default_tokenizer() -> str:
    """The path of a public tokenizer's rank file: $STUDYSPARK_TOKENIZER, or the installed byte-level one."""
    return os.environ.get("STUDYSPARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encodings: dict[str, object] = {}
_given: dict[str, set[str]] = {}


def encoding(name: str):
    """The byte-level tokenizer of a rank file that was given to all executors; read once a worker."""
    if name not in _encodings:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[name] = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


@dataclass
class Domains:
    """A multinomial logistic classifier over hashed terms."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, texts: list[str]) -> np.ndarray:
        scores = _scores(*features(texts), len(texts), self.weights) + self.bias
        e = np.exp(scores - scores.max(1, keepdims=True)) if len(texts) else scores
        return e / e.sum(1, keepdims=True)


def _scores(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Sums of weighted rows of ``weights`` by text; ``rows`` are in order."""
    out = np.zeros((n, weights.shape[1]))
    if len(rows):
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        out[rows[first]] = np.add.reduceat(weights[columns] * values[:, None], first)
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed terms, each text's of unit norm: text, feature, value."""
    terms, docs = grams(texts, RUNS)
    columns = (terms % np.uint64(FEATURES)).astype(np.int64)
    norm = np.sqrt(np.bincount(docs, minlength=len(texts)))
    return docs, columns, (1 / norm[docs]).astype(np.float32)


def fit_domains(names: list[str], texts: list[str], labels: list[str]) -> Domains:
    """Gradient descent on the logistic loss, on the driver; with no rows all posteriors are equal."""
    d = Domains(names, np.zeros((FEATURES, len(names)), np.float32), np.zeros(len(names)))
    if not texts:
        return d
    x = np.zeros((len(texts), FEATURES), np.float32)  # FIT_ROWS * FEATURES numbers, 200 MB
    rows, columns, values = features(texts)
    np.add.at(x, (rows, columns), values)
    truth = np.zeros((len(texts), len(names)), np.float32)
    truth[np.arange(len(texts)), [names.index(s) for s in labels]] = 1
    d.bias = np.log(truth.mean(0) + 1e-6)
    for _ in range(FIT_STEPS):
        scores = x @ d.weights + d.bias
        e = np.exp(scores - scores.max(1, keepdims=True))
        d.weights -= 8.0 / len(texts) * (x.T @ (e / e.sum(1, keepdims=True) - truth))
    return d


def project(rates: np.ndarray, tokens: np.ndarray, most: float, total: float) -> np.ndarray:
    """The nearest rates (in the metric of tokens) between 0 and ``most`` whose tokens add up to ``total``, or to the most there can be."""
    if tokens.sum() * most <= total:
        return np.full(len(rates), most)
    low, high = -rates.max(), most - rates.min()
    for _ in range(60):
        shift = (low + high) / 2
        if (np.clip(rates + shift, 0, most) * tokens).sum() < total:
            low = shift
        else:
            high = shift
    return np.clip(rates + high, 0, most)


def fit_rates(own: np.ndarray, tokens: np.ndarray, soft: np.ndarray, goal: np.ndarray, most: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Rates of cells of documents (own source, tokens, mean memberships) by projected gradient.

    Minimises the squares of expected domain totals less their goals, relative to these, over rates between 0 and ``most`` whose
    tokens give each source its goal, or as much of it as there is. Both are constraints of the fit, not repairs of its result.
    """
    rates = np.ones(len(own))

    def projected(r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(r))
        for s in range(len(goal)):
            mine = own == s
            if mine.any():
                out[mine] = project(r[mine], tokens[mine], most[s], goal[s])
        return out

    scale = 1 / np.maximum(goal, max(goal.sum(), 1e-9) * 1e-6)
    m = soft * scale
    bend = np.linalg.norm(m.T @ (m * tokens[:, None]), 2) if len(own) else 0.0
    rates = projected(rates)
    for _ in range(steps if bend > 0 else 0):
        off = (rates * tokens) @ soft * scale - (goal > 0)
        after = projected(rates - m @ off / bend)
        moved = np.abs(after - rates).max()
        rates = after
        if moved < 1e-7:
            break
    return rates


def mix(docs: DataFrame, targets: DataFrame, keep: Kept, tokenizer: str | None = None, steps: int = STEPS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Copies of documents so that each source supplies its weight of all tokens, and a report by source.

    ``docs``: doc_id, source, text; ``targets``: source, weight, max_repeats. Documents with a null or unlisted source are not in
    the mixture, whose size is the tokens of all others; null and empty texts have no tokens. Gives ``copies`` (doc_id, source,
    tokens, rate, copies >= 1) and ``report`` (a row per source: tokens, needed, supply at most, tokens at the fitted rates, expected
    tokens of the domain at these, actual tokens and share, and ``short``: the fitted rates of a source, all at max_repeats, give
    less than it needs).

    1. One pass counts tokens by a public tokenizer, whose file is given to all executors, and predicts each document's domains by
       a classifier that was fitted on a sample of FIT_ROWS labelled rows (the least hashes, so the same at every run).
    2. Rates depend on a document's source, likeliest domain and how likely that is (LEVELS). Tokens and memberships are added up
       once by these cells, of which there are at most LEVELS times the squared number of sources, over all documents.
    3. ``fit_rates`` fits the cells' rates to the expected domain totals under the sources' exact totals. Copies are the whole part
       of the rate, and one more with the probability of the rest, by the document's hash.
    """
    ship(docs.sparkSession)
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    path = tokenizer or default_tokenizer()
    if path not in _given.setdefault(sc.applicationId, set()):
        sc.addFile(path)
        _given[sc.applicationId].add(path)
    file = path.rstrip("/").rsplit("/", 1)[-1]
    plan = {r["source"]: (float(r["weight"] or 0), float(r["max_repeats"] or 0)) for r in targets.where("source is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).collect()}
    names = sorted(plan)
    weight, most = np.array([plan[s][0] for s in names]), np.array([plan[s][1] for s in names])
    listed = docs.where(F.col("source").isin(names)).select("doc_id", "source", "text") if names else docs.limit(0).select("doc_id", "source", "text")
    short_enough = F.length("text").between(1, FIT_LONGEST)
    chosen = listed.where(short_enough).select("doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("h")).orderBy("h").limit(FIT_ROWS)
    sample = listed.where(short_enough).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").select("source", "text").toArrow()
    classifier = sc.broadcast(fit_domains(names, sample["text"].to_pylist(), sample["source"].to_pylist()))
    place = {s: i for i, s in enumerate(names)}
    k = len(names)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(file)
        for part, texts in slices(batches):
            soft = classifier.value.posteriors(texts)
            own = np.array([place[s] for s in part.column("source").to_pylist()], np.int64)
            first = soft.argmax(1)
            level = np.minimum((soft.max(1) * LEVELS).astype(np.int64), LEVELS - 1)
            tokens = pa.array([len(t) for t in enc.encode_ordinary_batch(texts, num_threads=1)], pa.int64())
            flat = pa.FixedSizeListArray.from_arrays(pa.array(soft.astype(np.float32).ravel()), k).cast(pa.list_(pa.float32()))
            columns = [part.column("doc_id"), part.column("source"), tokens, pa.array(((own * k + first) * LEVELS + level).astype(np.int32)), flat]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "tokens", "cell", "soft"])

    kind = dict(docs.dtypes)["doc_id"]
    counted = keep(listed.mapInArrow(measure, f"doc_id {kind}, source string, tokens long, cell int, soft array<float>"), "tokens")
    sums = counted.groupBy("cell").agg(F.sum("tokens").alias("n"), *(F.sum(F.col("tokens") * F.get("soft", F.lit(i))).alias(f"m{i}") for i in range(k)))
    rows = sums.orderBy("cell").toArrow()
    cells, tokens = rows["cell"].to_numpy(), rows["n"].to_numpy().astype(float)
    soft = np.stack([rows[f"m{i}"].to_numpy() for i in range(k)], 1) / np.maximum(tokens, 1)[:, None] if k else np.zeros((0, 0))
    own = cells // (LEVELS * max(k, 1))
    tokens_of = np.bincount(own, tokens, minlength=k)
    total = tokens_of.sum()
    goal = weight * total
    rates = fit_rates(own, tokens, soft, goal, most, steps)
    fitted, expected = np.bincount(own, rates * tokens, minlength=k), (rates * tokens) @ soft
    table = spark.createDataFrame([(int(c), float(r)) for c, r in zip(cells, rates)], "cell int, rate double")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed + 1)), 11).cast("double") + 0.5) / float(1 << 53)
    rated = counted.drop("soft").join(F.broadcast(table), "cell").drop("cell")
    copies = rated.withColumn("copies", (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
    used = {r["source"]: r["n"] for r in copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()}
    actual = sum(used.values())
    report = [
        (s, float(weight[i]), int(most[i]), int(tokens_of[i]), float(goal[i]), float(tokens_of[i] * most[i]), float(fitted[i]), float(expected[i]),
         int(used.get(s, 0)), used.get(s, 0) / actual if actual else 0.0, bool(fitted[i] < goal[i] and (rates[own == i] >= most[i]).all()))
        for i, s in enumerate(names)
    ]
    schema = "source string, weight double, max_repeats int, tokens long, needed double, most double, fitted_tokens double, domain_tokens double, actual_tokens long, actual_share double, short boolean"
    return copies.where("copies > 0"), spark.createDataFrame(report, schema)
