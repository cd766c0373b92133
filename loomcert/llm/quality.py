"""Quality from weak labels: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer on the posteriors.

Each labeller votes good, bad or nothing on a text. Texts only matter to the estimation by their pattern of votes, so patterns are
counted over all documents (a table bounded by 3 to the number of labellers), and the estimation runs on the counts. The posteriors of a
bounded sample of rows (`sample`, those with the least hash) train a logistic scorer of hashed words; every text is scored whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import word_hashes
from .util import column, on_executors, thinned, to_batch

SAMPLE = 4000
_SAMPLE = pa.schema([("h", pa.int64()), ("votes", pa.int32()), ("at", pa.list_(pa.int32())), ("weight", pa.list_(pa.float32()))])
DIMENSIONS = 1 << 14
PRIOR = 0.8
_CODE = np.zeros(256, np.uint8)
_CODE[97:123], _CODE[65:91], _CODE[48:58], _CODE[128:] = 1, 2, 3, 1
_CODE[[9, 10, 11, 12, 13, 32]] = 4
_CODE[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 5
_END = re.compile(rb"[.!?]+[\"')\]]*(?:\s|$)")

#: (name, bad above, good up to), by measurement of `measures`; in between a labeller does not vote.
LABELLERS = (
    ("signs", 0.06, 0.02),
    ("capitals", 0.30, 0.10),
    ("digits", 0.15, 0.03),
    ("repeated_lines", 0.30, 0.05),
    ("repeated_words", 0.75, 0.60),
    ("long_words", 0.50, 0.25),
    ("unended", 0.75, 0.40),
    ("shortness", 0.10, 0.05),
)


def measures(t: bytes) -> list[float]:
    """Shares between 0 and 1, each higher in worse text; zeros for an empty one but for the last."""
    n = np.bincount(_CODE[np.frombuffer(t, np.uint8)], minlength=6)
    words = word_hashes(t)
    letters, visible = n[1] + n[2], len(t) - n[4]
    lines = [x for x in t.split(b"\n") if x.strip()]
    share = lambda a, b: float(a / b) if b else 0.0
    sizes = np.diff(np.flatnonzero(np.append(np.append(True, _CODE[np.frombuffer(t, np.uint8)] == 4), True))) - 1
    sizes = sizes[sizes > 0]
    return [
        share(n[0], visible), share(n[2], letters), share(n[3], visible), share(len(lines) - len(set(lines)), len(lines)), 1 - share(len(set(words[:].tolist())), len(words)) if len(words) > 50 else 0.5,
        share((sizes > 9).sum(), len(sizes)), max(0.0, 1 - share(12 * len(_END.findall(t)), len(words))) if len(words) else 0.0, 1 / (1 + len(words)),
    ]


def votes(t: bytes) -> int:
    """The pattern of votes, base 3: 0 nothing, 1 good, 2 bad."""
    pattern = 0
    for x, (_, bad, good) in zip(measures(t), LABELLERS, strict=True):
        pattern = pattern * 3 + (2 if x > bad else 1 if x <= good else 0)
    return pattern


def _cast(patterns: np.ndarray, n: int = len(LABELLERS)) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(n - 1, -1, -1) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(accuracies (labeller, class good or bad, vote), prior of good and bad) by expectation-maximisation of conditionally independent labellers.

    It starts from labellers that are right eight times of ten, and smooths by one vote of each kind.
    """
    v = _cast(patterns)
    one_hot = np.eye(3)[v]
    p = np.tile(np.array([[0.34, 0.53, 0.13], [0.34, 0.13, 0.53]]), (v.shape[1], 1, 1))
    prior = np.array([PRIOR, 1 - PRIOR])
    for _ in range(rounds):
        r = posterior(patterns, p, prior)
        w = counts[:, None] * np.stack([r, 1 - r], 1)
        new = np.einsum("kc,klv->lcv", w, one_hot) + 1
        new /= new.sum(2, keepdims=True)
        prior = (w.sum(0) + 1) / (w.sum() + 2)
        if np.abs(new - p).max() < 1e-7:
            break
        p = new
    return p, prior


def posterior(patterns: np.ndarray, p: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The probability of good for each pattern. Votes of nothing tell nothing."""
    v = _cast(patterns)
    told = np.log(p[np.arange(v.shape[1]), :, v]) * (v > 0)[:, :, None]
    x = told.sum(1) + np.log(prior)
    return 1 / (1 + np.exp(np.clip(x[:, 1] - x[:, 0], -60, 60)))


def hashed(t: bytes, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights of a text's hashed words and measures, of unit length."""
    at, n = np.unique(word_hashes(t) % np.uint64(dimensions - 64), return_counts=True)
    m = [k * 8 + min(7, int(x * 8)) for k, x in enumerate(measures(t))]
    w = np.log1p(n)
    w = np.concatenate([w / max(np.linalg.norm(w), 1e-9), np.full(len(m), 0.5)])
    return np.concatenate([at.astype(np.int64), np.array(m) + dimensions - 64]), w


class Model:
    def __init__(self, accuracies: np.ndarray, prior: np.ndarray, weights: np.ndarray):
        self.accuracies, self.prior, self.weights = accuracies, prior, weights

    def score(self, t: bytes) -> float:
        at, w = hashed(t, len(self.weights) - 1)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ w + self.weights[-1], -30, 30))))


def votes_of(batches):
    for batch in batches:
        yield to_batch(pa.schema([("votes", pa.int32())]), [votes((t or "").encode()) for t in column(batch, "text").to_pylist()])


def sample_of(batches):
    for batch in batches:
        texts = [(t or "").encode() for t in column(batch, "text").to_pylist()]
        x = [hashed(t) for t in texts]
        yield to_batch(_SAMPLE, column(batch, "h"), [votes(t) for t in texts], [a for a, _ in x], [w for _, w in x])


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int, step: float, ridge: float) -> np.ndarray:
    """Weights of a logistic scorer for rows (indices, weights, target), by rounds of adaptive gradient steps in a seeded order."""
    w = np.zeros(DIMENSIONS + 1)
    rng, square = np.random.default_rng(7), np.full(len(w), 1e-6)
    for _ in range(rounds):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            g = 1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30))) - y
            grad = g * x + ridge * w[at]
            np.add.at(square, at, grad**2)
            np.add.at(w, at, -step * grad / np.sqrt(square[at]))
            square[-1] += g * g
            w[-1] -= step * g / np.sqrt(square[-1])
    return w


def trained_of(batches, p: np.ndarray, prior: np.ndarray, rounds: int, step: float, ridge: float):
    """One row, the weights of all rows, which come in the order of h."""
    rows = []
    for batch in batches:
        target = posterior(column(batch, "votes").to_numpy().astype(np.int64), p, prior)
        rows += [(a.values.to_numpy(), w.values.to_numpy().astype(float), y) for a, w, y in zip(column(batch, "at"), column(batch, "weight"), target, strict=True)]
    yield to_batch(pa.schema([("weights", pa.list_(pa.float64()))]), [train(rows, rounds, step, ridge)])


def fit(docs: DataFrame, sample: int = SAMPLE, rounds: int = 40, step: float = 0.5, ridge: float = 1e-4) -> Model:
    """Estimates from all rows of docs (doc_id, text), without any given label, and trains on `sample` of them, in one task of an executor.

    Sampled are rows with an id, not ids; repeated rows count once in training, and each in the estimation.
    """
    text = docs.select(F.col("text").cast("string").alias("text"))
    counted = text.mapInArrow(on_executors("quality", "votes_of"), "votes int").groupBy("votes").agg(F.count("*").alias("n")).toArrow()
    p, prior = estimate(counted.column("votes").to_numpy().astype(np.int64), counted.column("n").to_numpy().astype(float))
    h = F.xxhash64("doc_id", "text").alias("h")
    rows = docs.where("doc_id is not null").select(h)
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    ids = rows.where(thinned(sample, F.lit(n))).distinct().orderBy("h").limit(sample)
    chosen = docs.select(h, F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "h", "left_semi").dropDuplicates(["h"])
    vectors = chosen.mapInArrow(on_executors("quality", "sample_of"), "h long, votes int, at array<int>, weight array<float>").repartition(1).sortWithinPartitions("h")
    got = vectors.mapInArrow(on_executors("quality", "trained_of", p, prior, rounds, step, ridge), "weights array<double>").first()
    return Model(p, prior, np.array(got.weights) if got else np.zeros(DIMENSIONS + 1))


def scores_of(batches, model):
    model = model.value
    schema = pa.schema([("doc_id", pa.int64()), ("weak", pa.float64()), ("score", pa.float64()), ("predicted", pa.int32())])
    for batch in batches:
        texts = [(t or "").encode() for t in column(batch, "text").to_pylist()]
        if texts:
            s = [model.score(t) for t in texts]
            yield to_batch(schema, column(batch, "doc_id"), posterior(np.array([votes(t) for t in texts]), model.accuracies, model.prior), s, [int(x >= 0.5) for x in s])


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of docs (doc_id long, text string): doc_id, weak (posterior of its votes), score (of the trained scorer, 0 to 1, higher: better), predicted (1 from 0.5 on).

    Null texts count as empty. Equal texts have equal results. Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(on_executors("quality", "scores_of", docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, weak double, score double, predicted int")
