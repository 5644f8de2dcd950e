"""Quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

Statistics of a whole text (features.NAMES) are standardised and mapped to cos(Wx + b): with normal W the products of
these features approximate a Gaussian kernel. Each partition sums its share of the normal equations; the sums meet in a
tree, and the driver solves one system of `width` unknowns. Two of three training rows fit the ridge scores; the third
fits the isotonic map from scores to probabilities (pool adjacent violators), so calibration sees scores of rows that
the fit hasn't seen.

Training rows are those with a label that the caller allows; of more than `most` rows, about as many are taken by a
seeded hash of doc_id, so what is sent and collected is bounded. All documents are scored, in one pass without an exchange.

Null and empty texts have zero statistics and are scored as such. Labels other than 0 and 1, and null ones, are left
out; an id with both labels is left out; repeated label rows count once. Where only one label is there, or none, every
score is the smoothed mean of the labels. Repeated document rows are scored
each; of a labelled id's rows the smallest text is learnt from. A null doc_id is never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import kept_schema, text_bytes, texted, tree_sum, tune, utf8, without
from tessera.llm.features import NAMES, statistics

MOST, WIDTH, GAMMA, PENALTY, SEED = 20_000, 384, 0.02, 1e-2, 5


@dataclass
class Fit:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # statistics, width
    shift: np.ndarray
    ridge: np.ndarray  # width + 1
    steps: np.ndarray  # rising scores
    levels: np.ndarray  # their probabilities

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.cos(z @ self.weights + self.shift) * np.sqrt(2 / len(self.shift))
        return np.concatenate([f, np.ones((len(f), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def probability(self, x: np.ndarray) -> np.ndarray:
        if len(self.steps) < 2:
            return np.full(len(x), self.levels[0])
        return np.clip(np.interp(self.raw(x), self.steps, self.levels), 0.0, 1.0)


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising scores and the least-squares rising fit of the labels there; equal scores are one point."""
    at, back = np.unique(score, return_inverse=True)
    w = np.bincount(back, weight)
    y = np.bincount(back, weight * label) / w
    blocks: list[list[float]] = []  # mean, weight, number of points
    for v, u in zip(y, w, strict=True):
        blocks.append([v, u, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, u2, n2 = blocks.pop()
            v1, u1, n1 = blocks[-1]
            blocks[-1] = [(v1 * u1 + v2 * u2) / (u1 + u2), u1 + u2, n1 + n2]
    return at, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def clean_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y in 0, 1: one row an id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2").select("doc_id", "y")


def sample_of(labels: DataFrame, label: str, allowed: Column, most: int, seed: int) -> DataFrame:
    """About `most` labelled ids at most, by a seeded hash: a bounded table, sent whole to every task."""
    rows = clean_labels(labels, label).filter(allowed)
    drawn = rows.filter(share(most, rows.count(), seed)).limit(2 * most)
    return F.broadcast(drawn.select("doc_id", "y", (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(3)) == 0).alias("calibrates")))


def one_text(rows: DataFrame, *facts: str) -> DataFrame:
    """text and facts of rows(doc_id, text, facts...): the smallest text of each id, so an id that repeats without end
    stays one training row. Repeats are dropped in each task before the exchange."""
    return rows.groupBy("doc_id", *facts).agg(F.min("text").alias("text")).select("text", *facts)


def share(wanted: int, there: int, seed: int) -> Column:
    """A condition on doc_id that about `wanted` of so many rows meet: no sort, and the same rows each time."""
    return F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(1, there)))


def _matrix(column) -> np.ndarray:
    return np.array([statistics(t.as_py().decode("utf-8", "replace")) for t in column]).reshape(-1, len(NAMES))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int = MOST, width: int = WIDTH, gamma: float = GAMMA, penalty: float = PENALTY, seed: int = SEED) -> Fit:
    """allowed: a condition on doc_id; only labels of such rows are read."""
    spark = docs.sparkSession
    tune(spark)
    chosen = sample_of(labels, label, allowed, most, seed)
    rows = one_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).join(chosen, "doc_id"), "y", "calibrates")

    def measured(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in _matrix(b.column(0))], pa.binary()), b.column(1), b.column(2)], ["x", "y", "calibrates"])

    # a bounded table of a few numbers a row: kept, so that texts are read once
    table = rows.mapInArrow(measured, "x binary, y int, calibrates boolean").persist()
    p = len(NAMES)
    as_matrix = lambda b: np.frombuffer(b"".join(b.column(0).to_pylist()), float).reshape(-1, p)

    def moments(batches: Iterator) -> Iterator[np.ndarray]:
        for b in batches:
            x = as_matrix(b)
            yield np.concatenate([[len(x), np.sum(b.column(1).to_numpy(zero_copy_only=False))], x.sum(0), (x * x).sum(0)])

    summed = tree_sum(table, _folded(moments))
    n, positive = (summed[0], summed[1]) if summed is not None else (0.0, 0.0)
    flat = Fit(np.zeros(p), np.ones(p), np.zeros((p, 1)), np.zeros(1), np.zeros(2), np.zeros(1), np.array([(positive + 0.5) / (n + 1)]))
    if not 0 < positive < n:
        table.unpersist()
        return flat
    mean = summed[2 : 2 + p] / n
    scale = np.sqrt(np.maximum(summed[2 + p :] / n - mean * mean, 0))
    scale[scale < 1e-9] = 1.0
    r = np.random.default_rng(seed)
    fit = Fit(mean, scale, r.normal(0, np.sqrt(2 * gamma), (p, width)), r.uniform(0, 2 * np.pi, width), np.zeros(width + 1), np.zeros(1), np.zeros(1))
    # each label weighs the same in all, so the rarer one isn't fitted away
    weight = np.array([n / (2 * (n - positive)), n / (2 * positive)])

    def equations(batches: Iterator) -> Iterator[np.ndarray]:
        for b in batches:
            own = ~b.column(2).to_numpy(zero_copy_only=False)
            z, y = fit.features(as_matrix(b)[own]), b.column(1).to_numpy(zero_copy_only=False)[own]
            w = weight[y][:, None]
            yield np.concatenate([(z.T @ (w * z)).ravel(), (z * w).T @ y])

    total = tree_sum(table, _folded(equations))
    gram, right = total[: (width + 1) ** 2].reshape(width + 1, -1), total[(width + 1) ** 2 :]
    fit.ridge = np.linalg.solve(gram + penalty * np.eye(width + 1), right)
    held = table.filter("calibrates").select("x", "y").collect()
    table.unpersist()
    if not held:
        return flat
    scores = fit.raw(np.frombuffer(b"".join(bytes(h.x) for h in held), float).reshape(-1, p))
    fit.steps, fit.levels = isotonic(scores, np.array([h.y for h in held], float), np.ones(len(held)))
    return fit


def _folded(step):
    """The sum of all that a partition yields."""

    def whole(batches: Iterator) -> Iterator[np.ndarray]:
        total = None
        for x in step(batches):
            total = x if total is None else total + x
        if total is not None:
            yield total

    return whole


def score_quality(docs: DataFrame, fit: Fit, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` (doc_id where none are named; not score and predicted, which are made here), score and
    predicted for every row."""
    spark = docs.sparkSession
    tune(spark)
    keep = without(keep, "score predicted")
    sent = spark.sparkContext.broadcast(fit)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            score = sent.value.probability(_matrix(text_bytes(b, keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return texted(docs, keep).mapInArrow(run, kept_schema(docs, keep, "score double, predicted int"))
