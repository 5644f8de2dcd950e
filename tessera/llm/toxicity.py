"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels.

A document is a bag of sentences (runs between . ! ? and line feeds). A sentence's score is a logistic function of its
distinct words; a word's weight is the sum of the weights of the word itself and of its first 4, 5 and 6 bytes, so
inflected forms share what is learnt. A document's score is 1 - prod(1 - sentence score): one offending sentence is
enough. Only documents have labels; training maximises their likelihood, and the gradient finds the sentences at fault.

Features are hashed to 2**BITS. Those that stand in toxic training documents `lift` times as often as in the others, in
five of them at least, are kept, `kept` at most; they are counted in each task, then by feature. Training rows
are those with a label that the caller allows, of toxic ones about `most` at most and twice as many others, by a
seeded hash of doc_id, weighted by how many there are; the driver gets only the kept features of these bounded bags. All documents are scored,
in one pass without an exchange.

Null and empty texts have no sentences and score 0. Labels other than 0 and 1, null ones and ids with both are left
out. Without labels of both kinds every score is 0. Repeated rows are scored each; of a labelled
id's rows the smallest text is learnt from. A null doc_id is never learnt from.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held, kept_schema, text_bytes, texted, tune, utf8, without
from tessera.llm.quality import clean_labels, one_text, share
from tessera.llm.words import alnum

MOST, KEPT, BITS, LIFT, SEED = 4_000, 4_096, 18, 4.0, 3
#: A sentence without a kept feature scores sigmoid(FLOOR) at most, so that no text is toxic for its length alone.
FLOOR = -10.0
_SENTENCE = re.compile(rb"[^.!?\n]+")


def features(word: bytes) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    size = (1 << BITS) - 1
    out = [zlib.crc32(word) & size]
    for n in (4, 5, 6):
        if len(word) >= n:
            out.append(zlib.crc32(word[:n], n) & size)
    return out


@dataclass
class Bags:
    """Kept features of sentences that have any; sentence -> document; other sentences are counted."""

    feature: np.ndarray
    sentence: np.ndarray
    document: np.ndarray
    bare: np.ndarray
    label: np.ndarray
    weight: np.ndarray


@dataclass
class Model:
    bias: float
    weight: dict[int, float]

    def word(self, word: bytes) -> float:
        w = self.weight
        return sum(w[f] for f in features(word) if f in w)


def train(bags: Bags, kept: int, rounds: int = 400, rate: float = 0.1, penalty: float = 2e-4) -> tuple[float, np.ndarray]:
    """Bias and feature weights by Adam on the noisy-or likelihood."""
    theta = np.zeros(kept + 1)
    theta[-1] = FLOOR
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n_sentences, n = len(bags.document), len(bags.label)
    total = bags.weight.sum()
    soft = lambda z: np.logaddexp(0, z)
    for r in range(1, rounds + 1):
        z = np.bincount(bags.sentence, theta[bags.feature], n_sentences) + theta[-1]
        off = np.bincount(bags.document, soft(z), n) + bags.bare * soft(theta[-1])  # -log(1 - p)
        off = np.maximum(off, 1e-12)
        slope = bags.weight * np.where(bags.label == 1, -1.0 / np.expm1(np.minimum(off, 50)), 1.0) / total
        per = slope[bags.document] / (1 + np.exp(-z))
        g = np.append(np.bincount(bags.feature, per[bags.sentence], kept), per.sum() + (slope * bags.bare).sum() / (1 + np.exp(-theta[-1])))
        g[:-1] += penalty * theta[:-1] / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        theta[-1] = min(theta[-1], FLOOR)
    return float(theta[-1]), theta[:-1]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int = MOST, kept: int = KEPT, lift: float = LIFT, seed: int = SEED) -> Model:
    """allowed: a condition on doc_id; only labels of such rows are read."""
    spark = docs.sparkSession
    tune(spark)
    rows = clean_labels(labels, label).filter(allowed)
    there = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(there) < 2:
        return Model(-np.inf, {})
    drawn = [rows.filter(F.col("y") == y).filter(share(most * (2 - y), there[y], seed)).limit(2 * most * (2 - y)) for y in (0, 1)]
    chosen = drawn[0].unionAll(drawn[1])
    texts = one_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).join(F.broadcast(chosen), "doc_id"), "y").persist()

    def frequency(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def counted(n: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k // 2 for k in n], pa.int32()), pa.array([k % 2 for k in n], pa.int32()), pa.array([*n.values()], pa.int64())], ["feature", "y", "n"])

        n: Counter = Counter()
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                n.update({2 * f + y for w in set(alnum(t.as_py())) for f in features(w)})
                if len(n) > 200_000:
                    yield counted(n)
                    n = Counter()
        yield counted(n)

    found = {r.y: r["count"] for r in texts.groupBy("y").count().collect()}
    if len(found) < 2:
        texts.unpersist()
        return Model(-np.inf, {})
    of = lambda y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0))
    counts = texts.mapInArrow(frequency, "feature int, y int, n long").groupBy("feature").agg(of(1).alias("toxic"), of(0).alias("other"))
    odds = (F.col("toxic") / found[1]) / ((F.col("other") + 0.5) / found[0])
    # 2**BITS rows at most, a few thousand in fact
    rows = counts.withColumn("odds", odds).filter((F.col("odds") >= lift) & (F.col("toxic") >= 5)).collect()
    good = [r.feature for r in sorted(rows, key=lambda r: (-r.odds * r.toxic**0.5, r.feature))[:kept]]
    place = {int(f): i for i, f in enumerate(good)}
    sent = spark.sparkContext.broadcast(place)

    def bag(batches: Iterator) -> Iterator:
        import pyarrow as pa

        place = sent.value
        for b in batches:
            out = [[], []]
            for t in b.column(0):
                bags, bare = [], 0
                for s in _SENTENCE.findall(t.as_py()):
                    found = [place[f] for w in set(alnum(s)) for f in features(w) if f in place]
                    bare += not found
                    if found:
                        bags.append(found)
                out[0].append(bags)
                out[1].append(bare)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.list_(pa.list_(pa.int32()))), pa.array(out[1], pa.int32()), b.column(1)], ["bags", "bare", "y"])

    got = texts.mapInArrow(bag, "bags array<array<int>>, bare int, y int").collect()
    texts.unpersist()
    feature, sentence, document = [], [], []
    for d, r in enumerate(got):
        for s in r.bags:
            feature += s
            sentence += [len(document)] * len(s)
            document.append(d)
    label = np.array([r.y for r in got])
    weight = np.array([there[y] / max(1, (label == y).sum()) for y in (0, 1)])[label]
    as_int = lambda x: np.array(x, np.int64)
    bias, theta = train(Bags(as_int(feature), as_int(sentence), as_int(document), np.array([r.bare for r in got], float), label, weight), len(good))
    return Model(bias, {int(f): float(w) for f, w in zip(good, theta, strict=True) if abs(w) > 1e-3})


class Scorer:
    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most, self.cache = model, most, {}

    def weights(self, words: set[bytes]) -> dict[bytes, float]:
        """The weighted ones of some words."""
        cache = self.cache
        if len(cache) > self.most:
            cache.clear()
        for w in words.difference(cache):
            cache[w] = self.model.word(w)
        return {w: x for w in words if (x := cache[w])}

    def score(self, text: bytes) -> tuple[float, list[tuple[int, int, float]]]:
        """A document's score, and the sentences over one half: byte offsets and score."""
        own = self.weights(set(alnum(text)))
        bias, off, n, worst = self.model.bias, 0.0, 0, []
        if not own:
            n = len(_SENTENCE.findall(text))
        else:
            for m in _SENTENCE.finditer(text):
                found = own.keys() & set(alnum(m[0]))
                if not found:
                    n += 1
                    continue
                z = bias + sum(own[w] for w in sorted(found))
                off += np.logaddexp(0, z)
                if z >= 0:
                    worst.append((m.start(), m.end(), float(1 / (1 + np.exp(-z)))))
        if n and bias > -np.inf:
            off += n * np.logaddexp(0, bias)
        return float(-np.expm1(-off)), worst


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` (doc_id where none are named; none that is made here), score, predicted and offending, the sentences that score one half or
    more: their byte offsets in the UTF-8 text and scores."""
    spark = docs.sparkSession
    tune(spark)
    keep = without(keep, "score predicted offending")
    sent, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = held(("toxicity", name), lambda: Scorer(sent.value))
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            got = [scorer.score(t.as_py()) for t in text_bytes(b, keep)]
            scores = np.array([s for s, _ in got], float)
            offending = [[dict(zip(("begin", "end", "score"), x, strict=True)) for x in w] for _, w in got]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(offending, kind)], [*keep, "score", "predicted", "offending"])

    schema = kept_schema(docs, keep, "score double, predicted int, offending array<struct<begin:int,end:int,score:double>>")
    return texted(docs, keep).mapInArrow(run, schema)
