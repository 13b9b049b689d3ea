"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import bounded_sample, pieces

#: Weights are kept by this many bits of a feature's hash.
BITS = 20
#: Labelled rows learned from, at most; they are read by one task.
SAMPLE = 12_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0
REMEMBERED = 300_000
_TOKEN = re.compile(r"\w+")
_known: dict[str, int] = {}
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashed(words: list[str]) -> np.ndarray:
    if len(_known) > REMEMBERED:
        _known.clear()
    found = [_known.get(w) for w in words]
    if None in found:
        for i, h in enumerate(found):
            if h is None:
                found[i] = _known[words[i]] = xxhash.xxh64_intdigest(words[i].encode())
    return np.array(found, np.uint64)


def _cell(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _B
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of single words, neighbours, and pairs with one word between, as arrays."""
    split = [_TOKEN.findall(t.lower()) if t else [] for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    h = _hashed([w for s in split for w in s])
    yield owner, _cell(h)
    for gap, salt in ((1, np.uint64(1)), (2, np.uint64(2))):
        if len(h) > gap:
            inside = owner[:-gap] == owner[gap:]
            yield owner[:-gap][inside], _cell((h[:-gap] * _A + h[gap:] + salt)[inside])


class Learner:
    """FTRL-proximal: rates per coordinate, and L1 that keeps rare or idle features at zero."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def bias(self) -> float:
        return -self.bias_z / ((BETA + np.sqrt(self.bias_n)) / ALPHA)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, bias = self.weights(at), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / ALPHA * bias
        self.bias_n += g * g


def fit(rows: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, features and their weights other than zero, from at most ``sample`` rows.

    The sample is chosen and ordered by the hash of key and text, so each run learns the same.
    One task learns it; only weights other than zero come back. Without rows, or with one class
    alone, the bias says so.
    """
    labelled = rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    chosen = bounded_sample(labelled.filter("label IS NOT NULL"), sample)
    ordered = chosen.withColumn("turn", F.xxhash64("doc_id", "text")).repartition(1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, labels, found = [], [], []
        for batch in batches:
            turns += batch.column("turn").to_pylist()
            labels += batch.column("label").to_pylist()
            for t in batch.column("text"):
                found.append(np.unique(np.concatenate([f for _, f in features([t.as_py()])])).astype(np.int32))
        learner = Learner()
        for _ in range(EPOCHS):
            for i in sorted(range(len(turns)), key=lambda i: (turns[i], labels[i])):
                learner.learn(found[i], labels[i])
        w = learner.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(w[at], learner.bias()))], names=["at", "w"]
        )

    got = ordered.mapInArrow(learn, "at bigint, w double").collect()
    bias = sum(r.w for r in got if r.at < 0)
    kept = sorted((r.at, r.w) for r in got if r.at >= 0)
    return bias, np.array([k for k, _ in kept], np.int64), np.array([w for _, w in kept])


def scored(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score``, the probability that the whole text is toxic; no shuffle.

    Each feature counts once a text. NULL and empty texts get the bias alone; equal texts, and
    so repeated rows, equal scores; an empty table gives no rows. What is broadcast has at most
    2**20 weights.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inputs = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("body"))
    schema = inputs.select("row", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, w = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        for batch in batches:
            for first, bodies in pieces(batch, "body"):
                total = np.full(len(bodies), bias)
                found = []
                for owner, cells in features(bodies):
                    hit = np.flatnonzero(dense[cells])
                    found.append((owner[hit] << BITS) + cells[hit])
                once = np.unique(np.concatenate(found))
                np.add.at(total, once >> BITS, dense[once & ((1 << BITS) - 1)])
                score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, len(bodies)), pa.array(score)], names=["row", "score"]
                )

    return inputs.mapInArrow(run, schema).select("row.*", "score")
