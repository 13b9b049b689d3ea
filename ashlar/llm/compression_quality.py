"""Quality by compression: how much better text compresses with good text as dictionary than with bad."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import bounded_sample, pieces

#: Texts are compressed in pieces of this many bytes, so that the dictionary, not the text's own
#: beginning, is what helps. All pieces count.
PIECE = 1024
#: Labelled rows of each class for the dictionaries and, apart from these, for the calibration.
SAMPLE = 3_000
#: Pieces that one text gives to a dictionary at most, chosen by hash; and bytes of all of them.
PIECES_A_TEXT, MOST_BYTES = 8, 6 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    bias: float
    empty: float  # the score of a text without bytes


def cut(body: bytes | None) -> list[bytes]:
    return [body[i : i + PIECE] for i in range(0, len(body), PIECE)] if body else []


def dictionary(texts: Sequence[bytes]) -> bytes:
    """A trained dictionary, or the sample itself where it is too small to train one."""
    chosen, size = [], 0
    for body in texts:
        mine = sorted(cut(body), key=lambda p: xxhash.xxh64_intdigest(p))[:PIECES_A_TEXT]
        for p in mine:
            if size + len(p) <= MOST_BYTES:
                chosen.append(p)
                size += len(p)
    if size >= 8 * DICTIONARY_BYTES:
        return zstandard.train_dictionary(DICTIONARY_BYTES, chosen, level=LEVEL, k=512, d=8).as_bytes()
    return b"".join(chosen)[-DICTIONARY_BYTES:]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        def made(data: bytes):
            known = zstandard.ZstdCompressionDict(data) if data else None
            if known:
                known.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
            )

        self.good, self.bad = made(good), made(bad)

    def difference(self, body: bytes | None) -> float | None:
        """Bytes saved by the good dictionary over the bad one, per byte of text; None: no text."""
        if not body:
            return None
        good, bad, saved = self.good.compress, self.bad.compress, 0
        for p in cut(body):
            saved += len(bad(p)) - len(good(p))
        return saved / len(body)


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve, by Newton steps with a small ridge."""
    w = np.zeros(2)
    a = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.array([1e-6, 1e-3])
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(rows: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE, share: float | None = None) -> Model:
    """Dictionaries from one half of a bounded sample of each class, the curve from the other half.

    The sample is chosen, halved and ordered by hashes of key and text. One task per half and
    class reads it. ``share`` is that of good rows where ``rows`` are a sample that does not show
    it. A class without rows has no dictionary; without any rows the score is 0.5.
    """
    labelled = rows.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("body"), F.col(label).cast("int").alias("label"))
    classes = [bounded_sample(labelled.filter(F.col("label") == c), 2 * sample) for c in (0, 1)]
    chosen = classes[0].unionAll(classes[1]).withColumn("turn", F.xxhash64("doc_id", "body"))
    half = F.pmod(F.xxhash64("turn"), F.lit(2))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("turn").to_numpy(), kind="stable")
        made = dictionary([b for b in table.column("body").take(pa.array(order)).to_pylist() if b])
        return pa.table({"label": pa.array([key[0].as_py()], pa.int32()), "d": pa.array([made], pa.binary())})

    got = {r.label: bytes(r.d) for r in chosen.filter(half == 0).groupBy("label").applyInArrow(build, "label int, d binary").collect()}
    good, bad = got.get(1, b""), got.get(0, b"")
    shared = rows.sparkSession.sparkContext.broadcast((good, bad))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Compressors(*shared.value)
        for batch in batches:
            found = [both.difference(b.as_py()) for b in batch.column("body")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column("label")], names=["x", "label"])

    pairs = chosen.filter(half == 1).mapInArrow(measure, "x double, label int").filter("x IS NOT NULL").collect()
    if share is None:
        counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
        total = counts.get(0, 0) + counts.get(1, 0)
        share = counts.get(1, 0) / total if total else 0.5
    x, y = np.array([p.x for p in sorted(pairs)]), np.array([p.label for p in sorted(pairs)], float)
    if len(set(y.tolist())) < 2:
        return Model(good, bad, 0.0, math.log((share + 1e-3) / (1 - share + 1e-3)), share)
    slope, bias = calibrated(x, y)
    # The curve saw as many rows of either class as were sampled; move it to their true shares.
    seen = y.mean()
    bias += math.log(share / (1 - share)) - math.log(seen / (1 - seen))
    return Model(good, bad, slope, bias, share)


def scored(docs: DataFrame, model: Model, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score``, the calibrated probability that the whole text is good; no shuffle.

    NULL and empty texts get the share of good rows; equal texts, and so repeated rows, equal
    scores; an empty table gives no rows. Two dictionaries of 64 KB are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inputs = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("binary").alias("body"))
    schema = inputs.select("row", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        both = Compressors(m.good, m.bad)
        for batch in batches:
            for first, bodies in pieces(batch, "body"):
                found = [both.difference(b) for b in bodies]
                score = [
                    m.empty if d is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * d + m.bias)))) for d in found
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(first, len(bodies)), pa.array(score, pa.float64())], names=["row", "score"]
                )

    return inputs.mapInArrow(run, schema).select("row.*", "score")
