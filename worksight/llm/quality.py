"""Quality classification by naive Bayes support vectors.

Features are indicators of byte n-grams, a word that repeats the one before it standing as
a mark of its own. Each is scaled by its class log-count ratio, and a
linear model with hinge loss is fitted to the scaled features by dual coordinate descent.
A logistic curve fitted to labelled rows kept apart turns margins into scores.

Scale: the fit uses a bounded sample of labelled rows, whose features are made on the
executors; the model has a fixed number of weights. Scoring is one pass without shuffle.
"""

from __future__ import annotations

import dataclasses
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import encoded

#: Slots of the hashed features.
SLOTS = 1 << 16
SHIFT = np.uint64(64 - 16)
#: Lengths of n-grams in bytes.
LENGTHS = (1, 2, 3)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


REPEATED = b"\x01"


def marked(text: bytes) -> bytes:
    """The text with REPEATED in place of words that are the same as the word before."""
    words = text.split()
    same = list(map(operator.eq, words[1:], words))
    if not any(same):
        return text
    return b" ".join([words[0], *(REPEATED if s else w for s, w in zip(same, words[1:], strict=True))])


def features(text: bytes) -> np.ndarray:
    """Slots of the n-grams that occur in a text, ascending."""
    present = np.zeros(SLOTS, bool)
    raw = np.frombuffer(marked(text), np.uint8)
    for start in range(0, len(raw), 1 << 20):
        part = raw[start : start + (1 << 20) + max(LENGTHS) - 1].astype(np.uint64)
        for n in LENGTHS:
            if len(part) >= n:
                key = np.full(len(part) - n + 1, n, np.uint64)
                for j in range(n):
                    key = (key << np.uint64(8)) | part[j : len(part) - n + 1 + j]
                present[((key * FACTOR) >> SHIFT).astype(np.int64)] = True
    return np.flatnonzero(present).astype(np.int32)


def packed(at: np.ndarray) -> bytes:
    """Slots as numbers or, where that is shorter, as a bit each: SLOTS / 8 bytes at most."""
    if 2 * len(at) < SLOTS // 8:
        return at.astype(np.uint16).tobytes()
    present = np.zeros(SLOTS, bool)
    present[at] = True
    return np.packbits(present).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))) if len(data) == SLOTS // 8 else np.frombuffer(data, np.uint16).astype(np.int64)


@dataclasses.dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset))), the margin linear in the features."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum() / np.sqrt(max(1, len(at))) + self.bias)

    def score(self, text: bytes) -> float:
        z = self.slope * self.margin(features(text)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def log_count_ratio(rows: list[bytes], labels: np.ndarray, smooth: float) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the smoothed indicator counts p and q of both classes."""
    counts = np.full((2, SLOTS), smooth)
    for data, y in zip(rows, labels, strict=True):
        counts[int(y), unpacked(data)] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(rows: list[bytes], scale: np.ndarray, labels: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights over scaled features and the bias of a hinge-loss linear model.

    Solves min |w|^2 / 2 + sum c_i max(0, 1 - y_i w.x_i) in the dual, one coordinate at a
    time in a fixed pseudo-random order; c_i weighs both classes alike.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([max(1, (y == v).sum()) for v in (-1.0, 1.0)])
    limit = cost * len(y) / (2 * share[(y > 0).astype(int)])
    w, bias = np.zeros(SLOTS), 0.0
    alpha = np.zeros(len(y))
    squares = scale * scale
    norms = np.array([squares[at].sum() / max(1, len(at)) + 1.0 for at in map(unpacked, rows)])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(y)):
            at = unpacked(rows[i])
            value = scale[at] / np.sqrt(max(1, len(at)))
            gradient = y[i] * (w[at] @ value + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * value
                bias += step
                alpha[i] = new
                worst = max(worst, abs(step) * norms[i])
        if worst < 1e-3:
            break
    return w * scale, bias


def calibration(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits labels best, by Newton steps.

    Targets are drawn in a little, as Platt advises, so that separable data stay finite.
    """
    positive, negative = int(labels.sum()), int(len(labels) - labels.sum())
    t = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    at = np.array([1.0, 0.0])
    loss = lambda at: np.logaddexp(0, x @ at).sum() - t @ (x @ at) + 5e-4 * at @ at
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
        gradient = x.T @ (p - t) + 1e-3 * at
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-4 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if abs(size * step).max() < 1e-6:
            break
    return float(at[0]), float(at[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = 5000, cost: float = 1.0, epochs: int = 15) -> Model:
    """Fits the model to rows of docs (doc_id, text) with a label (doc_id, label 0 or 1).

    Of the labelled rows about `sample` are used, chosen by a hash of doc_id, a fifth of
    them for the calibration. Null labels and null texts are no examples; of labels that
    repeat a doc_id the largest counts, of texts that do the one with the least hash. An
    example takes 8 KB at most, however long its text. Without examples of both classes the
    score is the share of label 1, or 0.5; so it is for empty tables. Other columns of both
    tables are ignored.
    """
    wanted = labels.select(F.col("doc_id").cast("long"), F.col("label").cast("int")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    share = max(1, -(-wanted.count() // sample))
    wanted = wanted.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(share)) == 0)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(share)) == 0).join(wanted, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("slots", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [packed(features(t)) for t in encoded(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.binary())], schema=schema)

    found = rows.mapInArrow(run, "doc_id long, label int, slots binary").toArrow()
    examples = sorted(zip(found.column(0).to_pylist(), found.column(2).to_pylist(), found.column(1).to_pylist(), strict=True))
    y = np.array([e[2] > 0 for e in examples], int)
    x = [e[1] for e in examples]
    aside = np.arange(len(y)) % 5 == 4
    both = lambda part: 0 < y[part].sum() < len(y[part])
    if not len(y) or not both(~aside):
        p = float(y.mean()) if len(y) else 0.5
        p = min(max(p, 1e-6), 1 - 1e-6)
        return Model(np.zeros(SLOTS), 0.0, 0.0, float(np.log(p / (1 - p))))
    own = [x[i] for i in np.flatnonzero(~aside)]
    ratio = log_count_ratio(own, y[~aside], 1.0)
    weights, bias = dual_coordinate_descent(own, ratio, y[~aside], cost, epochs)
    model = Model(weights, bias, 1.0, 0.0)
    apart = aside if both(aside) else ~aside
    margins = np.array([model.margin(unpacked(x[i])) for i in np.flatnonzero(apart)])
    model.slope, model.offset = calibration(margins, y[apart])
    return model


def with_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from threshold on).

    Null and empty texts are scored too, by the bias alone; long ones are read in parts of
    1 MB. Every row stands for itself, repeated ones too; empty in, empty out. Other columns
    pass, save those named score or predicted, which are replaced.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield pd.Series([model.score((t or "").encode()) for t in texts], dtype="float64")

    return docs.withColumn("score", score(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
