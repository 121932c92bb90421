"""Quality classifier: naive Bayes support vectors.

A text is the set of its byte n-grams (``GRAMS`` bytes long, case kept, every blank the same), hashed to ``FEATURES``
indicators. Each indicator is scaled by its class log-count ratio, the vector to length one, and a linear hinge-loss
model is fitted by dual coordinate descent. A logistic curve through the margins turns a margin into a score.

Fitting uses a documented bound: at most ``SAMPLE`` labelled rows, half of them from each class where there are so
many, drawn from the labels by a hash of the id; every drawn text is used whole. The drawn ids are the only thing that
is broadcast. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.language import held_out
from govspark.llm.words import BLANK_SEPARATED, bounded_batches, text_buffer

FEATURES = 1 << 15
GRAMS = (1, 2, 3, 4)
SAMPLE = 6000
PENALTY = 1.0
EPOCHS = 30


def _chunks(bounds: np.ndarray, size: int = 1 << 18, most: int = 64) -> Iterator[tuple[int, int]]:
    at, n = 0, len(bounds) - 1
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1
        to = min(n, max(at + 1, to), at + most)
        yield at, to
        at = to


def indicators(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which hashed n-grams each text of a byte buffer has (texts x FEATURES, boolean)."""
    n, total = len(bounds) - 1, len(data)
    flags = np.zeros(n * FEATURES, dtype=bool)
    sizes = np.diff(bounds)
    base, ends = np.repeat(np.arange(n) * FEATURES, sizes), np.repeat(bounds[1:], sizes)
    letters = np.where(BLANK_SEPARATED[data], data, 0x20).astype(np.uint64)
    value = letters
    for size in range(1, max(GRAMS) + 1):
        if total < size:
            break
        if size > 1:
            value = (value[:-1] << np.uint64(8)) | letters[size - 1 :]
        if size in GRAMS:
            count = total - size + 1
            inside = np.arange(count) + size <= ends[:count]
            hashed = ((value + np.uint64(size << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
            flags[(base[:count] + hashed.astype(np.int64))[inside]] = True
    return flags.reshape(n, FEATURES)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each text's indicators, as bytes of uint16."""
    for batch in batches:
        data, bounds = text_buffer(batch.column("_text"))
        sets = []
        for at, to in _chunks(bounds):
            flags = indicators(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            sets += [np.flatnonzero(row).astype(np.uint16).tobytes() for row in flags]
        yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(sets, pa.binary())], names=["label", "places"])


@dataclass
class Model:
    weights: np.ndarray  #: of each indicator, log-count ratio times hinge weight
    squares: np.ndarray  #: squared log-count ratios, for the length of a vector
    bias: float
    slope: float
    offset: float

    def margins(self, flags: np.ndarray) -> np.ndarray:
        values = flags.astype(np.float32)
        return values @ self.weights / np.sqrt(np.maximum(values @ self.squares, 1e-9)) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -50, 50)))


def log_count_ratio(sets: list[np.ndarray], label: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, FEATURES), smooth)
    for places, one in zip(sets, label, strict=True):
        counts[one, places] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(sets: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray,
                            epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and bias (a feature that is always one) for rows of length one."""
    weights, bias = np.zeros(FEATURES), 0.0
    alpha = np.zeros(len(sets))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(sets)):
            slope = sign[i] * (weights[sets[i]] @ values[i] + bias) - 1
            step = min(max(alpha[i] - slope / 2.0, 0.0), cost[i]) - alpha[i]  # squared length: one, plus the bias
            if step:
                alpha[i] += step
                weights[sets[i]] += step * sign[i] * values[i]
                bias += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


def logistic_curve(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, by damped Newton steps; smoothed targets."""
    target = np.where(label == 1, 0.98, 0.02)
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        grad = np.array([(weight * (p - target) * margins).sum(), (weight * (p - target)).sum()])
        c = weight * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(c * margins**2).sum(), (c * margins).sum()], [(c * margins).sum(), c.sum()]])
        change = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        slope, offset = slope - change[0], offset - change[1]
        if np.abs(change).max() < 1e-6:
            break
    return (float(slope), float(offset)) if slope > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1); None without both classes.

    A document with contradictory labels, or without a label of 0 or 1, is not used.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("low"), F.max("quality").alias("high")
    ).where("low = high").select("doc_id", F.col("low").alias("_label"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return None
    bound = max(1, sample // 2)
    chance = F.when(F.col("_label") == 1, min(1.0, bound / counts[1])).otherwise(min(1.0, bound / counts[0]))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < chance * (1 << 30))
    rows = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(drawn.limit(2 * sample)), "doc_id")
    got = rows.select("_text", F.col("_label").cast("int")).mapInArrow(_sets, "label int, places binary").limit(
        4 * sample
    ).collect()
    got.sort(key=lambda r: (r["label"], r["places"]))
    label = np.array([r["label"] for r in got], dtype=np.int64)
    if len(set(label.tolist())) < 2:
        return None
    sets = [np.frombuffer(r["places"], np.uint16).astype(np.int64) for r in got]
    ratio = log_count_ratio(sets, label)
    values = [ratio[s] / max(np.sqrt((ratio[s] ** 2).sum()), 1e-9) for s in sets]
    cost = PENALTY * len(label) / (2 * np.bincount(label, minlength=2))[label]
    weights, bias = dual_coordinate_descent(sets, values, label * 2.0 - 1, cost)
    margins = np.array([weights[s] @ v + bias for s, v in zip(sets, values, strict=True)])
    slope, offset = logistic_curve(margins, label, cost)
    return Model((ratio * weights).astype(np.float32), (ratio**2).astype(np.float32), float(bias), slope, offset)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5) of every row.

    Learns from documents that are not held out (CRC-32 of the id as text modulo 3 is 1). Null and empty texts get the
    score of a text without any n-gram. Repeated rows are each scored; a null id counts as not held out and is never
    learned from. Without both classes every score is 0.5. An empty table gives an empty result; other columns of
    either table are ignored.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select("doc_id", "text")
    model = fit(plain.where(~held_out("doc_id", 3, 1)), labels.select("doc_id", "quality").where(~held_out("doc_id", 3, 1)),
                sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffer(batch.column("_text"))
            scores = np.full(batch.num_rows, 0.5)
            for at, to in _chunks(bounds) if model else ():
                flags = indicators(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
                scores[at:to] = model.scores(model.margins(flags).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = plain.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(
        run, "doc_id long, score double"
    )
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
