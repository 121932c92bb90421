"""Language identification by error-correcting output codes.

Every language gets a codeword; for every bit of the code a binary classifier over hashed byte n-grams (1 to 3 bytes,
lower-cased, runs of non-letters as blanks) predicts that bit. Decoding weighs the loss of each bit by how often
its classifier was right for the language on the training rows, and takes the codeword with the smallest loss. A text
whose two best codewords nearly tie is flagged as ambiguous.

Fitting uses a documented bound: at most ``SAMPLE`` labelled rows, equally many from each language where there are so
many, drawn by a hash of the id; every drawn text is used whole. Prediction is one pass over whole texts without a
shuffle; the model (``FEATURES`` x code bits) is a few hundred kilobytes whatever the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.streams import unused_name
from govspark.llm.words import bounded_batches, text_buffer

FEATURES = 4096
SAMPLE = 4000
ROUNDS = 150
#: Two best codewords closer than this in probability: ambiguous.
AMBIGUITY = 0.1
UNKNOWN = "und"

_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 256)


def _chunks(bounds: np.ndarray, size: int = 1 << 18, most: int = 256) -> Iterator[tuple[int, int]]:
    at, n = 0, len(bounds) - 1
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1
        to = min(n, max(at + 1, to), at + most)
        yield at, to
        at = to


def gram_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts (texts x FEATURES) of the texts of a byte buffer."""
    n, total = len(bounds) - 1, len(data)
    counts = np.zeros(n * FEATURES, dtype=np.int64)
    base = np.repeat(np.arange(n) * FEATURES, np.diff(bounds))
    letters = _LETTERS[data].astype(np.uint32)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    value = letters
    for size in (1, 2, 3):
        if size > 1:
            value = (value[:-1] << np.uint32(8)) | letters[size - 1 :]
        at = np.arange(total - size + 1)
        inside = at + size <= ends[: len(at)] if total >= size else np.zeros(0, bool)
        hashed = ((value + np.uint32(size << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        counts += np.bincount((base[: len(at)] + hashed)[inside], minlength=n * FEATURES)
    return counts.reshape(n, FEATURES)


def _unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts, scaled to length one."""
    x = np.sqrt(counts, dtype=np.float32)
    length = np.sqrt(counts.sum(axis=1, dtype=np.float64)).astype(np.float32)
    return x / np.maximum(length, 1)[:, None]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse unit vectors: places (uint16) and values (float32) as bytes."""
    for batch in batches:
        data, bounds = text_buffer(pc.utf8_lower(batch.column("_text")))
        places, values = [], []
        for at, to in _chunks(bounds):
            for row in _unit(gram_counts(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])):
                some = np.flatnonzero(row)
                places.append(some.astype(np.uint16).tobytes())
                values.append(row[some].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_lang"), pa.array(places, pa.binary()), pa.array(values, pa.binary())],
            names=["lang", "places", "values"],
        )


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` codewords of +1 / -1. Up to five languages: every split of them into two sides; more: the best of many
    random codes of 10 log2(n) bits by the least distance of two codewords."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = [[1] + [1 if mask >> i & 1 else -1 for i in range(n - 1)] for mask in range((1 << (n - 1)) - 1)]
        return np.array(columns, dtype=np.float64).T
    random = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, reach = None, -1
    for _ in range(200):
        code = random.choice([-1.0, 1.0], size=(n, width))
        code[:, np.abs(code.sum(axis=0)) == n] *= np.where(np.arange(n) % 2, -1, 1)[:, None]
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if least > reach:
            best, reach = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  #: languages x bits
    trust: np.ndarray  #: languages x bits, rows sum to one
    weights: np.ndarray  #: FEATURES x bits
    bias: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of every codeword (rows x languages): the trusted share of each bit's logistic loss."""
        margin = x @ self.weights + self.bias
        right, wrong = np.logaddexp(0, -margin), np.logaddexp(0, margin)
        plus, minus = self.trust * (self.code > 0), self.trust * (self.code < 0)
        return right @ plus.T + wrong @ minus.T

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, probability, and lead over the second best language of every row."""
        loss = self.losses(x) * self.code.shape[1]
        odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
        odds /= odds.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        top = np.sort(odds, axis=1)
        lead = top[:, -1] - top[:, -2] if top.shape[1] > 1 else np.ones(len(x))
        return best, top[:, -1], lead


def _descend(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions, one per column of ``target`` (+1 / -1), by full-batch Adam."""
    w, b = np.zeros((x.shape[1], target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    for step in range(1, rounds + 1):
        slope = -target * weight / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        for value, grad, first, second in ((w, x.T @ slope + 1e-6 * w, m, v), (b, slope.sum(axis=0), mb, vb)):
            first *= 0.9
            first += 0.1 * grad
            second *= 0.99
            second += 0.01 * grad * grad
            value -= 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w, b


def fit(rows: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model | None:
    """Fit on rows (text, lang, doc_id) with a known language; None if there is none.

    At most ``sample`` rows are used: ``sample / languages`` of each language, drawn by a hash of the id.
    """
    bounded_batches(rows.sparkSession)
    known = rows.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    bound = max(1, sample // len(languages))
    chance = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, bound / counts[lang]))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < chance[F.col("lang")] * (1 << 30)
    bounded = known.where(drawn).select(F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    got = bounded.mapInArrow(_features, "lang string, places binary, values binary").limit(2 * sample).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], r["places"], r["values"]))
    x = np.zeros((len(got), FEATURES), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["places"], np.uint16)] = np.frombuffer(r["values"], np.float32)
    label = np.array([languages.index(r["lang"]) for r in got])
    code = codewords(len(languages))
    target = code[label].astype(np.float32)
    weights, bias = _descend(x, target, 1 / np.bincount(label, minlength=len(languages))[label], rounds)
    right = ((x @ weights + bias) * target > 0).astype(np.float64)
    trust = np.stack([right[label == i].mean(axis=0) if (label == i).any() else np.ones(code.shape[1])
                      for i in range(len(languages))]) + 1e-9
    return Model(languages, code, trust / trust.sum(axis=1, keepdims=True), weights, bias)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1) and lang_ambiguous; a text without a letter is ``und``, score 0.

    Columns of those names in ``docs`` are replaced. Without a model every text is ``und``.
    """
    added = ["lang_pred", "lang_score", "lang_ambiguous"]
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*added)
    names = docs.columns
    source = docs.select("*", F.col(text).alias(unused_name(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(names))
            data, bounds = text_buffer(pc.utf8_lower(column))
            n = len(column)
            best, score, lead = np.zeros(n, int), np.zeros(n), np.zeros(n)
            plain = (data >= 0x61) & (data <= 0x7A)
            seen = np.concatenate([[0], np.cumsum(plain)])[bounds]
            lettered = np.diff(seen) > 0
            for i in np.flatnonzero(~lettered & (np.diff(bounds) > 0)):
                lettered[i] = has_letter(column[int(i)].as_py())
            for at, to in _chunks(bounds) if model else ():
                x = _unit(gram_counts(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]))
                best[at:to], score[at:to], lead[at:to] = model.decode(x)
            known = lettered & (model is not None)
            languages = [*(model.languages if model else []), UNKNOWN]
            pred = np.where(known, best, len(languages) - 1)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[: len(names)],
                pa.array([languages[i] for i in pred], pa.string()),
                pa.array(np.where(known, score, 0.0)),
                pa.array(known & (lead < AMBIGUITY)),
            ], names=[*names, *added])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return source.mapInArrow(run, f"{fields}, lang_pred string, lang_score double, lang_ambiguous boolean")


def held_out(doc_id: str, parts: int, part: int):
    """Whether the CRC-32 of the id as text leaves ``part`` when divided by ``parts``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def is_held_out(doc_id: int, parts: int, part: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % parts == part


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row, learning from the rows that are not held out.

    A null or letterless text gets ``und`` with score 0. A null id counts as not held out. Empty tables and tables
    without any language give ``und`` throughout. Repeated rows are each predicted.
    """
    training = docs.select("doc_id", "text", "lang").where(~held_out("doc_id", 4, 2))
    model = fit(training, sample)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred",
        F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"),
    )


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows whose language is told: those with no letter, or whose two best languages tie, go."""
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out("doc_id", 4, 2)), sample)
    kept = predict(docs, model).where((F.col("lang_pred") != UNKNOWN) & ~F.col("lang_ambiguous"))
    return kept.select(docs.columns)
