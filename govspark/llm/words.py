"""Words of Arrow text columns as numpy arrays: boundaries, 64-bit hashes, hashes of word runs.

Everything works on slices of about a megabyte of whole texts, so memory does not grow with the batch; only a
single longer text makes a longer slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20

#: Rows and bytes of the batches of whole texts that go to and from Python.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

#: Bytes that belong to a word: all but blank and the controls from tab to carriage return.
BLANK_SEPARATED = np.ones(256, dtype=bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes that belong to a word once A-Z are lower-cased: digits, a-z and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to a few megabytes, so that batches of long texts, with copies on both
    sides, fit beside each other in an executor. Lower limits stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        known = _powers[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the ``n + 1`` offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass
class Slice:
    """Some consecutive whole texts: their bytes, the byte bounds of their words, and the words of each text."""

    first: int  #: index in the batch of the first text
    data: np.ndarray
    bounds: np.ndarray  #: byte offsets of the texts, n + 1
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray  #: word offsets of the texts, n + 1

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, from its bytes alone."""
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        plain = (sums[self.ends] - sums[self.starts]) * powers(_INVERSE, n + 1)[self.starts]
        return mix(plain + (self.ends - self.starts).astype(np.uint64))

    def text_of_word(self) -> np.ndarray:
        """Index within the slice of the text each word belongs to."""
        return np.repeat(np.arange(len(self)), np.diff(self.words))

    def runs(self, length: int) -> np.ndarray:
        """Positions of the words at which a run of ``length`` words of one text starts."""
        last = np.repeat(self.words[1:], np.diff(self.words))
        return np.flatnonzero(np.arange(len(self.starts)) + length <= last)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """64-bit hash of ``length`` consecutive words from each of ``starts``."""
    n = len(hashes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(_BASE, n), out=sums[1:])
    return mix((sums[starts + length] - sums[starts]) * powers(_INVERSE, n + 1)[starts] + np.uint64(1))


def slices(column: pa.Array | pa.ChunkedArray, inside: np.ndarray, lower: bool = False,
           size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column into slices of whole texts and find their words; ``inside`` marks the bytes of words."""
    data, bounds = text_buffer(column)
    n = len(bounds) - 1
    at = 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1))
        part, own = data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        if lower:
            part = LOWER[part]
        word = inside[part]
        before, after = np.zeros(len(part), bool), np.zeros(len(part), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        edges = own[(own > 0) & (own < len(part))]
        before[edges] = False
        after[edges - 1] = False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        yield Slice(at, part, own, starts, ends, np.searchsorted(starts, own))
        at = to
