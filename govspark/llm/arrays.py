"""Packed integer arrays for shuffles, and array files on shared storage that workers map into memory."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Integers as bytes, plane by plane, compressed; small numbers take little room."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * 8, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def local_folder(path: str) -> str:
    """Path of a folder of a mounted file system."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model is memory-mapped; {path} is not on a mounted file system")
    return url.path


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Write under a private name, then rename: readers and repeated tasks only ever see whole files."""
    os.makedirs(folder, exist_ok=True)
    private = f"{folder}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    values.tofile(private)
    os.replace(private, f"{folder}/{name}")


_mapped: dict[tuple[str, str], np.ndarray] = {}


def read_array(folder: str, name: str, kind: type | None = None, n: int = 0) -> np.ndarray:
    """Map a file read-only; a worker keeps what it has mapped, for one folder at a time. Without ``kind`` the file
    holds ``n`` unsigned numbers of whatever width it has."""
    known = _mapped.get((folder, name))
    if known is None:
        if any(f != folder for f, _ in _mapped):
            _mapped.clear()
        path = f"{folder}/{name}"
        kind = kind or np.dtype(f"u{max(1, os.path.getsize(path) // max(1, n))}")
        known = np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)
        _mapped[(folder, name)] = known
    return known


def hash_range(keys: np.ndarray, parts: int) -> np.ndarray:
    """Range of a hash: ``parts`` ranges of equal width, in order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
