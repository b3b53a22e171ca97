"""Bounded caches, memory of workers, hashes of word runs."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Keys that are longer are made again each time, so that the bytes of a cache are bounded by its entries.
LONG_KEY = 64


class Cache(dict):
    """A dictionary that makes what it lacks and holds two generations: the elder goes when the younger is full."""

    def __init__(self, make, entries: int = 150_000):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        if len(key) > LONG_KEY:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def released(out: pa.Table | None = None) -> pa.Table | None:
    """out, after memory that is free has gone back to the machine.

    A worker lives on for other tasks and stages. What Arrow and the C library keep of a finished one, a hundred MB, would stand beside
    what the next one takes, and beside the JVM of the executor.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass
    return out


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, that gives free memory back when it has ended and its caches are gone."""

    def wrapped(batches):
        yield from run(batches)
        released()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; of the whole, if shorter."""
    k = min(k, len(hashes))
    if not k:
        return hashes
    n = len(hashes) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def pack(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, the lowest bytes of all before the next ones, without the highest ones that are 0, compressed."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    width = packed[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(packed[1:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)
