"""Vectorised text kernels that run inside Spark tasks on Arrow buffers.

Everything here works on one slice of an Arrow batch: the UTF-8 bytes of its texts back to back, with
numpy doing the per-byte and per-word work.  Spark partitions, shuffles and joins around it.
Null texts count as empty.  Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import ctypes
import glob
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd bases of the polynomial hashes over bytes and over words.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n (kept per process)."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U64(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[base] = (out[0], out[1])
    return _POWERS[base]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Gives free memory of the allocators back to the system, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def one_thread() -> None:
    """Keeps numpy's matrix products on this thread: Spark runs a task on each core, and small products spin when split."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def slices(batch: pa.RecordBatch, name: str, max_bytes: int = 3 << 18):
    """Consecutive pieces of a batch with about ``max_bytes`` of text each; one longer text stands alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start, done = stop, ends[stop - 1]
    release()


@dataclass
class Words:
    """The words of the texts of a slice: byte ranges, and ``first[d]:first[d+1]`` are those of text d."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return range_hash(self.data, self.start, self.end, base)


def split_words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = string_bytes(column)
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before &= ~edge[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after &= ~edge[1:]
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    power, inverse = powers(base, len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * inverse[start])


def windows(words: Words, hashes: np.ndarray, n: int, base: int = WORD_BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words within a text, and the index of each window's first word."""
    if len(hashes) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    power, inverse = powers(base, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    room = np.repeat(words.first[1:], words.count) - np.arange(len(hashes)) >= n
    at = np.flatnonzero(room)
    return mix64((total[at + n] - total[at]) * inverse[at]), at


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[i], start[i]+1, ...`` with ``count[i]`` values each, joined."""
    if not len(count):
        return np.zeros(0, np.int64)
    total = np.cumsum(count)
    return np.repeat(start - (total - count), count) + np.arange(total[-1])


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, joined."""
    return data[ranges(start, end - start)]


def binary_column(data: np.ndarray, offsets: np.ndarray, kind=pa.binary()) -> pa.Array:
    """A binary or string column over joined bytes and n+1 offsets."""
    large = pa.large_string() if pa.types.is_string(kind) else pa.large_binary()
    made = pa.Array.from_buffers(large, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return made.cast(kind)


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.ascontiguousarray(offsets), pa.int32()), pa.array(values, kind))


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i+1]]``, empty ranges included."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def unique_per_text(key: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each text in (text, key) order: keys, how often each occurs, and n+1 offsets."""
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return key[at], np.diff(np.append(at, len(key))), np.searchsorted(text[at], np.arange(n + 1))
