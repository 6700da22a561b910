"""Requests to the shards of a keyed table: counts of (key, document) pairs, packed per slice of documents."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K


class Lookup:
    """Sorted 64-bit hashes with values; a table of their leading bits says where to look."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = np.ascontiguousarray(keys).view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))
        self.padded = np.append(self.keys, np.uint64(2**64 - 1))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their values (else 0)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), self.values.dtype)
        keys = np.ascontiguousarray(keys).view(np.uint64)
        if self.most > 16:  # keys that are no hashes
            at = np.searchsorted(self.keys, keys)
        else:
            at = self.first[(keys >> self.shift).astype(np.int64)]
            for _ in range(self.most):
                at += self.padded[at] < keys
        at = np.minimum(at, len(self.keys) - 1)
        hit = self.keys[at] == keys
        return hit, np.where(hit, self.values[at], 0)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (K.mix64(key) % np.uint64(shards)).astype(np.int32)


def squeeze(x: np.ndarray) -> bytes:
    """Numbers as bytes, compressed place by place."""
    x = np.ascontiguousarray(x)
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def expand(blob: bytes, kind) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], n, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Rising 64-bit keys by their steps."""
    keys = keys.view(np.uint64)
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, np.uint64), dtype=np.uint64)


def pack(key: np.ndarray, doc: np.ndarray, shards: int) -> list[pa.Array]:
    """One row for each shard met: shard, its distinct keys, documents per key, documents, and times each.

    ``key`` may hold a pair several times; a key goes once a slice however many of its documents have it.
    """
    shard = shard_of(key, shards)
    order = np.lexsort((doc, key, shard))
    key, doc, shard = key[order], doc[order], shard[order]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(key))).astype(np.uint32)
    key, doc, shard = key[at], doc[at], shard[at]
    lead = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(lead, len(key))).astype(np.uint32)
    ends = np.searchsorted(shard, np.arange(shards + 1))
    leads = np.searchsorted(lead, ends)
    full = np.flatnonzero(np.diff(ends)).tolist()
    column = lambda f, x, at: pa.array([f(x[at[i] : at[i + 1]]) for i in full], pa.binary())
    return [pa.array(full, pa.int32()), column(squeeze_sorted, key[lead], leads), column(squeeze, size, leads), column(squeeze, doc.astype(np.uint32), ends), column(squeeze, times, ends)]


def unpack(requests: pa.Table):
    """``(uid, keys, documents per key, documents, times)`` of each request row."""
    rows = zip(*(requests.column(c).to_pylist() for c in ("uid", "keys", "size", "docs", "times")), strict=True)
    for uid, keys, size, docs, times in rows:
        yield uid, expand_sorted(keys), expand(size, np.uint32), expand(docs, np.uint32), expand(times, np.uint32)


def salts_for(requests: DataFrame, shards: int, group_bytes: int) -> int:
    """How many salts split a shard's requests into groups of about ``group_bytes``."""
    sent = requests.agg(F.sum(F.length("keys") + F.length("size") + F.length("docs") + F.length("times")).alias("b")).first().b or 0
    return max(1, math.ceil(sent / (shards * group_bytes)))


def columns(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table of bounded size, as arrays on the driver."""
    table = df.toArrow().combine_chunks()
    return {name: table.column(name).to_numpy().copy() for name in table.column_names}
