"""Packed exchange of hashes between batches of documents and hash buckets.

A batch sends a bucket one row that holds all its hashes there, sorted and distinct,
instead of a row for each. Empty rows are not sent, so rows never outnumber hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textarrays import U64

#: Buckets are the upper 24 bits of a place, so that a bucket's share of the text stays bounded up to 268 TB.
MOST_BUCKETS = 1 << 24


def scaled(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes onto places, keeping their order: the bucket is the upper 24 bits, the rest the lower 40."""
    return (hashes >> U64(24)) * U64(buckets)


def named(places: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and, below it, the ``bits`` (32 or 40) that tell a bucket's entries apart; as a bucket's share
    of the text is bounded, chance agreements stay as rare however large the input."""
    return places if bits == 40 else (places >> U64(40)) << U64(32) | (places >> U64(8)) & U64(0xFFFFFFFF)


def bucket_rests(sorted_hashes: np.ndarray, buckets: int, bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and rest, as ``bits // 8`` bytes, of sorted hashes, each pair once, in order."""
    both = distinct(named(scaled(sorted_hashes, buckets), bits))
    return (both >> U64(bits)).astype(np.int32), short(both, bits)


def short(rests: np.ndarray, bits: int) -> np.ndarray:
    """The lower ``bits`` of integers, a row of bytes each."""
    return np.ascontiguousarray(rests.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8])


def rests(table: pa.Table, name: str, bits: int) -> list[np.ndarray]:
    """Integers that ``short`` packed in a binary column."""
    out = []
    for x in column(table, name, np.uint8):
        wide = np.zeros((len(x) * 8 // bits, 8), np.uint8)
        wide[:, : bits // 8] = x.reshape(-1, bits // 8)
        out.append(wide.view("<u8").ravel())
    return out


def bucket_numbers(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (scaled(sorted_hashes, buckets) >> U64(40)).astype(np.int32)


def rows_for(some: np.ndarray, bucket: np.ndarray, values: np.ndarray) -> pa.Array:
    """One binary value for each bucket of ``some``, which holds all those of ``bucket``: its ``values``, in order."""
    cuts = np.append(np.searchsorted(bucket, some), len(bucket))
    each = values.nbytes // max(1, len(values))
    return pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((cuts * each).astype(np.int32)), pa.py_buffer(values.tobytes())])


def distinct(x: np.ndarray) -> np.ndarray:
    if len(x) < 2:
        return x
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def run_starts(x: np.ndarray) -> np.ndarray:
    """First position of each run of equal values."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def hits(index: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Positions in the sorted index of those probes that it holds."""
    if not len(index) or not len(probes):
        return np.zeros(0, np.int64)
    at = np.searchsorted(index, probes)
    at[at == len(index)] = 0
    return at[index[at] == probes]


def column(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    """Arrays packed in a binary column."""
    return [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]


def cat(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


class Shared:
    """The strings that came back to a batch: rests of some buckets."""

    def __init__(self, table: pa.Table, buckets: int, bits: int = 32):
        self.buckets, self.bits = buckets, bits
        found = [x.astype(U64) | U64(b) << U64(bits) for b, x in zip(table.column("bucket").to_pylist(), rests(table, "shared", bits), strict=True)]
        self.keys = np.sort(cat(found, U64))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), bool)
        keys = named(scaled(hashes, self.buckets), self.bits)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` positions a run of ``length`` from one of ``starts`` covers."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.subtract.at(edges, starts + length, 1)
    return np.cumsum(edges[:n]) > 0
