"""Static 3-wise binary fuse filters with 8-bit fingerprints (Graf and Lemire, 2022)."""

from __future__ import annotations

import math
import struct

import numpy as np

from .textarrays import U64, mix

_HEAD = struct.Struct("<QII")  # seed, log2 of the segment length, number of segments


def _slots(hashes: np.ndarray, log_len: int, segments: int) -> list[np.ndarray]:
    mask = U64((1 << log_len) - 1)
    h0 = ((hashes >> U64(32)) * U64(segments << log_len)) >> U64(32)
    h1 = (h0 + (U64(1) << U64(log_len))) ^ ((hashes >> U64(18)) & mask)
    h2 = (h0 + (U64(2) << U64(log_len))) ^ (hashes & mask)
    return [h.astype(np.int64) for h in (h0, h1, h2)]


def _prints(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> U64(32))) & U64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter that holds every one of ``keys`` (64-bit integers)."""
    keys = np.unique(keys.astype(U64))
    n = len(keys)
    log_len = max(2, math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)) if n > 1 else 2
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
    segments = max(1, math.ceil(n * factor / (1 << log_len)) - 2)
    for seed in range(1, 200):
        hashes = mix(keys + U64(seed) * U64(0x9E3779B97F4A7C15))
        slots = np.stack(_slots(hashes, log_len, segments))
        size = (segments + 2) << log_len
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # xor of the keys at a slot
        for row in slots:
            np.bitwise_xor.at(held, row, np.arange(n))
        peeled = []
        front = np.flatnonzero(count == 1)
        while len(front):
            key = held[front]
            key, at = np.unique(key, return_index=True)
            peeled.append((key, front[at]))
            touched = slots[:, key]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, key)
            touched = np.unique(touched)
            front = touched[count[touched] == 1]
        if sum(len(k) for k, _ in peeled) == n:
            table = np.zeros(size, np.uint8)
            prints = _prints(hashes)
            for key, at in reversed(peeled):
                own = slots[:, key]
                table[at] = 0
                table[at] = prints[key] ^ table[own[0]] ^ table[own[1]] ^ table[own[2]]
            return _HEAD.pack(seed, log_len, segments) + table.tobytes()
        if seed % 20 == 0:
            segments = segments + max(1, segments // 8)
    raise RuntimeError("no fuse filter found")


def contains(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key, False if it is surely not held."""
    seed, log_len, segments = _HEAD.unpack_from(filter_)
    table = np.frombuffer(filter_, np.uint8, offset=_HEAD.size)
    hashes = mix(keys.astype(U64) + U64(seed) * U64(0x9E3779B97F4A7C15))
    a, b, c = _slots(hashes, log_len, segments)
    return (table[a] ^ table[b] ^ table[c]) == _prints(hashes)
