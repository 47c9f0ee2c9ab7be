"""Numpy views of Arrow text columns: bytes, words and rolling hashes.

All hashes are polynomials modulo 2**64 over a table of mixed byte values, so a
hash of any span comes from two prefix sums; ``mix`` finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
#: BASE times INVERSE is 1 modulo 2**64.
INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Rows are worked on in pieces of about so many bytes.
PIECE = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word when words are runs of letters and digits; all of UTF-8 beyond ASCII counts as letters.
_NOT_WORD = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1); the longest made so far is kept."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 12), base, U64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if len(held) <= 4 * PIECE:
            _powers[int(base)] = held
    return held[:n]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and each row's offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return buf, offs - offs[0]


def pieces(offs: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


class Sums:
    """Prefix sums of value * BASE**i, from which any span's hash follows."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(INVERSE, n + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


class Words:
    """Words of a piece of rows: spans, the row of each, and their hashes.

    ``first[r]`` is the index of row r's first word; ``first[-1]`` counts all.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, plain: bool = False):
        ends_word = (_SPACE if plain else _NOT_WORD)[buf]
        inside = ~ends_word
        begins = inside.copy()
        begins[1:] &= ends_word[:-1]
        finishes = inside.copy()
        finishes[:-1] &= ends_word[1:]
        edges = offs[1:-1]
        edges = edges[(edges > 0) & (edges < len(buf))]
        begins[edges] = inside[edges]  # a row's edge parts words
        finishes[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)
        self.buf = buf

    def hashes(self) -> np.ndarray:
        return Sums(BYTE_VALUES[self.buf]).spans(self.starts, self.ends)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``k`` words within a row."""
        n = len(self.starts)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        row_end = np.repeat(self.first[1:], self.counts)
        at = np.flatnonzero(np.arange(k, n + k) <= row_end)
        return at, Sums(self.hashes() if hashes is None else hashes).spans(at, at + k)
