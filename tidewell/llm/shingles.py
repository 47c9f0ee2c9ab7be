"""Word shingles of text columns.

Words are lower-cased runs of ASCII letters and digits and of any characters beyond
ASCII. A shingle is five consecutive words of one text, held as a 48-bit hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textarrays import U64, Words, pieces, text_buffer

SIZE = 5
THRESHOLD = 0.8
#: Rows of a piece stay below this, so that a row and a 48-bit hash share one integer.
_MOST_ROWS = 1 << 16
HASH_BITS = U64(48)
HASH_MASK = U64((1 << 48) - 1)
#: The same words for Python's and SQL's regular expressions.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def shingle_sets(column: pa.Array, short: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Piece by piece: its first row, the bounds of each row's set, and the sets, sorted.

    ``short``: a text of one to four words is one shingle; else it has none.
    """
    buf, offs = text_buffer(lowered(column))
    for a0, b0 in pieces(offs):
        for a in range(a0, b0, _MOST_ROWS):
            b = min(b0, a + _MOST_ROWS)
            words = Words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            hashes = words.hashes()
            at, found = words.windows(SIZE, hashes)
            row = np.searchsorted(words.first, at, side="right") - 1
            if short and (few := np.flatnonzero((words.counts > 0) & (words.counts < SIZE))).size:
                whole = np.array([hash_words(hashes[words.first[r] : words.first[r + 1]]) for r in few], U64)
                row, found = np.concatenate([row, few]), np.concatenate([found, whole])
            keys = np.sort(row.astype(U64) << HASH_BITS | found >> U64(16))
            if len(keys):
                keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
            yield a, np.searchsorted(keys, np.arange(b - a + 1, dtype=U64) << HASH_BITS), keys & HASH_MASK


def hash_words(hashes: np.ndarray) -> int:
    out = len(hashes)
    for h in hashes.tolist():
        out = (out * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
    return out


def shingle_texts(text: str | None, short: bool = False) -> set[str]:
    """A text's shingles as strings, to verify what hashes found; ``short`` as above."""
    words = re.findall(WORD, pc.utf8_lower(pa.scalar(text or "")).as_py())
    if short and 0 < len(words) < SIZE:
        return {" ".join(words)}
    return {" ".join(words[i : i + SIZE]) for i in range(len(words) - SIZE + 1)}


def _ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of pairs: equal for equal pairs alone."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int32)


def exact_sets(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Each row's set of shingles, sorted, as numbers that are equal within the column for equal shingles alone.

    Words are numbered by a dictionary, runs of two, four and five words by their parts, so no hash decides.
    A text of one to four words is one shingle; a text without words has none.
    """
    buf, offs = text_buffer(lowered(column))
    texts, counts = [], []
    for a, b in pieces(offs):
        words = Words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        size = words.ends - words.starts
        upto = np.concatenate([[0], np.cumsum(size)])
        data = words.buf[np.repeat(words.starts - upto[:-1], size) + np.arange(upto[-1])]
        texts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data.tobytes())]))
        counts.append(words.counts)
    if not texts:
        return []
    # 0, which no word has, stands for what lies beyond a row's end
    encoded = pa.chunked_array(texts).combine_chunks().dictionary_encode().indices
    del texts
    ids = encoded.to_numpy(zero_copy_only=False).astype(np.int32) + 1
    count = np.concatenate(counts)
    n = len(ids)
    row = np.repeat(np.arange(len(count), dtype=np.int32), count)
    left = np.repeat(np.cumsum(count), count).astype(np.int32) - np.arange(n, dtype=np.int32)  # words from here to the row's end
    beyond = lambda x, k: np.where(left > k, np.append(x[k:], np.zeros(min(k, n), x.dtype)), 0)
    two = _ranked(ids, beyond(ids, 1))
    four = _ranked(two, beyond(two + 1, 2))
    del two
    five = _ranked(four, beyond(ids, 4))
    del four
    some = np.flatnonzero((left >= SIZE) | ((count[row] < SIZE) & (left == count[row])))
    size = int(five.max(initial=0)) + 1
    keys = np.unique(row[some].astype(np.int64) * size + five[some])
    cuts = np.searchsorted(keys, np.arange(len(count) + 1) * size)
    values = (keys % size).astype(U64)
    return [values[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
