"""Embedders of text columns; the default hashes words into signed buckets, at unit length."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import CHUNK_OVERLAP, CHUNK_SIZE

try:
    from _md5 import md5  # for a word it takes less than half of hashlib's time
except ImportError:
    from hashlib import md5

DIM = 64
#: Takes a list of texts, gives an array of a row for each.
Embedder = Callable[[list[str]], np.ndarray]


#: Words whose hashes a task keeps, and texts that are embedded at once.
MOST_WORDS, TEXTS = 1 << 18, 512


class _Hashes(dict):
    """Words' hashes; looked up, a new word is added."""

    def __missing__(self, word: str) -> int:
        made = self[word] = int(md5(word.encode()).hexdigest()[:8], 16)
        return made


_hashes = _Hashes()


def hash_embedder(dim: int = DIM) -> Embedder:
    """A lower-case word's bucket and sign both come from 32 bits of its MD5.

    Texts whose words cancel, or that have none, get the zero vector.
    """
    if dim & (dim - 1):
        raise ValueError("the dimension must be a power of two")

    def embed(texts: list[str]) -> np.ndarray:
        words = [(text or "").lower().split() for text in texts]
        size = [len(w) for w in words]
        if len(_hashes) > MOST_WORDS:
            _hashes.clear()
        h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.int64, sum(size))
        return _unit(h, np.repeat(np.arange(len(texts)), size), len(texts), dim)

    return embed


def _unit(h: np.ndarray, row: np.ndarray, n: int, dim: int) -> np.ndarray:
    """``n`` vectors at unit length, from the hashes of the words of each ``row``."""
    out = np.bincount(row * dim + h % dim, np.where(h % (2 * dim) >= dim, 1.0, -1.0), minlength=n * dim).reshape(-1, dim)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _lists(vectors: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, max(1, vectors.shape[1])), pa.int32()), pa.array(vectors.ravel()))


def embed(rows: DataFrame, embedder: Embedder | None = None, text: str = "chunk") -> DataFrame:
    """``rows`` with ``emb`` in place of ``text``; rows go through Arrow, TEXTS at a time, and nothing is shuffled."""
    make = embedder or hash_embedder()
    kept = [f for f in rows.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, TEXTS) for whole in batches for i in range(0, whole.num_rows, TEXTS)):
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), _lists(make(b.column(text).to_pylist()))], names=[*(f.name for f in kept), "emb"])

    schema = T.StructType([*kept, T.StructField("emb", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


#: Bytes of texts whose words a task splits at once, but for a longer text.
MOST_BYTES = 1 << 22


def _token_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case tokens of all words, and how many each word has: one, unless it holds other white space than the words were split at."""
    text = "\n".join(words.to_numpy(zero_copy_only=False)).lower()
    tokens = text.split()
    n = np.ones(len(words), np.int64)
    if len(tokens) != len(words) or any(c in text for c in _OTHER_SPACE):
        n = np.fromiter((len(w.split()) for w in text.split("\n")), np.int64, len(words))
    return np.frombuffer(b"".join([md5(t.encode()).digest() for t in tokens]), ">u4")[::4].astype(np.int64), n


#: White space of Python beside that of ``text.words``.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\v\f\r"]


def embed_chunks(docs: DataFrame, dim: int = DIM, text: str = "text", id_col: str = "doc_id", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``id_col, pos, emb``: what ``embed`` makes of ``explode_chunks`` with the default embedder, from texts that are split once.

    A chunk is a range of its text's words, never a text of its own: the distinct words of some texts are hashed, and a chunk adds up those of its range.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and below the chunk size")
    hash_embedder(dim)  # checks the dimension
    stride = size - overlap

    def vectors(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # at the same signs as ``text.words``
        doc, word = pc.list_parent_indices(split), split.flatten()
        there = pc.not_equal(word, "")
        doc, word = doc.filter(there).to_numpy(), word.filter(there).dictionary_encode()
        code = word.indices.to_numpy()
        have = np.bincount(doc, minlength=len(ids))
        chunks = np.where(have > 0, np.maximum(0, -((size - have) // stride)) + 1, 0)
        of = np.repeat(np.arange(len(ids)), chunks)
        at = (np.arange(len(of)) - (np.cumsum(chunks) - chunks)[of]) * stride
        first, n = (np.cumsum(have) - have)[of] + at, np.minimum(size, have[of] - at)
        keep, seen = np.ones(len(of), bool), set()
        for i, (a, k) in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
            if not at[i]:
                seen = set()  # a new text's chunks
            words = code[a : a + k].tobytes()
            keep[i] = words not in seen
            seen.add(words)
        of, first, n = of[keep], first[keep], n[keep]
        pos = np.arange(len(of)) - np.searchsorted(of, of)
        h, tokens = _token_hashes(word.dictionary)
        token = np.cumsum(tokens) - tokens
        for i in range(0, len(of), TEXTS):
            some = slice(i, i + TEXTS)
            row, used = _ranges(first[some], n[some])
            again, used = _ranges(token[code[used]], tokens[code[used]])
            made = _lists(_unit(h[used], row[again], len(of[some]), dim))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of[some])), pa.array(pos[some], pa.int32()), made], names=[id_col, "pos", "emb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many = np.cumsum(pc.fill_null(pc.binary_length(b.column("_text")), 0).to_numpy()) // MOST_BYTES
            ends = [0, *(np.flatnonzero(np.diff(many)) + 1).tolist(), b.num_rows]
            for i, j in zip(ends, ends[1:], strict=False):
                yield from vectors(b.column(id_col).slice(i, j - i), b.column("_text").slice(i, j - i))

    schema = T.StructType([docs.schema[id_col], T.StructField("pos", T.IntegerType()), T.StructField("emb", T.ArrayType(T.DoubleType()))])
    return docs.select(id_col, F.make_valid_utf8(text).alias("_text")).mapInArrow(run, schema)


def _ranges(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``n`` numbers from each ``start``: the place of the range that each is of, and the numbers."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) + (start - np.cumsum(n) + n)[of]
