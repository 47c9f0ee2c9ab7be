"""Quality by the votes of the nearest labelled documents in a latent semantic space.

A text's terms are its words, their shapes and whether they repeat the one before, dealt to
a fixed number of columns. Document counts and the latent axes come from all documents:
axes by subspace iteration, each pass one sum over the rows. Labelled vectors, a bounded
sample, are broadcast; every document's cosine with each of them is computed exactly, in
blocks, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_share, staged
from .textarrays import U64, Sums, Words, mix, pieces, text_buffer

#: Labelled documents that vote, at most about so many: a bounded, documented sample by a hash of the id.
TRAIN_ROWS = 8_000
#: Columns of words, of shapes and repeats, latent axes, and spare axes while iterating.
WORD_TERMS, SHAPE_TERMS, AXES, SPARE = 3072, 1024, 32, 8
TERMS = WORD_TERMS + SHAPE_TERMS
#: Passes over all documents that find the axes.
PASSES = 2
NEAREST, SHARPNESS = 25, 8
#: Votes, in similarity, that the labels' mean counts for.
PRIOR = 0.5
THRESHOLD = 0.3
#: Documents of a block of cosines.
BLOCK = 512
#: Columns whose sums are a row while they meet.
_SLICE = 64

#: Classes of bytes that shapes are made of: signs stand for themselves.
_CLASS = np.arange(256, dtype=np.int64)
for _first, _last, _kind in ((0x41, 0x5A, 0x41), (0x61, 0x7A, 0x61), (0x80, 0xFF, 0x61), (0x30, 0x39, 0x30)):
    _CLASS[_first : _last + 1] = _kind
_CLASS_VALUES = mix(np.arange(1001, 1257, dtype=U64))


def _terms(buf: np.ndarray, low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and weight of each term of a piece's rows: 1 + log of its count.

    ``low`` is ``buf`` with A to Z lowered.
    """
    words = Words(low, offs, plain=True)
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, name = words.rows(), words.hashes()
    # a shape is the runs of classes of a word
    kind = _CLASS[buf]
    new = np.ones(len(buf), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[words.starts] = True
    at = np.concatenate([[0], np.cumsum(new)])
    shape = Sums(_CLASS_VALUES[kind[new]]).spans(at[words.starts], at[words.ends])
    again = np.zeros(n, bool)
    again[1:] = (name[1:] == name[:-1]) & (row[1:] == row[:-1])
    twice = mix(shape + again.astype(U64))
    cols = np.concatenate([(name % U64(WORD_TERMS)).astype(np.int64), WORD_TERMS + (twice % U64(SHAPE_TERMS)).astype(np.int64)])
    key, count = np.unique(np.tile(row, 2) * TERMS + cols, return_counts=True)
    return key // TERMS, key % TERMS, 1 + np.log(count)


def _weighted(column: pa.Array, idf: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece: first row, rows, and the sparse term vectors, of unit length if ``idf`` is given; words and shapes weigh alike."""
    plain = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    buf, offs = text_buffer(plain)
    low = buf.copy()
    low[(low >= 0x41) & (low <= 0x5A)] += 32
    for a, b in pieces(offs):
        row, col, w = _terms(buf[offs[a] : offs[b]], low[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        if idf is not None:
            w = w * idf[col]
            side = row * 2 + (col >= WORD_TERMS)
            length = np.sqrt(np.bincount(side, w * w, minlength=2 * (b - a)))
            w = w / np.maximum(length[side], 1e-12)
        yield a, b - a, row, col, w


def _projected(rows: int, row: np.ndarray, col: np.ndarray, w: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Products of sparse rows with the axes."""
    out = np.zeros((rows, axes.shape[1]))
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    for i in range(0, len(starts), 256):  # some hundred rows' terms at once
        j = min(i + 256, len(starts))
        lo, hi = starts[i], starts[j] if j < len(starts) else len(row)
        out[row[starts[i:j]]] = np.add.reduceat(axes[col[lo:hi]] * w[lo:hi, None], starts[i:j] - lo)
    return out


def _summed(rows: DataFrame, total, size: int) -> np.ndarray:
    """Sums over all rows of what ``total`` adds up of a task's batches: ``size`` numbers for each term.

    They meet slice by slice in two rounds, so no task gets more than a root of all tasks' sums of one slice.
    """
    merged = math.ceil(rows.rdd.getNumPartitions() ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((TERMS, size))
        for b in batches:
            total(out, b.column("text"))
        part = TaskContext.get().partitionId() % merged
        at = np.arange(0, TERMS, _SLICE, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), part, np.int32)), pa.array([out[i : i + _SLICE].tobytes() for i in at], pa.binary())], names=["at", "part", "v"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        # in the order of their bytes, so that rounding doesn't depend on arrival
        v = sum(np.frombuffer(x) for x in sorted(group.column("v").to_pylist()))
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    schema = "at int, part int, v binary"
    parts = rows.select("text").mapInArrow(run, schema).groupBy("at", "part").applyInArrow(add, schema).groupBy("at").applyInArrow(add, schema)
    out = np.zeros((TERMS, size))
    for r in parts.collect():  # TERMS x size numbers, whatever the documents
        out[r.at : r.at + _SLICE] = np.frombuffer(r.v).reshape(-1, size)
    return out


@dataclass
class Space:
    """Weights of terms and the latent axes."""

    idf: np.ndarray
    axes: np.ndarray

    def vectors(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Piece by piece: first row and unit vectors; zero where a text has no word."""
        for first, n, row, col, w in _weighted(column, self.idf):
            x = _projected(n, row, col, w, self.axes)
            yield first, (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def latent_space(docs: DataFrame, text: str = "text", axes: int = AXES) -> Space:
    """The leading latent axes of all documents' weighted terms."""
    rows = docs.select(F.col(text).cast("string").alias("text"))

    def count(out: np.ndarray, column: pa.Array) -> None:
        for _, n, row, col, _ in _weighted(column, None):
            out[:, 0] += np.bincount(col, minlength=TERMS)

    counted = _summed(rows, count, 1)[:, 0]
    idf = np.log((counted.max() + 1) / (counted + 1)) + 0.1  # the commonest term stands for the number of texts
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(TERMS, axes + SPARE)))[0]
    for _ in range(PASSES):
        held = rows.sparkSession.sparkContext.broadcast((idf, basis))  # TERMS times axes

        def spread(out: np.ndarray, column: pa.Array, held=held) -> None:
            idf, basis = held.value
            for _, n, row, col, w in _weighted(column, idf):
                x = _projected(n, row, col, w, basis)
                order = np.argsort(col, kind="stable")
                names, starts = np.unique(col[order], return_index=True)
                for i in range(0, len(names), 256):
                    j = min(i + 256, len(names))
                    lo, hi = starts[i], starts[j] if j < len(names) else len(order)
                    some = order[lo:hi]
                    out[names[i:j]] += np.add.reduceat(x[row[some]] * w[some, None], starts[i:j] - lo)

        made = _summed(rows, spread, basis.shape[1])
        # within the old axes, the directions of most weight come first
        weight, turned = np.linalg.eigh(basis.T @ made)
        basis = np.linalg.qr(made @ turned[:, np.argsort(-weight)])[0]
        held.destroy()
    return Space(idf, basis[:, :axes])


def held_out(id_col: str = "doc_id"):
    """Whether a row is never learnt from: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


@dataclass
class Voters:
    """Unit vectors of labelled texts and their labels."""

    vectors: np.ndarray
    labels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The nearest voters' labels, weighted by their cosines, drawn towards the labels' mean."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        mean, k = self.labels.mean(), min(NEAREST, len(self.labels))
        out = np.empty(len(x))
        for i in range(0, len(x), BLOCK):
            cos = x[i : i + BLOCK] @ self.vectors.T
            # of equal cosines all at the edge share the places that are left, so no order of voters matters
            edge = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
            above = cos > edge
            at_edge = cos == edge
            share = (k - above.sum(1)) / np.maximum(at_edge.sum(1), 1)
            weight = np.maximum(cos, 0) ** SHARPNESS * (above + at_edge * share[:, None])
            out[i : i + BLOCK] = (weight @ self.labels + PRIOR * mean) / (weight.sum(1) + PRIOR)
        return np.clip(out, 0, 1)


def voters(docs: DataFrame, labels: DataFrame, space: Space, most: int = TRAIN_ROWS) -> Voters:
    """Voters from the labelled rows that are not held out, about ``most`` at most; equal texts are one, with the mean of their labels."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("quality") == 1).cast("double").alias("label"))
    sample = known.where(in_share("doc_id", most, known.count()))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = staged(rows.groupBy("text").agg(F.avg("label").alias("label")), "quality-training")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, x in space.vectors(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("label").slice(first, len(x)), pa.array([v.tobytes() for v in x], pa.binary())], names=["label", "v"])

    found = sorted((r.v, r.label) for r in rows.mapInArrow(place, "label double, v binary").collect())  # a bounded sample
    vectors = np.frombuffer(b"".join(v for v, _ in found), np.float32).reshape(len(found), space.axes.shape[1])
    return Voters(vectors, np.array([y for _, y in found]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``: how likely its ``quality`` is 1, by its text alone.

    Null and empty texts have no neighbour and get the mean label of the voters; without any label every score is
    0.5. A null id stays null and is never learnt from; equal texts get equal scores, and count once among
    the voters, whose sample is drawn by id; ties at the last place vote in part. An empty table gives an empty one; other columns are not
    read. A task holds the terms of about 1 MB of text, or of its longest, and a block's cosines with all voters.
    """
    space = latent_space(docs)
    held = docs.sparkSession.sparkContext.broadcast((space, voters(docs, labels, space, most)))  # about ``most`` vectors of AXES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, known = held.value
        for b in batches:
            ids = b.column("doc_id")
            for first, x in space.vectors(b.column("text")):
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(x)), pa.array(np.round(known.score(x), 6))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
