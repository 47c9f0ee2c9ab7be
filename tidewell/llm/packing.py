"""Bounded-space online packing of token ids into windows of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged
from .tokens import encoder

LENGTH = 1024
#: Windows that a partition keeps open.
OPEN = 32
#: A full-enough window: one with no more than so many ids free is emitted as it is, else topped up by a cut.
SLACK = 24
#: Partitions, or groups of them, whose open windows are merged in one task.
FAN_IN = 64

_ROWS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean, origin int"
#: Rows gathered before a batch goes to the JVM.
_BATCH = 4000


class Windows:
    """At most ``most`` open windows; emitted ones go to ``done`` with their pieces."""

    def __init__(self, first_id: int, most: int, length: int, slack: int):
        self.next_id, self.most, self.length, self.slack = first_id, most, length, slack
        self.open: list[list] = []  # [fill, pieces]
        self.done: list[tuple[int, list]] = []

    def _emit(self, pieces: list) -> None:
        self.done.append((self.next_id, pieces))
        self.next_id += 1

    def _close(self, window: list) -> None:
        self.open.remove(window)
        self._emit(window[1])

    def put(self, piece: tuple) -> None:
        """``piece``: doc_id, start, ids, doc_tokens; at most a window long."""
        doc_id, start, ids, total = piece
        n = len(ids)
        if n == self.length:
            self._emit([piece])
            return
        fits = [w for w in self.open if w[0] + n <= self.length]
        if fits:
            best = max(fits, key=lambda w: w[0])
            best[0] += n
            best[1].append(piece)
            if best[0] == self.length:
                self._close(best)
        elif len(self.open) < self.most:
            self.open.append([n, [piece]])
        else:
            fullest = max(self.open, key=lambda w: w[0])
            free = self.length - fullest[0]
            if free > self.slack:
                fullest[1].append((doc_id, start, ids[:free], total))
                piece = (doc_id, start + free, ids[free:], total)
            self._close(fullest)
            self.put(piece)


def _batches(windows: list[tuple[int, list]], is_open: bool, origin: int) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[] for _ in range(7)]
    for sequence, pieces in windows:
        offset = 0
        for doc_id, start, ids, total in pieces:
            for col, x in zip(cols, (doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset), strict=True):
                col.append(x)
            offset += len(ids)
    n = len(cols[0])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    for a in range(0, n, _BATCH):
        b = min(n, a + _BATCH)
        arrays = [pa.array(c[a:b], t) for c, t in zip(cols, types, strict=True)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([is_open] * (b - a)), pa.array([origin] * (b - a), pa.int32())], names=[*names, "open", "origin"])


def _merge(key: tuple, group: pa.Table, level: int, last: bool, length: int, slack: int) -> pa.Table:
    """Place the pieces of several partitions' open windows anew, the longest first."""
    origin = key[0].as_py()
    # the order is fixed, whatever order the rows came in
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True), key=lambda r: (-len(r[2]), r[0] is None, r[0] or 0, r[1]))
    to = Windows((level << 56) | (origin << 28), 1 << 30, length, slack)
    for doc_id, start, ids, total in rows:
        to.put((doc_id, start, np.frombuffer(ids, "<u4"), total))
    left = [w for w in to.open if length - w[0] > slack and not last]
    for w in [w for w in to.open if w not in left] if left else list(to.open):
        to._close(w)
    numbered = [(to.next_id + i, w[1]) for i, w in enumerate(left)]
    out = [*_batches(to.done, False, origin), *_batches(numbered, True, origin)]
    return pa.Table.from_batches(out) if out else group.slice(0, 0).select([f.split()[0] for f in _ROWS.split(", ")])


def pack(docs: DataFrame, tokenizer: str, *, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, end_id: int = 0, most_open: int = OPEN, slack: int = SLACK) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` ids, by the ``tokenizers`` file ``tokenizer``.

    Columns: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens,
    sequence_id, offset``. A document is its ids, then ``end_id``. Every partition keeps
    ``most_open`` open windows; a document's full windows go out at once, the rest into the
    open window that it fills best; when none fits, the fullest goes out, topped up with a cut
    of the document if more than ``slack`` ids are free. What partitions leave open is merged
    in rounds of bounded groups, so padding does not grow with the number of partitions.

    Null and empty texts are one ``end_id``; a null id stays null; repeated rows are packed
    each; an empty table gives none; other columns are not read. The largest text is held by
    one task, nothing else grows.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        to = Windows(part << 28, most_open, length, slack)
        encode = encoder(tokenizer).encode
        for b in batches:
            for a in range(0, b.num_rows, 500):
                some = b.slice(a, 500)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1)), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    for start in range(0, len(ids), length):
                        to.put((doc_id, start, ids[start : start + length], len(ids)))
                yield from _batches(to.done, False, part)
                to.done = []
        yield from _batches([(to.next_id + i, w[1]) for i, w in enumerate(to.open)], True, part)

    placed = staged(docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(place, _ROWS), "packed")
    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    closed, left = placed.where("not open").select(columns), placed.where("open")
    groups = int(left.agg(F.max("origin")).first()[0] or 0) + 1
    level = 1
    while True:
        groups = -(-groups // FAN_IN)
        last = groups == 1
        merged = left.withColumn("group", F.floor(F.col("origin") / FAN_IN).cast("int")).groupBy("group").applyInArrow(_merger(level, last, length, slack), _ROWS)
        merged = staged(merged, "packed-leftovers")
        closed = closed.unionByName(merged.where("not open").select(columns))
        if last:
            return closed
        left, level = merged.where("open"), level + 1


def _merger(level: int, last: bool, length: int, slack: int):
    return lambda key, group: _merge(key, group, level, last, length, slack)
