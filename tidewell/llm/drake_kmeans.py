"""Exact k-means on integer vectors with adaptive distance bounds.

Each vector keeps an upper bound of the distance to its own centroid, lower bounds of those to
several nearest others in order, and one lower bound of those to all the rest. When centroids
move, bounds move by as much; a vector whose own centroid stays certified is not looked at.
Else its own distance is made exact, then the listed ones, and only where the remainder can't be
excluded are all centroids scanned. How many bounds are listed falls to what a round needed.

Bounds are rounded outwards and must hold strictly; distances that decide are integers, so
results don't depend on rounding, partitions or order.

Vectors are written once, in packed blocks, as a table bucketed by block. A round's bounds are
another such table, so that both meet without a shuffle and a round writes some 30 bytes a vector;
tasks send sums by centroid, whatever the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bucketed, staged

WIDTH, CLUSTERS, ROUNDS = 64, 8, 10
SCALE, SEED = 1024, "3:"
#: Components are held within this, so that a squared distance fits a long.
LARGEST = 1 << 27
#: The largest long, at which sums of distances stop.
LONGEST = (1 << 63) - 1
#: Vectors of a block.
BLOCK = 4096
#: Nearest centroids with a bound of their own at first, at least; a quarter of all if that is more.
SEVERAL = 3

_BLOCKS = "block long, ids array<long>, x binary"
_STATES = "block long, state binary, sums binary, used int"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - 1e-9) if np.ndim(x) == 0 else np.where(x > 0, x * (1 - 1e-9), x * (1 + 1e-9))).astype(np.float32), np.float32(-np.inf))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``c``, as integers."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 1 << 22:  # sums of 64 products are exact
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def _some(x: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to those of ``c`` that its row of ``which`` names."""
    return np.stack([((x - c[w]) ** 2).sum(1) for w in which.T], 1) if which.shape[1] else np.zeros((len(x), 0), np.int64)


@dataclass
class Bounds:
    """Own centroid, upper bound; listed centroids and their lower bounds; lower bound of the rest."""

    own: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    low: np.ndarray
    rest: np.ndarray

    def packed(self) -> bytes:
        return b"".join(a.tobytes() for a in (self.own, self.upper, self.near, self.low, self.rest))

    @staticmethod
    def of(data: bytes, n: int) -> Bounds:
        b = (len(data) // n - 10) // 6
        cuts = np.cumsum([0, 2 * n, 4 * n, 2 * n * b, 4 * n * b, 4 * n])
        own, upper, near, low, rest = (np.frombuffer(data[i:j], t).copy() for i, j, t in zip(cuts, cuts[1:], ("<u2", "<f4", "<u2", "<f4", "<f4"), strict=False))
        return Bounds(own, upper, near.reshape(n, b), low.reshape(n, b), rest)


def scanned(x: np.ndarray, c: np.ndarray, b: int) -> Bounds:
    """Bounds from a full scan, ``b`` of them listed; ties go to the smaller number."""
    d = squares(x, c)
    order = np.argsort(d, 1, kind="stable")
    far = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    rest = _down(far[:, b + 1]) if b + 1 < len(c) else np.full(len(x), np.inf, np.float32)
    return Bounds(order[:, 0].astype("<u2"), _up(far[:, 0]), order[:, 1 : b + 1].astype("<u2"), _down(far[:, 1 : b + 1]), rest)


def moved_on(x: np.ndarray, c: np.ndarray, s: Bounds, moved: np.ndarray, b: int) -> tuple[Bounds, int]:
    """Bounds after the centroids moved to ``c``, each by at most ``moved``, with ``b`` listed; and how many listed ones were needed."""
    if b < s.near.shape[1]:
        s = Bounds(s.own, s.upper, s.near[:, :b], s.low[:, :b], np.minimum(s.rest, s.low[:, b:].min(1)))
    s = Bounds(s.own, _up(s.upper + moved[s.own]), s.near, _down(s.low - moved[s.near]), np.where(np.isinf(s.rest), s.rest, _down(s.rest - moved.max())))
    b = s.near.shape[1]
    nearest = lambda at: np.minimum(s.low[at].min(1, initial=np.inf), s.rest[at])
    open_ = np.flatnonzero(s.upper >= nearest(slice(None)))
    if not len(open_):
        return s, 0
    own = _some(x[open_], c, s.own[open_, None])[:, 0]
    s.upper[open_] = _up(np.sqrt(own.astype(np.float64)))
    still = s.upper[open_] >= nearest(open_)
    open_, own = open_[still], own[still]
    listed = s.upper[open_] < s.rest[open_]  # the rest is excluded: the order of the listed ones decides
    at = open_[listed]
    used = 0
    if len(at):
        used = int((s.low[at] <= s.upper[at][:, None]).sum(1).max(initial=0))
        names = np.concatenate([s.own[at, None], s.near[at]], 1)
        d = np.concatenate([own[listed][:, None], _some(x[at], c, s.near[at])], 1)
        order = np.lexsort((names, d), axis=1)
        names, far = np.take_along_axis(names, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        s.own[at], s.upper[at], s.near[at], s.low[at] = names[:, 0], _up(far[:, 0]), names[:, 1:], _down(far[:, 1:])
    at = open_[~listed]
    if len(at):
        used = b
        full = scanned(x[at], c, b)
        s.own[at], s.upper[at], s.near[at], s.low[at], s.rest[at] = full.own, full.upper, full.near, full.low, full.rest
    return s, used


def _sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Sums of the components by centroid, and counts in the last column."""
    order = np.argsort(own, kind="stable")
    names, starts = np.unique(own[order], return_index=True)
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    out[names, :-1] = np.add.reduceat(x[order], starts)
    out[names, -1] = np.diff(np.append(starts, len(own)))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks of a task's vectors; as 16-bit integers where they fit."""
    from pyspark import TaskContext

    part, made, held, n = TaskContext.get().partitionId(), 0, [], 0

    def block(rows: pa.Table) -> pa.RecordBatch:
        nonlocal made
        rows = rows.combine_chunks()
        x = rows.column("v").combine_chunks().flatten().to_numpy()
        x = x.astype("<i2") if np.abs(x).max(initial=0) < 1 << 15 else x.astype("<i4")
        ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column("vec_id").combine_chunks())
        made += 1
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), ids, pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "x"])

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BLOCK:
            rows = pa.Table.from_batches(held)
            whole = n // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                yield block(rows.slice(i, BLOCK))
            held, n = rows.slice(whole).to_batches(), n - whole
    if n:
        yield block(pa.Table.from_batches(held))


def _vectors(b: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Number, ids and vectors of each block of a batch."""
    for block, ids, x in zip(b.column("block").to_pylist(), b.column("ids"), b.column("x"), strict=True):
        data = x.as_buffer()
        yield block, ids.values, np.frombuffer(data, "<i2" if len(data) == 2 * WIDTH * len(ids.values) else "<i4").reshape(-1, WIDTH).astype(np.int64)


def integers(vectors: DataFrame, id_col: str, vec: str) -> DataFrame:
    """``vec_id, v``: the vectors that are kept, as integers."""
    x = F.col(vec)
    bad = lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf"))
    whole = lambda e: F.floor(F.greatest(F.least(SCALE * e.cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    return vectors.where((F.size(x) == WIDTH) & ~F.exists(x, bad)).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _start() -> Column:
    """The order in which vectors become first centroids: the hash of the id; without one, last."""
    return F.coalesce(F.sha2(F.concat(F.lit(SEED), F.col("vec_id").cast("string")), 256), F.concat(F.lit("~"), F.sha2(F.col("v").cast("string"), 256)))


def _stepped(tables: tuple[int, int], vectors: DataFrame, state: DataFrame | None, c: np.ndarray, moved: np.ndarray | None, listed: int) -> DataFrame:
    """The bounds of one round, written; with each task's last block go the task's sums and the listed bounds that it needed."""

    bounded = state is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, needed, last = np.zeros((len(c), WIDTH + 1), np.int64), 0, None
        schema = pa.schema([("block", pa.int64()), ("state", pa.binary()), ("sums", pa.binary()), ("used", pa.int32())])
        for b in batches:
            states = b.column("state") if bounded else [None] * b.num_rows
            for (block, _, x), was in zip(_vectors(b), states, strict=True):
                if was is None:
                    now, used = scanned(x, c, listed), listed
                else:
                    now, used = moved_on(x, c, Bounds.of(was.as_py(), len(x)), moved, listed)
                total += _sums(x, now.own, len(c))
                needed = max(needed, used)
                if last is not None:
                    yield pa.RecordBatch.from_pylist([last], schema)
                last = {"block": block, "state": now.packed()}
        if last is not None:
            yield pa.RecordBatch.from_pylist([last | {"sums": total.tobytes(), "used": needed}], schema)

    source = vectors if state is None else vectors.join(state.select("block", "state"), "block")
    return bucketed(source.mapInArrow(run, _STATES), "block", *tables, "bounds", dealt=True)


def _gathered(state: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """Sums and counts by centroid, and the most listed bounds that a task needed; the driver gets one row for each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros(k * (WIDTH + 1), np.int64), 0
        for b in batches:
            for s in b.column("sums"):
                total += np.frombuffer(s.as_buffer(), np.int64)
            used = max(used, max(b.column("used").to_pylist(), default=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int32)), pa.array(np.append(used, total))], names=["i", "v"])

    rows = state.where("sums IS NOT NULL").select("sums", "used").mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v"), F.max("v").alias("most")).collect()
    out = np.zeros(k * (WIDTH + 1), np.int64)
    for r in rows:
        if r.i >= 0:
            out[r.i] = r.v
    return out.reshape(k, WIDTH + 1), next((r.most for r in rows if r.i < 0), 0)


def cluster(vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for each kept vector.

    Kept are vectors of exactly 64 components, none null or not finite; component x becomes floor(1024 * x), held within
    2**27 of zero so that squared distances fit a long; their sums stop at the largest long. The first centroids are the vectors whose ids' hashes are least.
    Each round assigns every vector to the nearest centroid, the smaller number where distances tie, and moves every
    centroid that has vectors to the floor of their mean; then vectors are assigned once more.

    With fewer vectors than ``clusters`` each is a centroid. A null id is kept and hashes after all others; rows that
    repeat an id are vectors each, and where ids tie for a first centroid the smaller vector comes first. Equal vectors
    may be several centroids, of which the first takes all. Nothing kept, or an empty table, gives an empty result;
    other columns are not read. A group of equal vectors is no group here: blocks are dealt by number.
    """
    spark = vectors.sparkSession
    out = "vec_id long, cluster int, distance long"
    kept = integers(vectors, id_col, vec)
    first = kept.orderBy(_start(), "v").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], out + ", cluster_inertia long, inertia long, centroid_sha256 string")
    c = np.array([r.v for r in first], np.int64)
    n = kept.count()
    tables = (-(-n // BLOCK), n * WIDTH * 4)
    blocks = bucketed(kept.mapInArrow(_blocks, _BLOCKS), "block", *tables, "vectors")
    listed = min(len(c) - 1, max(SEVERAL, len(c) // 4))
    state, moved = None, None
    for _ in range(rounds):
        state = _stepped(tables, blocks, state, c, moved, listed)
        sums, used = _gathered(state, len(c))
        full = sums[:, -1] > 0
        new = c.copy()
        new[full] = sums[full, :-1] // sums[full, -1:]
        moved = np.sqrt(((new - c) ** 2).sum(1).astype(np.float64)) * (1 + 1e-9)
        c = new
        listed = min(listed, max(used, len(c) // 8, min(1, len(c) - 1)))

    bounded = state is not None

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states = b.column("state") if bounded else [None] * b.num_rows
            for (_, ids, x), was in zip(_vectors(b), states, strict=True):
                now = scanned(x, c, listed) if was is None else moved_on(x, c, Bounds.of(was.as_py(), len(x)), moved, listed)[0]
                yield pa.RecordBatch.from_arrays([ids, pa.array(now.own.astype(np.int32)), pa.array(_some(x, c, now.own[:, None])[:, 0])], names=["vec_id", "cluster", "distance"])

    source = blocks if state is None else blocks.join(state.select("block", "state"), "block")
    rows = staged(source.mapInArrow(ended, out), "clustered")
    inertia = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # one number a centroid
    names = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    known = [(i, min(inertia.get(i, 0), LONGEST), min(sum(inertia.values()), LONGEST), name) for i, name in enumerate(names)]
    more = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(more), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
