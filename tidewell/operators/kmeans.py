"""Mini-batch k-means whose draws follow from ids: the same centres on any partitioning.

Of several starts, each gets batches that are drawn from all rows by a hash of their ids. A start's
batches, a bounded number of rows, meet in one task in order: the first one seeds the centres by
oversampling, every one moves them. Then one pass over all rows tells each start's
inertia; the best one's centres move once more, to the means of all rows that are theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng

#: Rows of a batch, batches of a start, and starts.
BATCH, STEPS, STARTS = 1000, 30, 3
#: Candidates of a seeding round for each centre, and rounds.
OVERSAMPLED, ROUNDS = 2, 4


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def seeded(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` centres among the rows: candidates drawn in rounds by their distance to those so far, then as many of them by their weight; with fewer rows, rows repeat."""
    draw = np.random.default_rng(seed)
    chosen = [int(draw.integers(len(x)))]
    near = squares(x, x[chosen])[:, 0]
    for _ in range(ROUNDS):
        if near.sum() <= 0:
            break
        new = np.flatnonzero(draw.random(len(x)) < OVERSAMPLED * k * near / near.sum())
        if len(new):
            near = np.minimum(near, squares(x, x[new]).min(1))
            chosen += new.tolist()
    candidates = x[list(dict.fromkeys(chosen))]
    weight = np.bincount(squares(x, candidates).argmin(1), minlength=len(candidates)).astype(float)
    centres = [candidates[int(weight.argmax())]]
    while len(centres) < k:
        far = weight * squares(candidates, np.array(centres)).min(1)
        centres.append(candidates[int(draw.choice(len(far), p=far / far.sum()))] if far.sum() > 0 else candidates[len(centres) % len(candidates)])
    return np.array(centres)


def moved(centres: np.ndarray, counts: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres as the means of what they got so far and of a batch's rows, and how many these are."""
    own = squares(x, centres).argmin(1)
    n = np.bincount(own, minlength=len(centres))
    total = np.zeros_like(centres)
    np.add.at(total, own, x)
    upto = counts + n
    return np.where(n[:, None] > 0, (centres * counts[:, None] + total) / np.maximum(upto, 1)[:, None], centres), upto


def _drawn(n: int, seed: int, start: Column, key: Column, batch: int, steps: int) -> Column:
    """The batches (``step``) of a start that a row is in: each pass deals the rows to as many batches as they fill."""
    per = max(1, n // batch)
    passes = -(-steps // per)
    parts = [F.floor(rng.uniform(F.lit(seed), f"batch-{p}", F.concat_ws(":", start.cast("string"), key)) * F.lit(n / min(batch, n))) + F.lit(p * per) for p in range(passes)]
    dealt = F.array(*[F.when((c < (p + 1) * per) & (c < steps), c.cast("int")) for p, c in enumerate(parts)])
    return F.explode(F.array_compact(dealt))


def minibatch_kmeans(rows: DataFrame, k: int, *, id_cols: list[str], emb: str = "emb", seed: int = 42, batch: int = BATCH, steps: int = STEPS, starts: int = STARTS) -> np.ndarray:
    """``k`` centres of the vectors of ``rows``, which ``id_cols`` tell apart; none without rows.

    Rows without a vector don't count. Batches have about ``batch`` rows; where there are fewer rows, each batch has all. What meets in a task
    is a start's batches, at most about ``batch * steps`` rows however many there are; the driver gets a sum for each start and centre.
    """
    there = rows.where(F.col(emb).isNotNull()).select(F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols]).alias("key"), F.transform(emb, lambda x: x.cast("double")).alias("x"))
    n = there.count()
    if not n or not k:
        return np.zeros((0, 0))
    each = there.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    drawn = each.select("start", "key", "x", _drawn(n, seed, F.col("start"), F.col("key"), batch, steps).alias("step"))
    ordered = drawn.repartition(starts, "start").sortWithinPartitions("start", "step", "key", "x")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: tuple[tuple[int, int], list[np.ndarray]] | None = None

        def take(of: tuple[int, int], parts: list[np.ndarray]) -> None:
            x, start = np.concatenate(parts), of[0]
            if start not in state:
                state[start] = (seeded(x, k, seed * 1000 + start), np.zeros(k))
            state[start] = moved(*state[start], x)

        for b in batches:
            if not b.num_rows:
                continue
            start, step = b.column("start").to_numpy(), b.column("step").to_numpy()
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 0) | (np.diff(step) != 0)]))
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows], strict=True):
                of = (int(start[i]), int(step[i]))
                if held is not None and held[0] == of:
                    held[1].append(x[i:j])
                    continue
                if held is not None:
                    take(*held)
                held = (of, [x[i:j]])
        if held is not None:
            take(*held)
        for start, (c, _) in state.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, start, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(c.tolist(), pa.list_(pa.float64()))], names=["start", "centre", "vec"])

    made = ordered.mapInArrow(learn, "start int, centre int, vec array<double>").orderBy("start", "centre").collect()  # starts times k centres
    found = np.array([r.vec for r in made]).reshape(-1, k, len(made[0].vec))
    held = rows.sparkSession.sparkContext.broadcast(found)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value
        total, n, inertia = np.zeros_like(centres), np.zeros(centres.shape[:2]), np.zeros(len(centres))
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                for s, c in enumerate(centres):
                    d = squares(x, c)
                    own = d.argmin(1)
                    np.add.at(total[s], own, x)
                    n[s] += np.bincount(own, minlength=k)
                    inertia[s] += d.min(1).sum()
        flat = np.concatenate([total.ravel(), n.ravel(), inertia])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])

    sums = np.zeros(found.size + found.shape[0] * (k + 1))
    for r in there.select("x").mapInArrow(judge, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # a number for each sum, whatever the rows
        sums[r.i] = r.v
    held.destroy()
    total, n, inertia = np.split(sums, [found.size, found.size + found.shape[0] * k])
    best = int(inertia.argmin())
    total, n = total.reshape(found.shape)[best], n.reshape(-1, k)[best]
    return np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], found[best])
