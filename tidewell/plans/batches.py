"""Epochs of mini-batches: one barrier job an epoch, in which tasks step in lockstep.

Every training row has a number among its model's rows; an epoch's order is a keyed permutation
of these numbers, so batches are of exact size, are shuffled anew each epoch, and don't depend on
partitions. Tasks keep the rows they were dealt. Of each batch they gather either the rows, where a batch is smaller
than a network, and one task for each network takes the steps; or the sums of gradients, and all take the same step.
"""

from __future__ import annotations

import base64
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame

from ..operators import nets
from ..operators.nets import AdamW, Design, Weights

#: Bytes of rows that are gathered at once: a gather takes Spark a second, whatever its size, and a third more as text must stay well under an RPC message's 128 MB.
GATHERED = 16 << 20
SCHEMA = "f int, kind string, v binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Each number's place in a permutation of 0 to n - 1: four Feistel rounds, walked until the place is below n."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(4):
            key = np.uint64((seed * 4 + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            left, right = right, left ^ (_mixed(right + key) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class Plan:
    """What an epoch needs besides the rows: who learns from which, and how.

    ``offsets[f][g]`` is the number of the first row of group ``g`` among the rows that model ``f`` learns from; a group it lacks teaches it nothing.
    """

    design: Design
    offsets: dict[int, dict[int, int]]
    rows: dict[int, int]  # of each model
    batch_size: int
    alpha: float
    beta: float
    seed: int
    by_epoch: bool = False
    epochs: int = 1

    def batches(self, f: int) -> int:
        return math.ceil(self.rows[f] / self.batch_size)

    def together(self, width: int, models: int) -> int:
        """Batches of which a gather brings the rows."""
        return max(1, GATHERED // (8 * self.batch_size * (width + 3) * models))

    def optimiser(self, f: int, rate: float, decay: float, falls: bool) -> AdamW:
        """Its rate falls to a tenth over all batches, or over the epochs if ``by_epoch``."""
        return AdamW(rate, decay, (self.epochs if self.by_epoch else self.epochs * self.batches(f)) + 1, falls=falls)


def step(design: Design, weights: Weights, optimiser: AdamW, sums: np.ndarray, grads: np.ndarray, beta: float, at: int | None = None) -> None:
    """One step of AdamW by a batch's summed gradients and those of its targeted moment."""
    n = sums[0]
    own, moment = np.split(grads / n, 2)
    total = own if design.kind == "arms" else own + 2 * beta * sums[3] / n * moment
    optimiser.step(weights, nets.unflat(total, weights), at)


def summed(plan: Plan, weights: Weights, x: np.ndarray, t: np.ndarray, y: np.ndarray, counts) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of some rows' losses, and their gradients with those of the moment."""
    grads, moment, lost, out = nets.gradients(plan.design, weights, x, t, y, plan.alpha, plan.beta)
    own = nets.flat(grads)
    return np.concatenate([lost, counts(plan.design, out, t, y)]), np.concatenate([own, nets.flat(moment) if moment else np.zeros(len(own))])


def _send(context: BarrierTaskContext, value) -> list:
    return [pickle.loads(base64.b64decode(m)) for m in context.allGather(base64.b64encode(pickle.dumps(value, protocol=5)).decode())]


def run_epoch(data: DataFrame, plan: Plan, epoch: int, weights: dict[int, Weights], optimisers: dict[int, AdamW], marks: int, matrix, counts, uses) -> tuple[dict[int, dict], dict[int, Weights], dict[int, AdamW]]:
    """One epoch over ``data`` (features, t, y, fold, val, nth), whose partitions all run at once.

    Gives, for each model, its batches' mean loss, the sums of its training and of its validation rows, and the weights and optimisers after it.
    """
    held = data.sparkSession.sparkContext.broadcast((plan, weights, optimisers))  # networks and their moments, whatever the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        plan, weights, optimisers = held.value
        weights = {f: {k: w.copy() for k, w in ws.items()} for f, ws in weights.items()}
        optimisers = pickle.loads(pickle.dumps(optimisers))
        parts = [(matrix(b.column("features")), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("t", "y", "fold", "val", "nth"))) for b in batches if b.num_rows]
        width = plan.design.inputs
        x = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, width))
        t, y, group, val, nth = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(1, 6))
        val = val.astype(bool)
        place, order = {}, {}
        for f, offsets in plan.offsets.items():
            mine = np.flatnonzero(uses(group, f) & ~val) if len(x) else np.zeros(0, np.int64)
            number = nth[mine].astype(np.int64) + np.array([offsets[int(g)] for g in group[mine]], np.int64)
            at = permuted(number, plan.rows[f], plan.seed + f + 7919 * epoch)
            by = np.argsort(at)
            place[f], order[f] = at[by], mine[by]
        size = plan.batch_size
        network = len(nets.flat(next(iter(weights.values()))))
        by_rows = size * (width + 3) <= 2 * network
        together = plan.together(width, len(weights)) if by_rows else 1
        most = max(plan.batches(f) for f in weights)
        tasks = len(context.getTaskInfos())
        mine_to_step = {f for i, f in enumerate(sorted(weights)) if not by_rows or i % tasks == context.partitionId()}
        sums = {f: np.zeros(marks) for f in weights}
        mean_loss = dict.fromkeys(weights, 0.0)
        for first in range(0, most, together):
            last = min(most, first + together)
            sent = {}
            for f, at in place.items():
                for b in range(first, min(last, plan.batches(f))):
                    i, j = np.searchsorted(at, [b * size, (b + 1) * size])
                    some = order[f][i:j]
                    if by_rows:
                        sent[f, b] = (at[i:j], x[some], t[some], y[some])
                    elif len(some):
                        sent[f, b] = summed(plan, weights[f], x[some], t[some], y[some], counts)
            gathered = _send(context, sent)
            for b in range(first, last):
                for f in weights:
                    if b >= plan.batches(f) or f not in mine_to_step:
                        continue
                    found = [g[f, b] for g in gathered if (f, b) in g]
                    if by_rows:
                        at, *some = (np.concatenate([p[i] for p in found]) for i in range(4))
                        by = np.argsort(at)
                        found = [summed(plan, weights[f], *(a[by] for a in some), counts)]
                    total, grads = sum(p[0] for p in found), sum(p[1] for p in found)
                    mean_loss[f] += nets.total_loss(plan.design, total, plan.alpha, plan.beta) / plan.batches(f)
                    sums[f] += total
                    step(plan.design, weights[f], optimisers[f], total, grads, plan.beta, epoch if plan.by_epoch else None)
        if by_rows:  # a network is stepped by one task, then told to all for their validation rows
            for told in _send(context, {f: weights[f] for f in mine_to_step}):
                weights |= told
        rows = []
        for f in weights:
            mine = np.flatnonzero(uses(group, f) & val) if len(x) else np.zeros(0, np.int64)
            if len(mine):
                out = nets.forward(plan.design, weights[f], x[mine])
                rows.append((f, "val", np.concatenate([nets.losses(plan.design, out, t[mine], y[mine]), counts(plan.design, out, t[mine], y[mine])]).tobytes()))
            if f in mine_to_step and (by_rows or context.partitionId() == 0):  # where all tasks step, they hold the same
                rows.append((f, "state", pickle.dumps((mean_loss[f], sums[f], weights[f], optimisers[f]), protocol=5)))
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.binary()), strict=True)], names=["f", "kind", "v"])

    found: dict[int, dict] = {f: {"checked": np.zeros(marks)} for f in weights}
    weights, optimisers = {}, {}
    for r in data.mapInArrow(run, SCHEMA, barrier=True).collect():  # a row for each task and model, and the networks once
        if r.kind == "val":
            found[r.f]["checked"] = found[r.f]["checked"] + np.frombuffer(r.v)
        else:
            found[r.f]["loss"], found[r.f]["trained"], weights[r.f], optimisers[r.f] = pickle.loads(r.v)
    held.destroy()
    return found, weights, optimisers
