"""Documents' features: chunks matched against a bank of vectors and pooled by document."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from ..functions import vectors as V

MODES = ("max", "lsep", "gem", "topk", "attn", "stats", "noisyor")
#: Effective constants of the pooling modes.
TAU, POWER, TOP = 1.0, 1 + math.log(2), 3
#: Rows of a bank that is sent to all tasks; a bank's size is a setting of the model, not of the data.
MOST_BANK = 100_000


#: Rows of a group that one task compares; of larger groups, rows of a block of the grid.
LARGE = 20_000
#: Large groups that are told to all tasks; each has more than LARGE rows.
MOST_LARGE = 1_000_000
#: A cosine so little above a threshold is at it, as products are rounded (by some 1e-15). Chunks of 128 hashed words whose cosine isn't 0.9 differ from it by 2e-11 at least.
ROUNDING = 1e-12


def large_groups(rows: DataFrame, group: str = "doc_id", least: int | None = None) -> DataFrame:
    """``group, n_rows`` of the groups of more than ``least`` rows (LARGE if None)."""
    return rows.groupBy(group).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > (LARGE if least is None else least)) & F.col(group).isNotNull())


def drop_near_duplicates(vectors: DataFrame, threshold: float | None = 0.9, group: str = "doc_id", pos: str = "pos", emb: str = "emb", large: DataFrame | None = None) -> DataFrame:
    """Rows but those whose cosine with an earlier row of the group exceeds ``threshold``; one that is at it but for ``ROUNDING`` doesn't.

    An earlier row that is itself dropped still drops later ones. ``None`` drops nothing. Rows whose group or
    vector is null stay. One exchange brings groups together; a task walks them in order, a group at a time, and multiplies
    blocks of its unit vectors, so what it holds grows with one group. The groups of ``large`` (as ``large_groups`` gives; it may count rows
    before they have vectors) are dealt to blocks instead, and every pair of blocks is compared by itself: nothing holds such a group whole.
    """
    if threshold is None:
        return vectors
    if large is not None:
        large = large.select(group, F.ceil(F.col("n_rows") / (LARGE // 2)).cast("int").alias("_blocks")).limit(MOST_LARGE + 1)
        if (n := large.count()) > MOST_LARGE:
            raise ValueError(f"more than {MOST_LARGE} large groups")
        if n:
            large = F.broadcast(large)
            small = drop_near_duplicates(vectors.join(large.select(group), group, "left_anti"), threshold, group, pos, emb)
            return small.unionByName(_without_grid(vectors.join(large, group), threshold, group, pos, emb).select(vectors.columns))
    ordered = vectors.repartition(group).sortWithinPartitions(group, pos)
    return ordered.mapInArrow(_dropping(threshold, group, pos, emb), vectors.schema)


#: A step over a partition's batches.
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _dropping(threshold: float, group: str, pos: str, emb: str) -> Step:
    """Rows of whole groups, in order, without near-duplicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for b in _cut(whole):
                ids = b.column(group).to_pylist()
                last = next((i for i in range(len(ids) - 1, -1, -1) if ids[i] != ids[-1]), -1)
                if last < 0 and (not held or held[-1].column(group)[-1].as_py() == ids[-1]):
                    held.append(b)  # the same group goes on
                    continue
                yield from _distinct_rows(pa.Table.from_batches([*held, b.slice(0, last + 1)]), threshold, group, pos, emb)
                held = [b.slice(last + 1)]
        if held:
            yield from _distinct_rows(pa.Table.from_batches(held), threshold, group, pos, emb)

    return run


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in blocks of rows, so that what is made of one stays small."""
    for i in range(0, batch.num_rows, _BLOCK):
        yield batch.slice(i, _BLOCK)


def _without_grid(rows: DataFrame, threshold: float, group: str, pos: str, emb: str) -> DataFrame:
    """Rows of large groups (with ``_blocks``) but those that a row of an earlier position drops, found by pairs of blocks."""
    keyed = rows.withColumn("_of", F.xxhash64(pos, emb))  # rows of one position and vector share a fate
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = keyed.where(F.col(emb).isNotNull()).withColumn("_block", F.pmod(F.xxhash64(pos), F.col("_blocks")).cast("int")).withColumn("_other", other)
    pairs = dealt.select(group, pos, emb, "_of", "_block", F.least("_block", "_other").alias("_one"), F.greatest("_block", "_other").alias("_two"))
    key = [rows.schema[c] for c in (group, pos)]

    def compare(some: pa.Table) -> pa.Table:
        x = some.column(emb).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        at, block = some.column(pos).to_numpy(), some.column("_block").to_numpy()
        one, two = some.column("_one")[0].as_py(), some.column("_two")[0].as_py()
        left, right = (np.flatnonzero(block == b) for b in (one, two))
        drops = np.zeros(some.num_rows, bool)
        for i in range(0, len(left), _BLOCK):
            for j in range(0, len(right), _BLOCK):
                p, q = left[i : i + _BLOCK], right[j : j + _BLOCK]
                close = x[p] @ x[q].T > threshold + ROUNDING
                drops[p] |= (close & (at[q][None, :] < at[p][:, None])).any(1)
                drops[q] |= (close & (at[p][:, None] < at[q][None, :])).any(0)
        return some.filter(pa.array(drops)).select([group, pos, "_of"])

    dropped = pairs.groupBy(group, "_one", "_two").applyInArrow(compare, StructType([*key, StructField("_of", LongType())])).distinct()
    return keyed.join(dropped, [group, pos, "_of"], "left_anti")


#: Rows of a block of a group's vectors.
_BLOCK = 2048


def _distinct_rows(rows: pa.Table, threshold: float, group: str, pos: str, emb: str) -> Iterator[pa.RecordBatch]:
    """Whole groups, ordered by group and position, without near-duplicates."""
    rows = rows.combine_chunks()
    there = np.flatnonzero(rows.column(emb).is_valid().to_numpy() & rows.column(group).is_valid().to_numpy())
    keep = np.ones(rows.num_rows, bool)
    if len(there):
        some = rows.take(pa.array(there))
        x = some.column(emb).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(there), -1)
        ids, places = some.column(group).to_pylist(), some.column(pos).to_numpy()
        length = np.linalg.norm(x, axis=1)
        starts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
            for i in range(a, b, _BLOCK):
                later = slice(i, min(b, i + _BLOCK))
                drops = np.zeros(later.stop - i, bool)
                for j in range(a, later.stop, _BLOCK):
                    earlier = slice(j, min(later.stop, j + _BLOCK))
                    close = x[later] @ x[earlier].T > (threshold + ROUNDING) * np.maximum(np.outer(length[later], length[earlier]), 1e-12)
                    drops |= (close & (places[earlier][None, :] < places[later][:, None])).any(1)
                keep[there[later]] = ~drops
    yield from rows.filter(pa.array(keep)).to_batches()


def match(vectors: DataFrame, bank: DataFrame, emb: str = "emb") -> DataFrame:
    """A row for each chunk and bank vector with their cosine ``s``, and ``at``, the vector's place in the bank, of ``n_bank``.

    The bank (conf_idx, head, vec) is checked and broadcast.
    """
    n = bank.count()
    if n > MOST_BANK:
        raise ValueError(f"a bank has at most {MOST_BANK} vectors")
    place = F.row_number().over(Window.orderBy("conf_idx", "head")) - 1  # of a bank's few rows
    unit = bank.select("conf_idx", "head", place.cast("int").alias("at"), F.lit(n).alias("n_bank"), V.normalised("vec").alias("vec"))
    keep = [c for c in vectors.columns if c != emb]
    return vectors.select(*keep, V.normalised(emb).alias("_e")).crossJoin(F.broadcast(unit)).select(*keep, "conf_idx", "head", "at", "n_bank", V.dot("_e", "vec").alias("s"))


def pooled(mode: str, s: Column | str = "s", tau: float = TAU, power: float = POWER, top: int = TOP) -> list[Column]:
    """Aggregates of a similarity column: one feature, or mean and spread for ``stats``."""
    s = F.col(s) if isinstance(s, str) else s
    if mode == "max":
        return [F.max(s)]
    if mode == "lsep":
        return [tau * F.ln(F.sum(F.exp(s / tau)))]
    if mode == "gem":
        return [F.pow(F.avg(F.pow(F.greatest(s, F.lit(0.0)) + 1e-6, F.lit(power))), F.lit(1 / power))]
    if mode == "topk":
        best = F.slice(F.sort_array(F.collect_list(s), asc=False), 1, top)  # a document's chunks
        return [F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)]
    if mode == "attn":
        return [F.sum(F.exp(s / tau) * V.clip(s, -50.0, 50.0)) / F.sum(F.exp(s / tau))]
    if mode == "stats":
        return [F.avg(s), F.sqrt(F.var_pop(s) + 1e-6)]
    if mode == "noisyor":
        p = V.clip(V.sigmoid(s / tau), 1e-6, 1 - 1e-6)
        some = 1 - F.exp(F.sum(F.log1p(-p)))
        return [F.ln(some / (1 - some))]
    raise ValueError(f"unknown pooling mode {mode!r}; known: {', '.join(MODES)}")


def pool(matches: DataFrame, mode: str = "attn", group: str = "doc_id", **constants) -> DataFrame:
    """``group, feat_idx, value`` of the rows of ``match``: a feature for each bank vector, two for ``stats`` (all means first)."""
    columns = pooled(mode, **constants)
    out = matches.groupBy(group, "at", "n_bank").agg(*[c.alias(f"v{i}") for i, c in enumerate(columns)])
    parts = [F.struct((F.col("at") + i * F.col("n_bank")).cast("int").alias("feat_idx"), F.col(f"v{i}").alias("value")) for i in range(len(columns))]
    return out.select(group, F.inline(F.array(*parts)))


# --- matching and pooling in one pass ---------------------------------------------
# A state is a few numbers for each bank vector; a chunk's similarities are states of one chunk, and states of one document merge.


def _lifted(mode: str, s: np.ndarray, tau: float, power: float, top: int) -> list[np.ndarray]:
    """States of single chunks, from their similarities (chunks by bank)."""
    if mode == "max":
        return [s]
    if mode == "lsep":
        return [s / tau, np.ones_like(s)]
    if mode == "attn":
        return [s / tau, np.ones_like(s), np.clip(s, -50.0, 50.0)]
    if mode == "gem":
        return [(np.maximum(s, 0.0) + 1e-6) ** power]
    if mode == "topk":
        return [s, *[np.full_like(s, -np.inf)] * (top - 1)]
    if mode == "stats":
        return [s, np.zeros_like(s)]
    if mode == "noisyor":
        return [np.log1p(-np.clip(1 / (1 + np.exp(-s / tau)), 1e-6, 1 - 1e-6))]
    raise ValueError(f"unknown pooling mode {mode!r}; known: {', '.join(MODES)}")


def _merged(mode: str, state: list[np.ndarray], n: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """States and chunk counts of runs of rows that begin at ``starts``."""
    add = lambda x: np.add.reduceat(x, starts)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))
    total = add(n)
    if mode == "max":
        return [np.maximum.reduceat(state[0], starts)], total
    if mode in ("lsep", "attn"):  # running sums of exponentials, relative to the greatest
        most = np.maximum.reduceat(state[0], starts)
        scale = np.exp(state[0] - most[run])
        return [most, *(add(x * scale) for x in state[1:])], total
    if mode == "topk":
        every, found = np.concatenate(state), []
        at = np.tile(run, len(state))
        order = np.argsort(at, kind="stable")
        every, firsts = every[order], np.searchsorted(at[order], np.arange(len(starts)))
        at, place = at[order], np.arange(len(order))[:, None]
        for _ in state:
            best = np.maximum.reduceat(every, firsts)
            found.append(best)
            taken = np.minimum.reduceat(np.where(every == best[at], place, len(order)), firsts)  # one of those that tie
            every[taken, np.arange(every.shape[1])] = -np.inf
        return found, total
    if mode == "stats":  # means and sums of squares about them
        mean = add(state[0] * n[:, None]) / np.maximum(total, 1)[:, None]
        return [mean, add(state[1] + n[:, None] * (state[0] - mean[run]) ** 2)], total
    return [add(state[0])], total


def _finished(mode: str, state: list[np.ndarray], n: np.ndarray, tau: float, power: float, top: int) -> np.ndarray:
    """Features of documents of ``n`` chunks: one for each bank vector, two for ``stats``."""
    n = n[:, None]
    if mode == "max":
        return state[0]
    if mode == "lsep":
        return tau * (state[0] + np.log(state[1]))
    if mode == "attn":
        return state[2] / state[1]
    if mode == "gem":
        return (state[0] / n) ** (1 / power)
    if mode == "topk":
        return sum(np.where(np.isneginf(t), 0.0, t) for t in state) / np.minimum(n, top)
    if mode == "stats":
        return np.hstack([state[0], np.sqrt(state[1] / n + 1e-6)])
    some = -np.expm1(state[0])
    return np.log(some / (1 - some))


def bank_matrix(bank: DataFrame) -> np.ndarray:
    """Unit vectors of a bank (conf_idx, head, vec) of checked size, in order."""
    if bank.count() > MOST_BANK:
        raise ValueError(f"a bank has at most {MOST_BANK} vectors")
    rows = bank.orderBy("conf_idx", "head").select(V.normalised("vec").alias("vec")).collect()
    return np.array([r.vec for r in rows], np.float64)


def pooled_features(vectors: DataFrame, bank: DataFrame, mode: str = "attn", group: str = "doc_id", emb: str = "emb", stretch: bool = False, tau: float = TAU, power: float = POWER, top: int = TOP, distinct: float | None = None, pos: str = "pos") -> DataFrame:
    """``group, features``: what ``pool`` makes of ``match``, as an array in the bank's order.

    A task multiplies its chunks by the bank and merges what belongs to one document at once, so a state a document leaves it, not a
    row for each chunk and bank vector; states of a document that several tasks hold are merged after one exchange. ``stretch``:
    similarities are stretched by arctanh first. Chunks without a vector don't count; a document with none has no row. ``distinct``: what ``drop_near_duplicates``
    drops at this cosine, by ``pos``, doesn't count; as that brings groups together, one task drops, matches and merges, in one Python process.
    """
    if mode not in MODES:
        raise ValueError(f"unknown pooling mode {mode!r}; known: {', '.join(MODES)}")
    matrix = bank_matrix(bank)
    k = len(matrix)
    held = vectors.sparkSession.sparkContext.broadcast(matrix)
    key = vectors.schema[group]
    partial = StructType([key, StructField("n", LongType()), StructField("state", BinaryType())])

    def groups(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """An order that brings groups together, and where each begins in it."""
        codes = np.nan_to_num(ids.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.float64), nan=-1)
        order = np.argsort(codes, kind="stable")
        return order, np.flatnonzero(np.concatenate([[True], np.diff(codes[order]) != 0]))

    def unpacked(states: pa.Array) -> list[np.ndarray]:
        every = np.frombuffer(b"".join(states.to_pylist())).reshape(len(states), -1, k)
        return [every[:, i] for i in range(every.shape[1])]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = held.value
        for b in batches:
            for some in _cut(b.filter(b.column(emb).is_valid())):
                order, starts = groups(some.column(group))
                x = some.column(emb).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)[order]
                s = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ unit.T
                if stretch:
                    s = np.arctanh(np.clip(s, -0.999, 0.999))
                state, n = _merged(mode, _lifted(mode, s, tau, power, top), np.ones(len(s), np.int64), starts)
                stacked = np.stack(state, 1)
                yield pa.RecordBatch.from_arrays([some.column(group).take(pa.array(order[starts])), pa.array(n), pa.array([row.tobytes() for row in stacked], pa.binary())], names=[group, "n", "state"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None  # of one group, which may go on

        def done(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            ids = rows.column(group).combine_chunks()
            order, starts = groups(ids)
            n = rows.column("n").to_numpy()[order]
            state, total = _merged(mode, [x[order] for x in unpacked(rows.column("state"))], n, starts)
            made = _finished(mode, state, total, tau, power, top)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, made.shape[1]), pa.int32()), pa.array(made.ravel()))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(order[starts])), lists], names=[group, "features"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b]) if last is None else pa.concat_tables([last, pa.Table.from_batches([b])])
            ids = rows.column(group).to_pylist()
            cut = next((i + 1 for i in range(len(ids) - 2, -1, -1) if ids[i] != ids[-1]), 0)
            if cut:
                yield done(rows.slice(0, cut))
            last = rows.slice(cut)
        if last is not None:
            yield done(last)

    made = StructType([key, StructField("features", ArrayType(DoubleType()))])
    if distinct is not None and k:
        drop = _dropping(distinct, group, pos, emb)
        return vectors.select(group, pos, emb).repartition(group).sortWithinPartitions(group, pos).mapInArrow(lambda batches: merge(match(drop(batches))), made)
    states = vectors.select(group, emb).mapInArrow(match, partial)
    if not k:
        return states.select(group).distinct().withColumn("features", F.array().cast("array<double>"))
    return states.repartition(group).sortWithinPartitions(group).mapInArrow(merge, made)


def closest(vectors: DataFrame, bank: DataFrame, k: int = 10, group: str = "doc_id", pos: str = "pos", emb: str = "emb", digits: int | None = None) -> DataFrame:
    """Of the rows of ``match``, at least the ``k`` of the highest cosine ``s`` for each bank vector, ties by ``group`` and ``pos``: each task's own ``k``.

    Columns: those of ``vectors`` but ``emb``, ``conf_idx``, ``head``, ``s``, rounded to ``digits`` (half away from zero) before it is compared. A task
    multiplies its rows by the bank and keeps no more than what it will send. Rows without a vector don't count.
    """
    if bank.count() > MOST_BANK:
        raise ValueError(f"a bank has at most {MOST_BANK} vectors")
    named = bank.orderBy("conf_idx", "head").select("conf_idx", "head", V.normalised("vec").alias("vec")).collect()
    names = [(r.conf_idx, r.head) for r in named]
    held = vectors.sparkSession.sparkContext.broadcast(np.array([r.vec for r in named], np.float64))
    kept = [f for f in vectors.schema.fields if f.name != emb]
    schema = StructType([*kept, bank.schema["conf_idx"], bank.schema["head"], StructField("s", DoubleType())])
    kinds = [to_arrow_type(bank.schema[c].dataType) for c in ("conf_idx", "head")]
    order = [("_at", "ascending"), ("s", "descending"), (group, "ascending"), (pos, "ascending")]

    def best(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
        at = rows.column("_at").to_numpy()
        return rows.take(pa.array(np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) < k))).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, found = held.value, None
        floor = np.full(len(unit), -np.inf)
        for b in batches:
            for some in _cut(b.filter(b.column(emb).is_valid())) if len(unit) else ():
                x = some.column(emb).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
                s = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ unit.T
                if digits is not None:
                    s = np.copysign(np.floor(np.abs(s) * 10.0**digits + 0.5) / 10.0**digits, s) + 0.0
                least = np.partition(s, len(s) - k, axis=0)[len(s) - k] if len(s) > k else np.full(len(unit), -np.inf)
                row, at = np.nonzero(~(s < np.maximum(floor, least)))
                if not len(row):
                    continue
                taken = pa.Table.from_batches([some.select([f.name for f in kept])]).take(pa.array(row))
                taken = taken.append_column("_at", pa.array(at)).append_column("s", pa.array(s[row, at]))
                found = best(taken if found is None else pa.concat_tables([found, taken]))
                at, kth = found.column("_at").to_numpy(), found.column("s").to_numpy()
                full = np.flatnonzero(np.bincount(at, minlength=len(unit)) == k)
                floor[full] = kth[np.searchsorted(at, full, side="right") - 1]
        if found is not None:
            at = found.column("_at").to_numpy()
            named = [pa.array([names[i][c] for i in at], kinds[c]) for c in (0, 1)]
            out = found.drop_columns(["_at", "s"])
            for name, column in zip(("conf_idx", "head", "s"), (*named, found.column("s")), strict=True):
                out = out.append_column(name, column)
            yield from out.combine_chunks().to_batches()

    return vectors.mapInArrow(run, schema)


def long_features(features: DataFrame, group: str = "doc_id") -> DataFrame:
    """``group, feat_idx, value`` of arrays of features."""
    return features.select(group, F.posexplode("features").alias("feat_idx", "value"))


def mean_vectors(vectors: DataFrame, group: str = "doc_id", emb: str = "emb") -> DataFrame:
    """Features without a bank: the mean of a document's vectors."""
    return vectors.select(group, F.posexplode(V.doubles(emb)).alias("feat_idx", "x")).groupBy(group, "feat_idx").agg(F.avg("x").alias("value"))


def moments(features: DataFrame, key: str = "feat_idx", value: str = "value") -> DataFrame:
    return features.groupBy(key).agg(F.avg(value).alias("mu"), F.var_pop(value).alias("var"))


def standardise(features: DataFrame, fitted: DataFrame | None = None, key: str = "feat_idx", value: str = "value", eps: float = 1e-5) -> DataFrame:
    """``(x - mean) / sqrt(variance + eps)`` by feature, with moments of training rows if given."""
    rows = moments(features, key, value) if fitted is None else fitted  # a row for each feature, as many as the checked bank has
    keep = [c for c in features.columns if c != value]
    return features.join(F.broadcast(rows), key).select(*keep, ((F.col(value) - F.col("mu")) / F.sqrt(F.col("var") + eps)).alias(value))
