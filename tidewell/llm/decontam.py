"""Size-partitioned MinHash search for short test items contained in long documents.

A set's signature is the smallest hash in each of a number of bins. Documents fall into
classes by the size of their shingle sets, items too; for each pair of classes the number
of bins follows from both bounds, so that an item at the threshold shares a bin's smallest
hash with its document but for a set chance. Signatures of documents are looked up among
those of items: long items need few bins, so most of a document's shingles are never
looked up for them, and short ones many. Candidates are verified by exact containment of
their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts_for, staged
from .shingles import HASH_BITS, THRESHOLD, shingle_sets, shingle_texts
from .textarrays import U64

#: Chance that a document holding an item at the threshold is not a candidate.
MISS = 1e-6
#: Items are searched for in blocks of so many shingles, 64 MB of hashes on each executor.
BLOCK_SHINGLES = 4_000_000
#: Bytes of text that weigh as much as a shingle, where a text repeats itself.
TEXT_BYTES = 16

_ITEMS = "item_id long, text string, shingles binary, n long, part int, weight long, upto long"
_PAIRS = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def load_for(least: int, threshold: float, miss: float) -> float:
    """Shingles for each bin at which items of ``least`` shingles or more are found.

    A shared shingle is its bin's smallest with chance (1 - exp(-x)) / x at x shingles a bin, and
    threshold * least of them are shared.
    """
    shared = max(1, math.ceil(threshold * least - 1e-9))
    need = 1 - miss ** (1 / shared)
    low, high = 1e-9, 64.0
    for _ in range(60):
        x = math.sqrt(low * high)
        low, high = (x, high) if -math.expm1(-x) / x >= need else (low, x)
    return low


def bin_bits(sizes: np.ndarray, load: float) -> np.ndarray:
    """Bits of the number of bins for documents of the given set sizes, by the upper bound of their class."""
    upper = np.ceil(np.log2(np.maximum(sizes, 1) + 1))
    return np.clip(np.ceil(upper - math.log2(load)), 0, 47).astype(np.uint64)


@dataclass
class Items:
    """A block of items with, for each class of sizes, the index of their signatures at every number of bins."""

    ids: list[int]
    texts: list[str]
    sets: list[np.ndarray]
    classes: list[tuple[int, float]]  # class and its load
    threshold: float = THRESHOLD

    def __post_init__(self) -> None:
        size = np.array([len(s) for s in self.sets], np.int64)
        owner = np.repeat(np.arange(len(self.sets), dtype=np.int32), size)
        self.size, self.begin = size, np.cumsum(size) - size
        self.hashes = np.concatenate(self.sets).astype(U64) if self.sets else np.zeros(0, U64)
        # a hash is its bin's smallest from so many bits on: where it parts from the one before it in its sorted set
        apart = np.zeros(len(self.hashes))
        apart[1:] = (self.hashes[1:] ^ self.hashes[:-1]).astype(np.float64)
        bits = np.maximum(0, int(HASH_BITS) + 1 - np.frexp(apart)[1]).astype(np.uint8)
        bits[(np.cumsum(size) - size)[size > 0]] = 0
        self.bits = bits
        # an item at the threshold shares one of its rarest shingles: all but as many as may be missing, and one
        _, inverse, count = np.unique(self.hashes, return_inverse=True, return_counts=True)
        order = np.lexsort((self.hashes, count[inverse], owner))
        rank = np.arange(len(order)) - self.begin[owner[order]]
        spare = size - np.ceil(self.threshold * size - 1e-9).astype(np.int64) + 1
        at = order[rank < spare[owner[order]]]
        at = at[np.argsort(self.hashes[at], kind="stable")]
        self.rare = (self.hashes[at], owner[at])
        cls = np.array([int(n).bit_length() for n in size], np.int64)[owner]
        self.signatures = {}
        for c, _ in self.classes:
            at = np.flatnonzero(cls == c)
            at = at[np.argsort(self.hashes[at], kind="stable")]
            self.signatures[c] = (self.hashes[at], owner[at], bits[at])


#: Matching entries of signatures that are spread out at once.
_SPREAD = 4_000_000


def document_signatures(bounds: np.ndarray, keys: np.ndarray, load: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the sets' signatures for items of one class, and the bits of each row's number of bins."""
    bits = bin_bits(np.diff(bounds), load)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    places = keys >> (HASH_BITS - bits)[row]
    first = np.ones(len(keys), bool)
    first[1:] = (row[1:] != row[:-1]) | (places[1:] != places[:-1])
    return np.flatnonzero(first), bits


def _spread_pairs(row: np.ndarray, low: np.ndarray, n: np.ndarray, owner: np.ndarray, items: int, kept=None) -> np.ndarray:
    """Distinct row * items + item of rows and the ``n`` entries from ``low`` that each matches; ``kept`` chooses among (entry, row)."""
    found = [np.zeros(0, np.int64)]
    upto = np.cumsum(n)
    for i, j in _stretches(upto, _SPREAD):
        entry = np.repeat(low[i:j] - (upto[i:j] - n[i:j]), n[i:j]) + np.arange(upto[i] - n[i], upto[j - 1])
        r = np.repeat(row[i:j], n[i:j])
        if kept is not None:
            some = kept(entry, r)
            entry, r = entry[some], r[some]
        found.append(np.unique(r * items + owner[entry]))
    return np.unique(np.concatenate(found))


def _matched(index: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which keys a sorted index holds, where, and how often."""
    low = np.searchsorted(index, keys)
    held = np.flatnonzero(index[np.minimum(low, len(index) - 1)] == keys) if len(index) else np.zeros(0, np.int64)
    return held, low[held], np.searchsorted(index, keys[held], side="right") - low[held]


def _tested(items: Items, pairs: np.ndarray, test) -> np.ndarray:
    """For each pair, how many of its item's hashes pass ``test`` (positions of hashes, rows)."""
    row, item = np.divmod(pairs, len(items.sets))
    n, out = items.size[item], np.zeros(len(pairs), np.int64)
    upto = np.cumsum(n)
    for i, j in _stretches(upto, _SPREAD):
        first = upto[i:j] - n[i:j]
        at = np.repeat(items.begin[item[i:j]] - first, n[i:j]) + np.arange(first[0], upto[j - 1])
        out[i:j] = np.add.reduceat(test(at, np.repeat(row[i:j], n[i:j])).astype(np.int64), first - first[0])
    return out


#: Items that a signature shingle is looked up for one by one; where more have it, those are tried that share a rarer shingle of theirs.
HOT = 32


def candidates(items: Items, bounds: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """row * items + item of the pairs whose signatures agree in a bin and whose sets' hashes meet the threshold; sets of a piece as from shingle_sets."""
    found = [np.zeros(0, np.int64)]
    n_items = len(items.sets)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    placed = row.astype(U64) << HASH_BITS | keys  # sorted
    holds = lambda index, r, h: index[np.minimum(np.searchsorted(index, q := r.astype(U64) << HASH_BITS | h), len(index) - 1)] == q
    for cls, load in items.classes:
        hashes, owner, from_bits = items.signatures[cls]
        if not len(hashes) or not len(keys):
            continue
        at, bits = document_signatures(bounds, keys, load)
        held, low, n = _matched(hashes, keys[at])
        r = row[at[held]]
        few = n <= HOT
        # the smallest of its bin among its item's too
        found.append(_spread_pairs(r[few], low[few], n[few], owner, n_items, lambda entry, r, from_bits=from_bits, bits=bits: from_bits[entry] <= bits[r]))
        if not few.all():
            some = np.isin(row, r[~few])
            held, low, n = _matched(items.rare[0], keys[some])
            pairs = _spread_pairs(row[some][held], low, n, items.rare[1], n_items)
            pairs = pairs[(items.size[pairs % n_items] >= 1 << (cls - 1)) & (items.size[pairs % n_items] < 1 << cls)]
            signed = placed[at]
            found.append(pairs[_tested(items, pairs, lambda i, r, signed=signed, bits=bits: (items.bits[i] <= bits[r]) & holds(signed, r, items.hashes[i])) > 0])
    pairs = np.unique(np.concatenate(found))
    shared = _tested(items, pairs, lambda i, r: holds(placed, r, items.hashes[i]))
    # hashes can only agree too often, so this drops no true pair
    return pairs[shared >= items.threshold * items.size[pairs % n_items] - 1e-9]


def _stretches(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges over which a running count grows by about ``most``."""
    i = 0
    while i < len(upto):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


#: Items whose shingles a task keeps as text.
_KEPT = 2000


def verify(items: Items, found: np.ndarray, text_of, known: dict[int, set[str]]) -> Iterator[tuple[int, int, int, int]]:
    """Candidates whose documents hold enough of the items' shingles: row, item, shingles, shared."""
    last, have = -1, set()
    for r, item in zip(*(x.tolist() for x in np.divmod(found, len(items.sets))), strict=True):
        if item not in known:
            if len(known) >= _KEPT:
                known.clear()
            known[item] = shingle_texts(items.texts[item])
        if r != last:
            last, have = r, shingle_texts(text_of(r))
        shared = len(known[item] & have)
        if shared >= items.threshold * len(known[item]) - 1e-9:
            yield r, item, len(known[item]), shared


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, upto = TaskContext.get().partitionId(), 0
    for b in batches:
        sets = []
        for _, bounds, keys in shingle_sets(b.column("text")):
            sets += [keys[bounds[i] : bounds[i + 1]].astype("<u8").tobytes() for i in range(len(bounds) - 1)]
        n = np.array([len(s) // 8 for s in sets], np.int64)
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        weight = np.where(n > 0, np.maximum(n, size // TEXT_BYTES), 0)
        before = upto + np.cumsum(weight) - weight
        upto += int(weight.sum())
        cols = [b.column("item_id").cast(pa.int64()), b.column("text"), pa.array(sets, pa.binary()), pa.array(n), pa.array([part] * b.num_rows, pa.int32()), pa.array(weight), pa.array(before)]
        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _ITEMS.split(", ")])


def _search(docs: DataFrame, held: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = held.value, {}
        for b in batches:
            ids, texts, out = b.column("doc_id").cast(pa.int64()), b.column("text"), []
            for first, bounds, keys in shingle_sets(texts):
                found = candidates(items, bounds, keys)
                for r, item, n, shared in verify(items, found, lambda r, first=first: texts[first + r].as_py(), known):
                    out.append((ids[first + r].as_py(), items.ids[item], n, shared, shared / n))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _PAIRS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PAIRS)


def contained_items(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, miss: float = MISS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Pairs of a document and a test item of which it holds ``threshold`` or more of the five-word shingles.

    Columns: ``doc_id, item_id, n_shingles`` (of the item)``, n_shared, containment``. The items are
    the query set: they go to the executors in blocks of a bounded number of shingles, dealt by
    running counts whatever their ids, and all documents are searched for each block. A block's
    matches are written before the driver collects the next, so it holds one at a time. Thus nothing is shuffled and no pair is formed that does not share
    a signature value.

    Null and empty texts, and texts of fewer than five words, have no shingles and match nothing; null ids stay
    null in the result; repeated rows match each; empty tables give no pairs; other columns are not read, whatever their names.
    Where more than HOT items share a signature shingle, a document that has it is paired with those alone of which it has a rarer shingle too, one
    of the few that an item at the threshold can't do without, and whose signatures agree. A task holds the words of about 1 MB of text, or of its longest.
    """
    spark = docs.sparkSession
    prepared = staged(items.select("item_id", F.col("text").cast("string")).mapInArrow(_item_sets, _ITEMS).where("n > 0"), "items")
    starts, total = [], 0
    for r in prepared.groupBy("part").agg(F.sum("weight").alias("weight")).orderBy("part").collect():  # one row for each task
        starts.append((r.part, total))
        total += r.weight
    dealt = prepared.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part")
    dealt = dealt.withColumn("block", F.expr(f"(start + upto) div {block_shingles}"))
    found = []
    blocks = parts_for(total, block_shingles)
    for i in range(blocks):
        held = spark.sparkContext.broadcast(_block(dealt.where(F.col("block") == i), threshold, miss))
        pairs = _search(docs, held)
        if i < blocks - 1:
            pairs = staged(pairs, "item-matches")
            held.destroy()
        found.append(pairs)
    return reduce(DataFrame.unionByName, found)


def _block(dealt: DataFrame, threshold: float, miss: float) -> Items:
    """The items of a block, which is of bounded size."""
    rows = dealt.select("item_id", "text", "shingles").collect()
    sets = [np.frombuffer(r.shingles, "<u8") for r in rows]
    classes = [(c, load_for(1 << (c - 1), threshold, miss)) for c in sorted({len(s).bit_length() for s in sets})]
    return Items([r.item_id for r in rows], [r.text for r in rows], sets, classes, threshold)


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that hold no test item, all their columns.

    Rows are judged by id and text, so a null or repeated id is judged by each of its texts; null and empty
    texts stay; repeated rows share a fate; empty tables drop nothing; columns of any names are kept. Long texts
    are as in contained_items.
    """
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.withColumn("_row_key", F.xxhash64(F.col("doc_id").cast("long"), text))
    hit = contained_items(keyed.select(F.col("_row_key").alias("doc_id"), "text"), items, **options).select(F.col("doc_id").alias("_row_key")).distinct()
    return keyed.join(hit, "_row_key", "left_anti").select(docs.columns)
