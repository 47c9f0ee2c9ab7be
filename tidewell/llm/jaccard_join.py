"""Self-join of documents by the Jaccard similarity of their five-word shingles.

Texts with one shingle set are one text from the start. A MinHash LSH forest finds
candidates: each tree is a trie of label sequences, held as one sorted run of rows that
Spark splits by range. A text starts at the longest prefix and shortens it until pairs at
the least similarity that its size allows would meet with the target recall; the texts
of the trie node that it then stands at, and of those it passed, are its candidates. The
first text of a node in sorted order is the node's hub. Texts with one hub are gathered,
without following links any further, and all pairs of a gathered set are compared
exactly, large sets in blocks by blocks, each pair only at the smallest hub that both
have, so that every similar pair is counted once and none is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import has_plain_ids, one_of_each, parts_for, staged
from .shingles import THRESHOLD, exact_sets, shingle_sets, shingle_texts
from .textarrays import U64, mix

TREES = 32
#: Labels of a path, four to each of a key's two halves, and bits of a label.
LONGEST, LABEL_BITS = 8, 14
#: Share of pairs at the threshold that must meet in a tree; of more similar pairs, more do.
RECALL = 0.99999
#: Texts of a block.
BLOCK = 512
#: Shingles, and texts, of the small sets that are compared together, and rows of the forest that one task walks.
BIN, BIN_TEXTS, WALK = 300_000, 2000, 300_000
#: Names of rows whose texts are read again are told to all tasks up to so many, some 64 MB; beyond, texts are shuffled to meet them.
BROADCAST_ROWS = 1_000_000
#: Columns of an incidence matrix at once.
_WIDTH = 4096

_SIGNED = "doc_id long, named boolean, t long, x binary, v long, n long, paths binary"


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """The longest prefix at which pairs at the threshold meet with the target recall."""
    for depth in range(longest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("no prefix reaches the target recall; more trees are needed")


@lru_cache(maxsize=1000)
def least_similarity(n: int, threshold: float) -> float:
    """The least similarity of the threshold or more that a set of ``n`` can have with a different set."""
    least = 1.0
    if n > 200:
        return threshold
    for m in range(1, int(n / threshold) + 2):
        shared = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
        if shared <= min(n, m) and shared < max(n, m):
            least = min(least, shared / (n + m - shared))
    return least


def own_depths(sizes: np.ndarray, threshold: float, recall: float) -> np.ndarray:
    """How far each text shortens its prefix."""
    names, inverse = np.unique(np.minimum(sizes, 201), return_inverse=True)
    return np.array([prefix_length(max(threshold, least_similarity(int(n), threshold)), recall=recall) for n in names], np.int64)[inverse]


def _identity(bounds: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set: a sum over mixed members; 0 for no members."""
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(keys + U64(1)), dtype=U64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.int64)


def _minima(bounds: np.ndarray, keys: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima of each non-empty row's set, a row each."""
    x = (keys >> U64(16)).astype(np.uint32)
    rows = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((count, len(rows)), np.uint32)
    for j in range(count):
        seed = mix(np.array([2 * j + 1, 2 * j + 2], U64))
        out[j] = np.minimum.reduceat((x ^ np.uint32(seed[1] >> U64(32))) * (np.uint32(seed[0] >> U64(32)) | np.uint32(1)) + np.uint32(seed[1] & U64(0xFFFFFFFF)), rows)
    return out


def _paths(minima: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Each text's path in each tree as two longs: tree and four labels, then four labels and the text's own depth."""
    labels = (minima * np.uint32(0x9E3779B1) >> np.uint32(32 - LABEL_BITS)).astype(np.int64).reshape(TREES, LONGEST, -1)
    out = np.zeros((minima.shape[1], TREES, 2), "<i8")
    for t in range(TREES):
        for half in (0, 1):
            key = np.full(minima.shape[1], 0 if half else t, np.int64)
            for j in range(4):
                key = key << LABEL_BITS | labels[t, 4 * half + j]
            out[:, t, half] = key << 4 | depths if half else key
    return out


def _signatures(batches: Iterator[pa.RecordBatch], threshold: float, recall: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id").cast(pa.int64())
        for first, bounds, keys in shingle_sets(b.column("text"), short=True):
            n = np.diff(bounds)
            full = n > 0
            paths: list[bytes | None] = [None] * len(n)
            if full.any():
                made = _paths(_minima(bounds, keys, TREES * LONGEST), own_depths(n[full], threshold, recall))
                for i, row in zip(np.flatnonzero(full).tolist(), made, strict=True):
                    paths[i] = row.tobytes()
            names = pa.array(_identity(bounds, keys), pa.int64(), mask=~full)
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(n)), *(b.column(c).slice(first, len(n)) for c in ("named", "t", "x")), names, pa.array(n, pa.int64()), pa.array(paths, pa.binary())], names=[x.split()[0] for x in _SIGNED.split(", ")])


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text and tree."""
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            some = b.slice(at, 2000)
            keys = np.frombuffer(b"".join(some.column("paths").to_pylist()), "<i8").reshape(-1, 2)
            v = np.repeat(some.column("v").to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(v)], names=["k1", "k2", "v"])


_WALKED = "part int, depth int, hub long, v long, opens boolean, k1 long, k2 long, last_k1 long, last_k2 long"


def _walk(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    """Hubs of the texts of a sorted stretch of the forest, from the longest prefixes up.

    A node counts if one of its texts shortens its prefix to just there. What begins or ends the
    stretch may go on in its neighbours: such nodes always count, the texts of the first are marked
    (``opens``), and for each depth one row without ``v`` tells the first key, the last key and the hub of the last node.
    """
    part = TaskContext.get().partitionId()
    whole = [b for b in batches if b.num_rows]
    if not whole:
        return
    k1, k2, v = (np.concatenate([b.column(c).to_numpy() for b in whole]) for c in ("k1", "k2", "v"))
    own, labels = k2 & 15, k2 >> 4
    n = len(v)
    out: list[list[np.ndarray]] = []
    for depth in range(LONGEST, shortest - 1, -1):
        a, c = (k1, labels >> LABEL_BITS * (LONGEST - depth)) if depth > 4 else (k1 >> LABEL_BITS * (4 - depth), np.zeros(n, np.int64))
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
        size = np.diff(np.append(starts, n))
        counts = (np.maximum.reduceat(own == depth, starts)) & (size > 1)
        counts[[0, -1]] = True
        hub = np.repeat(v[starts], size)
        at = np.flatnonzero(np.repeat(counts, size) & ((v != hub) | (np.arange(n) < size[0])))
        zeros = np.zeros(len(at), np.int64)
        out.append([zeros + depth, hub[at], v[at], at < size[0], *[zeros] * 4])
        out.append([np.array([x]) for x in (depth, v[starts[-1]], 0, False, a[0], c[0], a[-1], c[-1])])
    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
    ends = np.concatenate([np.full(len(x[0]), i % 2 == 1) for i, x in enumerate(out)])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(ends), part, np.int32)), pa.array(cols[0].astype(np.int32)), pa.array(cols[1]), pa.array(cols[2], pa.int64(), mask=ends), pa.array(cols[3].astype(bool)), *(pa.array(x.astype(np.int64)) for x in cols[4:])],
        names=[x.split()[0] for x in _WALKED.split(", ")],
    )


def _continued(ends: list) -> list[tuple[int, int, int]]:
    """(part, depth, hub) for every stretch whose first node began in an earlier one: that node's hub.

    ``ends`` has a row for each stretch and depth, whatever the number of texts.
    """
    found = []
    before: dict[int, tuple[tuple[int, int], int]] = {}
    for r in sorted(ends, key=lambda r: (r.part, r.depth)):
        hub = r.hub
        if r.depth in before and before[r.depth][0] == (r.k1, r.k2):
            found.append((r.part, r.depth, before[r.depth][1]))
            if (r.k1, r.k2) == (r.last_k1, r.last_k2):
                hub = before[r.depth][1]
        before[r.depth] = ((r.last_k1, r.last_k2), hub)
    return found


def candidate_hubs(texts: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``hub, v``: for each text (``v, paths``) the other texts that are hubs of trie nodes which it shares."""
    shortest = prefix_length(threshold, recall=recall)
    stretches = parts_for(texts.count() * TREES, WALK)
    leaves = texts.select("v", "paths").mapInArrow(_leaves, "k1 long, k2 long, v long")
    ordered = leaves.repartitionByRange(stretches, "k1", "k2", "v").sortWithinPartitions("k1", "k2", "v")
    walked = staged(ordered.mapInArrow(lambda b: _walk(b, shortest), _WALKED), "forest")
    goes_on = _continued(walked.where("v IS NULL").collect())
    edges = walked.where("v IS NOT NULL")
    if goes_on:
        earlier = texts.sparkSession.createDataFrame(goes_on, "part int, depth int, earlier long").withColumn("opens", F.lit(True))
        edges = edges.join(F.broadcast(earlier), ["part", "depth", "opens"], "left").withColumn("hub", F.coalesce("earlier", "hub"))
    return edges.where("hub <> v").select("hub", "v").distinct()


def _set_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each text's shingles, sorted."""
    for b in batches:
        made = [hashlib.sha256("\n".join(sorted(shingle_texts(t.as_py(), short=True))).encode("utf-8", "surrogatepass")).digest() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("v"), b.column("x"), pa.array(made, pa.binary())], names=["v", "x", "d"])


def _told_apart(signed: DataFrame, keyed: DataFrame) -> DataFrame:
    """``signed`` with names that no two sets share: one text of each wording under a name is held against the name's first.

    Names are sums of hashes. Where texts that differ (by SHA-256, ``x``) share one, their shingles are compared, and those
    unlike the first's get names of their own.
    """
    wordings = staged(signed.where("v IS NOT NULL").groupBy("v", "x").agg(F.min("doc_id").alias("one")), "wordings")
    several = staged(wordings.join(wordings.groupBy("v").count().where("count > 1").select("v"), "v", "left_semi"), "several-wordings")
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    texts = keyed.select(F.col("doc_id").alias("one"), "x", "text").join(several, ["one", "x"])
    digests = staged(texts.select("v", "x", "text").mapInArrow(_set_digests, "v long, x binary, d binary").distinct(), "set-digests")
    first = digests.groupBy("v").agg(F.min_by("d", "x").alias("first"))
    unlike = staged(digests.join(first, "v").where("d <> first").select("v", "x", F.xxhash64("d", "v").alias("new")), "unlike-sets")
    if unlike.isEmpty():
        return signed
    return staged(signed.join(unlike, ["v", "x"], "left").withColumn("v", F.coalesce("new", "v")).drop("new"), "told-apart")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products of incidence matrices."""
    a, b = (np.concatenate(x) if x else np.zeros(0, U64) for x in (left, right))
    common = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)

    def places(values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        held = common[col] == values if len(common) else np.zeros(len(values), bool)
        order = np.argsort(col[held], kind="stable")
        return row[held][order], col[held][order]

    (ra, ca), (rb, cb) = places(a, left), places(b, right)
    for at in range(0, len(common), _WIDTH):
        width = min(_WIDTH, len(common) - at)
        sides = []
        for rows, cols, n in ((ra, ca, len(left)), (rb, cb, len(right))):
            i, j = np.searchsorted(cols, [at, at + width])
            side = np.zeros((n, width), np.float32)
            side[rows[i:j], cols[i:j] - at] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _labels(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name that each node reaches."""
    labels = names.copy()
    while True:
        reached = np.where(linked, labels[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(labels, reached)
        if (new == labels).all():
            return labels
        labels = new


def _compare(group: pa.Table, threshold: float) -> pa.Table:
    """Exact links within small sets, or between two blocks of a large one, of pairs that no smaller hub gathers too."""
    order = group.sort_by([("hub", "ascending"), ("one", "ascending"), ("two", "ascending"), ("v", "ascending")]).combine_chunks()
    hub, v, size, block, one, two = (order.column(c).to_numpy() for c in ("hub", "v", "size", "block", "one", "two"))
    hubs = order.column("hubs").to_pylist()
    sets = exact_sets(order.column("text"))
    n_set = np.array([len(x) for x in sets], np.float64)
    out: list[list] = [[], [], [], []]
    new = (hub[1:] != hub[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    starts = np.flatnonzero(np.concatenate([[True], new])) if len(v) else []
    for a, b in zip(starts, [*starts[1:], len(v)], strict=True):
        at = np.arange(a, b)
        apart = one[a] != two[a]
        left, right = (at[block[at] == one[a]], at[block[at] == two[a]]) if apart else (at, at)
        shared = shared_counts([sets[i] for i in left], [sets[i] for i in right]).astype(np.float64)
        linked = shared >= threshold * (n_set[left][:, None] + n_set[right][None, :] - shared) - 1e-9
        if not apart:
            np.fill_diagonal(linked, False)
        if not linked.any():
            continue
        smaller = [np.array(sorted(h for h in hubs[i] if h < hub[a]), np.int64) for i in at]
        if any(len(x) for x in smaller):
            linked &= shared_counts([smaller[i - a] for i in left], [smaller[i - a] for i in right]) == 0
        if apart:
            square = np.zeros((len(at), len(at)), bool)
            square[: len(left), len(left) :] = linked
            square |= square.T
            labels = _labels(square, np.concatenate([v[left], v[right]]))
            parts = [(left, linked @ size[right], linked.sum(1), labels[: len(left)]), (right, linked.T @ size[left], linked.sum(0), labels[len(left) :])]
        else:
            parts = [(left, linked @ size[left], linked.sum(1), _labels(linked, v[left]))]
        for i, links, found, label in parts:
            some = found > 0
            for col, x in zip(out, (v[i], links, found, label), strict=True):
                col.append(x[some])
    cols = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
    return pa.table([pa.array(c) for c in cols], names=["v", "links", "text_links", "label"])


def _key() -> Column:
    """What names a row to read its text again: its id, or its text where it has none."""
    return F.coalesce(F.col("doc_id").cast("long"), _text_hash())


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, class_id, text_id, n_copies, n_links, n_text_links``.

    ``class_id`` is the smallest doc_id that similar texts lead to, ``text_id`` the smallest with the
    same shingle set and ``n_copies`` how many rows have it. ``n_links`` counts the other rows with a Jaccard
    similarity of ``threshold`` or more, ``n_text_links`` the other shingle sets among them.

    A text of one to four words is one shingle of all its words; texts without words, null ones
    among them, are alone, with no links. Null ids get the name that their text's hash gives while
    the join runs and stay null in ``doc_id``; repeated rows are copies; an empty table gives an empty one; other
    columns are not read. Copies never meet the forest. The forest is cut by ranges of whole paths, so a prefix
    that a third of all texts share is walked in many tasks and gives one row to each text; the blocks of a large
    gathered set are compared in tasks of two blocks. A task holds the words of about 1 MB of text, or of its
    longest, and, when it compares, the sets of two blocks. Hashes only find candidates and equal sets: shingles are compared
    by their words, and texts of unlike wording under one name by their shingles.
    Options are those of ``_joined``.
    """
    out = _joined(docs, **options)
    return out.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named", "t", "label")


def _joined(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """What jaccard_join returns, with the names of rows without id in ``doc_id`` and ``named`` for the others,
    and ``t`` (the text's hash) and ``label`` (the class; null without words)."""
    keyed = docs.select(_key().alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), _text_hash().alias("t"), F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("x"), F.col("text").cast("string"))
    signed = _told_apart(staged(keyed.mapInArrow(lambda b: _signatures(b, threshold, recall), _SIGNED), "signatures"), keyed)
    texts = staged(signed.where("v IS NOT NULL").groupBy("v").agg(F.min("doc_id").alias("text_id"), F.min_by("x", "doc_id").alias("x"), F.count("*").alias("size"), F.max("n").alias("n"), F.first("paths").alias("paths")), "texts")
    edges = staged(candidate_hubs(texts, threshold, recall), "hubs")
    members = edges.unionByName(edges.select("hub", F.col("hub").alias("v")).distinct())
    large = members.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    hubs = members.groupBy("v").agg(F.collect_set("hub").alias("hubs"))  # at most one for each tree and depth, and itself
    members = members.join(large, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = staged(members.join(hubs, "v").join(texts.select("v", "text_id", "x", "size", "n"), "v").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")), "members")
    n, weight = members.agg(F.count("*"), F.sum("n")).first()
    ids = members.select(F.col("text_id").alias("doc_id"), "x", "v").distinct()
    rows = keyed.select("doc_id", "x", "text").join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, ["doc_id", "x"]).select("v", "text").dropDuplicates(["v"])  # rows that repeat id and text are one
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = members.join(rows, "v").withColumn("other", other).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    small = F.col("blocks") == 1
    bins = max(parts_for(weight or 0, BIN), parts_for(n, BIN_TEXTS))
    place = F.when(small, F.xxhash64(F.pmod(F.xxhash64("hub"), F.lit(bins)))).otherwise(F.xxhash64("hub", "one", "two"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), bins)  # as many more as there is more to compare
    linked = placed.select(place.alias("place"), "hub", "v", "size", "block", "one", "two", "hubs", "text").repartition(tasks, "place").groupBy("place").applyInArrow(lambda g: _compare(g, threshold), "v long, links long, text_links long, label long")
    linked = staged(linked, "links")
    counts = linked.groupBy("v").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    counts = counts.join(components(linked.select("label", "v")), "v", "left").withColumnRenamed("component", "label")
    named = texts.join(counts, "v", "left").select("v", "text_id", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("text_links", F.lit(0)).alias("text_links"), F.coalesce("label", "v").alias("label"))
    named = staged(named, "named")
    classes = named.groupBy("label").agg(F.min("text_id").alias("class_id"))
    fate = named.join(classes, "label").select("v", "label", "class_id", "text_id", "size", "links", "text_links")
    one = F.lit(1).cast("long")
    joined = signed.select("doc_id", "named", "t", "v").hint("merge").join(fate, "v", "left")
    return joined.select(
        "doc_id",
        "named",
        "t",
        "label",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("text_id", "doc_id").alias("text_id"),
        F.coalesce("size", one).alias("n_copies"),
        (F.coalesce("links", one - 1) + F.coalesce("size", one) - 1).alias("n_links"),
        F.coalesce("text_links", one - 1).alias("n_text_links"),
    )


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns: of each class, the smallest id.

    Null ids count by their text's hash; null, empty and wordless texts all stay; of rows that tie in a class's
    smallest id, the text with the smallest hash stays, and of rows that repeat id and text, one; an empty table
    gives an empty one; columns of any names are kept. Long texts and large classes are as in jaccard_join.
    """
    if has_plain_ids(docs):
        return docs.join(jaccard_join(docs, **options).where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    keyed = docs.withColumns({"_text_key": _key(), "_text_hash": _text_hash()})
    first = _joined(docs, **options).where("doc_id = class_id")
    worded = first.where("label IS NOT NULL").groupBy("label", "doc_id").agg(F.min("t").alias("t"))
    stays = worded.select("doc_id", "t").unionByName(first.where("label IS NULL").select("doc_id", "t")).distinct().toDF("_text_key", "_text_hash")
    return one_of_each(keyed.join(stays, ["_text_key", "_text_hash"], "left_semi"), ["_text_key", "_text_hash"]).select(docs.columns)
