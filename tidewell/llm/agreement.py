"""Agreement by bytes: windows under one key repeat only if their bytes are equal.

Keys of windows find repeats; here they are confirmed. Of each run of windows whose keys
repeat, as many are claimed as cover it, and their bytes go to the bucket of their
key. There claims of several batches confirm each other, or are put to one other batch that holds the
key, which looks its own windows up and compares. A run all of whose claims hold is
covered by windows that do repeat, so every byte of it goes. Where a claim fails, keys agreed by
chance or by design: all windows under the keys of such runs are then shown by all their
holders and grouped by their bytes.

What is sent grows with the repeated text alone: a claim for each window's length of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .routing import binary
from .shared import bucketed, staged
from .textarrays import U64

CLAIMS = "batch int, nth long, start long, windows long, refs binary, no int, key long, body binary"
_ASKS = "batch int, key long, low long, body binary, refs binary, no int"
_VERDICTS = "batch int, no int, holds boolean"
_SHOWN = "batch int, nth long, pos long, doc_id long, key long, body binary"


def key_bits(buckets: int) -> int:
    """Bits of a key below its bucket."""
    return 48 if buckets <= 1 << 16 else 40


def keyed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Keys of 64-bit hashes: the bucket, from their upper bits, and their lower bits below it."""
    bits = U64(key_bits(buckets))
    return ((hashes >> U64(40)) * U64(buckets) >> U64(24)) << bits | hashes & ((U64(1) << bits) - U64(1))


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> U64(key_bits(buckets))).astype(np.int32)


def bucket_col(bits: int) -> Column:
    return F.shiftrightunsigned("key", bits).cast("int")


def packed_keys(bucket: np.ndarray, some: np.ndarray, keys: np.ndarray, bits: int) -> pa.Array:
    """Sorted distinct keys of a batch, a value for each of the buckets ``some``: differences, byte by byte from the highest, as these compress."""
    rest = keys & U64((1 << bits) - 1)
    cuts = np.append(np.searchsorted(bucket, some), len(bucket)).tolist()
    steps = np.diff(rest, prepend=U64(0))
    steps[cuts[:-1]] = rest[cuts[:-1]]
    planes = steps.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - bits // 8 :]
    return pa.array([planes[i:j].T.tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())


def unpacked_keys(sent: pa.Table, bits: int) -> list[np.ndarray]:
    """What ``packed_keys`` packed in the column ``keys``: each row's keys, without their bucket."""
    out = []
    for x in sent.column("keys"):
        planes = np.frombuffer(x.as_buffer(), np.uint8).reshape(bits // 8, -1)
        wide = np.zeros((planes.shape[1], 8), np.uint8)
        wide[:, 8 - bits // 8 :] = planes.T
        out.append(np.cumsum(wide.view(">u8").ravel().astype(U64)))
    return out


@dataclass
class Piece:
    """Windows of the rows of a batch from ``first``: where each begins, in units of the piece, its key, and its bytes; ``starts`` has where rows begin."""

    first: int
    starts: np.ndarray
    at: np.ndarray
    keys: np.ndarray
    body: Callable[[int], bytes]

    def where(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row in the batch and position in its row of some windows."""
        row = np.searchsorted(self.starts, self.at[some], side="right") - 1
        return self.first + row, self.at[some] - self.starts[row]


#: From a batch's rows to their pieces.
Pieces = Callable[[pa.Table], Iterator[Piece]]


def _runs(piece: Piece, hit: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """First and last window of each run of hits that follow each other in a row, the row, and the first one's position."""
    found = np.flatnonzero(hit)
    if len(found):
        row, pos = piece.where(found)
        new = np.flatnonzero((np.diff(found) != 1) | (np.diff(row) != 0) | (np.diff(pos) != 1))
        first = np.append(0, new + 1)
        yield from zip(found[first].tolist(), found[np.append(new, len(found) - 1)].tolist(), row[first].tolist(), pos[first].tolist(), strict=True)


def claims(batch: int, docs: pa.Table, found: Iterator[tuple[Piece, np.ndarray]], width: int, sure: np.ndarray | None = None) -> pa.Table:
    """A batch's runs of hits and the claims that cover them; rows that are ``sure`` need none."""
    nth = docs.column("nth").to_numpy()
    known: dict[tuple[int, bytes], int] = {}
    runs: list[tuple] = []
    for piece, hit in found:
        for i, j, row, pos in _runs(piece, hit):
            refs = []
            if sure is None or not sure[row]:
                for w in [*range(i, j, width), j]:
                    refs.append(known.setdefault((int(piece.keys[w]), piece.body(w)), len(known)))
            runs.append((nth[row], pos, j - i + 1, np.array(refs, ">i4").tobytes()))  # from the highest byte, as hex digits are read
    n, m = len(runs), len(known)
    cols = list(zip(*runs, strict=True)) or [()] * 4
    none = lambda k, t: pa.nulls(k, t)
    both = lambda a, b: pa.concat_arrays([a, b])
    keys = np.array([k for k, _ in known], U64).astype(np.int64)
    return pa.table(
        [
            pa.array(np.full(n + m, batch, np.int32)),
            *(both(pa.array(c, pa.int64()), none(m, pa.int64())) for c in cols[:3]),
            both(pa.array(cols[3], pa.binary()), none(m, pa.binary())),
            both(none(n, pa.int32()), pa.array(np.arange(m, dtype=np.int32))),
            both(none(n, pa.int64()), pa.array(keys)),
            both(none(n, pa.binary()), pa.array([b for _, b in known], pa.binary())),
        ],
        names=[x.split()[0] for x in CLAIMS.split(", ")],
    )


def claim_numbers(refs: str) -> Column:
    """The numbers in a column ``refs`` of ``claims``; bytes are read as hex digits, as none of Spark's string functions keep them."""
    return F.expr(f"transform(sequence(0, cast(octet_length({refs}) / 4 as int) - 1), i -> cast(conv(hex(substring({refs}, i * 4 + 1, 4)), 16, 10) as int))")


def _ask(bucket: int, sent: pa.Table, made: pa.Table, ordered: bool, bits: int) -> pa.Table:
    """Claims of a bucket: settled where several batches make the same, else put to another holder of the key.

    ``ordered``: a claim is that the document ``low`` under the key has the same bytes, so that one's holder is asked.
    """
    empty = pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32())], names=[x.split()[0] for x in _ASKS.split(", ")])
    if not made.num_rows:
        return empty
    same: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for batch, no, key, body in zip(*(made.column(c).to_pylist() for c in ("batch", "no", "key", "body")), strict=True):
        same.setdefault((key, body), []).append((batch, no))
    wanted = np.unique(np.array([k for k, _ in same], np.int64).astype(U64))
    lows = [np.frombuffer(x.as_buffer(), "<i8") for x in sent.column("low")] if ordered else [None] * sent.num_rows
    holders: dict[int, list[tuple[int, int]]] = {}  # key: (low, batch); all of them by low, or else two batches
    for batch, own, low in zip(sent.column("batch").to_pylist(), unpacked_keys(sent, bits), lows, strict=True):
        own = own | U64(bucket) << U64(bits)
        at = np.minimum(np.searchsorted(own, wanted), max(0, len(own) - 1))
        for i in np.flatnonzero(own[at] == wanted) if len(own) else []:
            some = holders.setdefault(int(wanted[i].astype(np.int64)), [])
            if ordered:
                some[:] = [min([*some, (int(low[at[i]]), batch)])]
            elif len(some) < 2:
                some.append((0, batch))
    out: list[tuple] = []
    for (key, body), by in same.items():
        if not ordered and len({b for b, _ in by}) > 1:
            out += [(batch, key, None, None, None, no) for batch, no in by]
            continue
        own = by[0][0]
        low, holder = next(((lo, b) for lo, b in holders[key] if ordered or b != own), (0, own))
        out.append((holder, key, low, body, np.array(by, "<i4").tobytes(), None))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), empty.schema, strict=True)], schema=empty.schema)


def _among(some: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of the keys that are among the sorted ``some``; a table of their lowest bits excludes most others at once."""
    marked = np.zeros(1 << 20, bool)
    marked[(some & U64((1 << 20) - 1)).astype(np.int64)] = True
    likely = np.flatnonzero(marked[(keys & U64((1 << 20) - 1)).astype(np.int64)])
    return likely[some[np.minimum(np.searchsorted(some, keys[likely]), len(some) - 1)] == keys[likely]]


def _answer(batch: int, docs: pa.Table, asks: pa.Table, pieces: Pieces, ordered: bool) -> pa.Table:
    """Which claims a batch's own windows agree with; a batch that is asked about its own claim needs a second window."""
    wanted: dict[int, list[int]] = {}
    keys, bodies, lows = (asks.column(c).to_pylist() for c in ("key", "body", "low"))
    for i, k in enumerate(keys):
        wanted.setdefault(k, []).append(i)
    agree = np.zeros(asks.num_rows, np.int64)
    if wanted:
        some = np.sort(np.array(list(wanted), np.int64).astype(U64))
        ids = docs.column("doc_id").to_pylist() if ordered else None
        for piece in pieces(docs):
            hits = _among(some, piece.keys)
            for w, row in zip(hits.tolist(), piece.where(hits)[0].tolist(), strict=True):
                body = piece.body(w)
                for i in wanted[int(piece.keys[w].astype(np.int64))]:
                    agree[i] += bodies[i] == body and (not ordered or ids[row] == lows[i])
    out = [(b, no, bool(agree[i] >= (2 if not ordered and b == batch else 1))) for i, refs in enumerate(asks.column("refs")) for b, no in np.frombuffer(refs.as_buffer(), "<i4").reshape(-1, 2).tolist()]
    cols = list(zip(*out, strict=True)) or [()] * 3
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["batch", "no", "holds"])


def _contested(docs: pa.Table, runs: pa.Table, pieces: Pieces) -> pa.Table:
    """Keys of all windows of a batch's failed runs."""
    row_of = {n: i for i, n in enumerate(docs.column("nth").to_pylist())}
    spans: dict[int, list[tuple[int, int]]] = {}
    for nth, start, windows in zip(*(runs.column(c).to_pylist() for c in ("nth", "start", "windows")), strict=True):
        spans.setdefault(row_of[nth], []).append((start, start + windows))
    found = [np.zeros(0, U64)]
    for piece in pieces(docs) if spans else ():
        rows, pos = piece.where(np.arange(len(piece.at)))
        for row in np.unique(rows).tolist():
            for a, b in spans.get(row, ()):
                found.append(piece.keys[(rows == row) & (pos >= a) & (pos < b)])
    return pa.table([pa.array(np.unique(np.concatenate(found)).astype(np.int64))], names=["key"])


def _route(bucket: int, sent: pa.Table, contested: pa.Table, bits: int) -> pa.Table:
    """Contested keys told to every batch that holds them."""
    wanted = np.sort(contested.column("key").to_numpy().astype(U64))
    told = []
    for batch, own in zip(sent.column("batch").to_pylist(), unpacked_keys(sent, bits), strict=True):
        if len(hit := np.intersect1d(own | U64(bucket) << U64(bits), wanted)):
            told.append((batch, hit))
    return pa.table([pa.array([b for b, _ in told], pa.int32()), binary([k.astype("<u8") for _, k in told])], names=["batch", "keys"])


def _show(batch: int, docs: pa.Table, told: pa.Table, pieces: Pieces) -> pa.Table:
    """Every window of a batch under a contested key."""
    wanted = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in told.column("keys")] or [np.zeros(0, U64)]))
    nth, ids = docs.column("nth").to_pylist(), docs.column("doc_id").to_pylist()
    out = []
    for piece in pieces(docs) if len(wanted) else ():
        hits = _among(wanted, piece.keys)
        for w, row, pos in zip(hits.tolist(), *(x.tolist() for x in piece.where(hits)), strict=True):
            out.append((batch, nth[row], pos, ids[row], int(piece.keys[w].astype(np.int64)), piece.body(w)))
    cols = list(zip(*out, strict=True)) or [()] * 6
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _SHOWN.split(", ")])


def confirmed(texts: DataFrame, sent: DataFrame, claimed: DataFrame, pieces: Pieces, *, bits: int, ordered: bool, true_of: Column) -> DataFrame:
    """``batch, nth, start, windows``: the runs of windows that do repeat.

    ``texts`` (batch, nth, doc_id, ..) and ``sent`` (bucket, batch, keys, and ``low`` if ``ordered``) are bucketed tables,
    ``claimed`` what ``claims`` gave. ``true_of`` says of a contested window whether it repeats, from ``n`` (windows with its bytes), ``least`` (the
    smallest document among them, null ids apart) and its own ``doc_id``.
    """
    rows = staged(claimed, "claims")
    runs = rows.where("no IS NULL").select("batch", "nth", "start", "windows", "refs")
    made = rows.where("no IS NOT NULL").select(bucket_col(bits).alias("bucket"), "batch", "no", "key", "body")
    by_batch = texts.groupBy("batch")
    asks = staged(sent.groupBy("bucket").cogroup(made.groupBy("bucket")).applyInArrow(lambda k, a, b: _ask(k[0].as_py(), a, b, ordered, bits), _ASKS), "asks")
    answers = by_batch.cogroup(asks.where("no IS NULL").groupBy("batch")).applyInArrow(lambda k, a, b: _answer(k[0].as_py(), a, b, pieces, ordered), _VERDICTS)
    failed = staged(answers.where("NOT holds").select("batch", "no"), "failed-claims")
    plain = runs.select("batch", "nth", "start", "windows")
    if failed.isEmpty():
        return plain
    size = F.octet_length("refs") / 4
    each = runs.where(size > 0).select("batch", "nth", "start", "windows", F.explode(claim_numbers("refs")).alias("no"))
    bad = staged(each.join(failed, ["batch", "no"], "left_semi").select("batch", "nth", "start", "windows").distinct(), "failed-runs")
    keys = by_batch.cogroup(bad.groupBy("batch")).applyInArrow(lambda k, a, b: _contested(a, b, pieces), "key long").distinct()
    keys = staged(keys.withColumn("bucket", bucket_col(bits)), "contested")
    routed = sent.groupBy("bucket").cogroup(keys.groupBy("bucket")).applyInArrow(lambda k, a, b: _route(k[0].as_py(), a, b, bits), "batch int, keys binary")
    shown = staged(by_batch.cogroup(routed.groupBy("batch")).applyInArrow(lambda k, a, b: _show(k[0].as_py(), a, b, pieces), _SHOWN), "shown")
    groups = shown.groupBy("key", "body").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    windows = shown.join(groups, ["key", "body"]).where(true_of).select("batch", "nth", F.col("pos").alias("start"), F.lit(1).cast("long").alias("windows"))
    # windows of failed runs alone: others under these keys have runs whose claims hold
    inside = windows.join(bad.select("batch", "nth", F.col("start").alias("a"), (F.col("start") + F.col("windows")).alias("b")), ["batch", "nth"]).where("start >= a AND start < b")
    good = plain.join(bad, ["batch", "nth", "start", "windows"], "left_anti")
    return staged(good.unionByName(inside.select("batch", "nth", "start", "windows").distinct()), "confirmed")


def spans_of(docs: pa.Table, runs: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row in the batch, start and length of what each run of windows covers, by row."""
    nth = docs.column("nth").to_numpy()
    order = np.argsort(nth)
    row = order[np.searchsorted(nth[order], runs.column("nth").to_numpy())] if runs.num_rows else np.zeros(0, np.int64)
    by_row = np.argsort(row, kind="stable")
    start, windows = (runs.column(c).to_numpy().astype(np.int64) if runs.num_rows else np.zeros(0, np.int64) for c in ("start", "windows"))
    return row[by_row], start[by_row], windows[by_row] + width - 1


def covered(spans: tuple[np.ndarray, np.ndarray, np.ndarray], a: int, b: int, first: np.ndarray) -> np.ndarray:
    """Which units of the rows ``a`` to ``b`` spans cover; ``first`` has each row's first unit, and their number at its end."""
    row, start, length = spans
    i, j = np.searchsorted(row, [a, b])
    at = first[row[i:j] - a] + start[i:j]
    edges = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(edges, at, 1)
    np.subtract.at(edges, at + length[i:j], 1)
    return np.cumsum(edges[:-1]) > 0


def stored(docs: DataFrame, batches: int, size: int) -> DataFrame:
    """Rows (batch, ..) with ``nth``, a number of their own, written once, bucketed by batch: what every later step reads."""
    return bucketed(docs.withColumn("nth", F.monotonically_increasing_id()), "batch", batches, size, "texts", "zstd")
