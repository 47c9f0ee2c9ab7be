"""Word-window deduplication with fixed-block anchors.

Every document's non-overlapping blocks of words are the index; every rolling
window of a block's length probes it. A repeated window of 50 words holds a whole
block of its other occurrence, so only around hits can anything repeat. Hits are
then extended: the full windows around them meet by key, are compared by their words, and runs of
windows that match are the maximal exact repeats.

Documents are dealt once to batches by id. A batch sends each index bucket its
distinct probes in one packed row, so a passage that a third of all documents share
is one entry for each batch, and no pair of documents is ever formed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agreement import CLAIMS, Piece, buckets_of, claims, confirmed, covered, key_bits, keyed, packed_keys, spans_of, stored, unpacked_keys
from .routing import MOST_BUCKETS, Shared, binary, bucket_rests, cat, column, distinct, hits, rests, rows_for, run_starts, short
from .shared import bucket_of, bucketed, parts_for, text_bytes
from .textarrays import U64, Words, pieces, text_buffer

WINDOW = 50
#: A window of 50 words holds a whole aligned block of 25, wherever the blocks begin.
BLOCK = 25
#: Text of a batch, and text whose probes an index bucket serves.
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")
#: Stands for a null id: larger than any document's, so a row without id is never the original.
NO_ID = np.iinfo(np.int64).max


def _ids(docs: pa.Table) -> np.ndarray:
    return pc.fill_null(docs.column("doc_id"), int(NO_ID)).to_numpy()


def _pieces(docs: pa.Table):
    """Words of a batch's rows, piece by piece: first row, last row, words, word hashes."""
    buf, offs = text_buffer(docs.column("text"))
    for a, b in pieces(offs):
        words = Words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], plain=True)
        yield a, b, words, words.hashes()


def _row(words: Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.first, at, side="right") - 1


def _send(key: tuple, docs: pa.Table, buckets: int) -> pa.Table:
    """A batch's distinct probes, apart by whether one or more of its documents hold them, and its blocks."""
    ids = _ids(docs)
    probes, owners, blocks = [], [], []
    for a, _, words, hashes in _pieces(docs):
        at, rolled = words.windows(BLOCK, hashes)
        row = _row(words, at)
        probes.append(rolled)
        owners.append(ids[a + row])
        blocks.append(rolled[(at - words.first[row]) % BLOCK == 0])
    probes, owners = cat(probes, U64), cat(owners, np.int64)
    order = np.argsort(probes)
    probes, owners = probes[order], owners[order]
    starts = run_starts(probes)
    many = np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts) if len(starts) else np.zeros(0, bool)
    sent = [bucket_rests(x, buckets) for x in (probes[starts[~many]], probes[starts[many]], np.sort(cat(blocks, U64)))]
    some = distinct(np.sort(np.concatenate([b for b, _ in sent])))
    return pa.table([pa.array(some), pa.array(np.full(len(some), key[0].as_py(), np.int32)), *(rows_for(some, *x) for x in sent)], names=["bucket", "batch", "single", "multi", "blocks"])


def _probe(key: tuple, sent: pa.Table) -> pa.Table:
    """Of a bucket's blocks, those that more than one document holds, told to their batches."""
    index = np.unique(cat(rests(sent, "blocks", 32), U64))
    seen = np.zeros(len(index), np.int64)
    found = []
    for single, multi in zip(rests(sent, "single", 32), rests(sent, "multi", 32), strict=True):
        a, b = hits(index, single), hits(index, multi)
        seen[a] += 1
        seen[b] += 2
        found.append(np.union1d(a, b))
    told = [(batch, index[at[seen[at] > 1]]) for batch, at in zip(sent.column("batch").to_pylist(), found, strict=True)]
    told = [x for x in told if len(x[1])]
    return pa.table([pa.array([b for b, _ in told], pa.int32()), pa.array([key[0].as_py()] * len(told), pa.int32()), binary([short(x, 32) for _, x in told])], names=["batch", "bucket", "shared"])


def _windows(docs: pa.Table, buckets: int) -> Iterator[Piece]:
    """All windows of a batch."""
    for a, _, words, hashes in _pieces(docs):
        at, found = words.windows(WINDOW, hashes)

        def body(i: int, words=words, at=at) -> bytes:
            data = words.buf[words.starts[at[i]] : words.ends[at[i] + WINDOW - 1]].tobytes()
            return _BLANKS.sub(b" ", data)

        yield Piece(a, words.first, at, keyed(found, buckets), body)


def _extend(key: tuple, docs: pa.Table, shared: pa.Table, buckets: int) -> pa.Table:
    """A batch's full windows around shared anchors: the smallest and largest document of each."""
    anchors = Shared(shared, buckets)
    found, owners = [], []
    if len(anchors.keys):
        ids = _ids(docs)
        for a, _, words, hashes in _pieces(docs):
            at, rolled = words.windows(BLOCK, hashes)
            full, full_hash = words.windows(WINDOW, hashes)
            marks = np.zeros(len(words.starts) + 1, np.int64)
            np.cumsum(np.bincount(at[anchors.holds(rolled)], minlength=len(words.starts)), out=marks[1:])
            # an anchor inside a window begins at one of the window's first words
            held = marks[full + WINDOW - BLOCK + 1] > marks[full]
            found.append(keyed(full_hash[held], buckets))
            owners.append(ids[a + _row(words, full[held])])
    keys, owner = cat(found, U64), cat(owners, np.int64)
    order = np.argsort(keys)
    keys, owner = keys[order], owner[order]
    starts = run_starts(keys)
    low = np.minimum.reduceat(owner, starts) if len(starts) else owner
    high = np.maximum.reduceat(owner, starts) if len(starts) else owner
    keys = keys[starts]
    bucket = buckets_of(keys, buckets)
    some = distinct(bucket)
    return pa.table(
        [pa.array(some), pa.array(np.full(len(some), key[0].as_py(), np.int32)), packed_keys(bucket, some, keys, key_bits(buckets)), *(rows_for(some, bucket, x) for x in (low, high))],
        names=["bucket", "batch", "keys", "low", "high"],
    )


def _originals(key: tuple, sent: pa.Table, buckets: int) -> pa.Table:
    """The smallest document of every window that larger ones hold too, told to the batches of those."""
    bits = key_bits(buckets)
    keys, lows, highs = unpacked_keys(sent, bits), column(sent, "low", "<i8"), column(sent, "high", "<i8")
    index, inverse = np.unique(cat(keys, U64), return_inverse=True)
    least = np.full(len(index), NO_ID)
    np.minimum.at(least, inverse, cat(lows, np.int64))
    batches, told, owners = [], [], []
    a = 0
    for batch, own, high in zip(sent.column("batch").to_pylist(), keys, highs, strict=True):
        low = least[inverse[a : a + len(own)]]
        a += len(own)
        if (later := low < high).any():
            batches.append(batch)
            told.append(own[later] | U64(key[0].as_py()) << U64(bits))
            owners.append(low[later])
    return pa.table([pa.array(batches, pa.int32()), binary(told), binary(owners)], names=["batch", "keys", "low"])


def _claimed(key: tuple, docs: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    """A batch's runs of windows whose keys a smaller document has, and the windows that cover them."""
    keys, low = cat(column(told, "keys", "<u8"), U64), cat(column(told, "low", "<i8"), np.int64)
    order = np.argsort(keys)
    keys, low = keys[order], low[order]
    ids = _ids(docs)

    def found() -> Iterator[tuple[Piece, np.ndarray]]:
        for piece in _windows(docs, buckets) if len(keys) else ():
            at = np.minimum(np.searchsorted(keys, piece.keys), len(keys) - 1)
            yield piece, (keys[at] == piece.keys) & (low[at] < ids[piece.where(np.arange(len(at)))[0]])

    return claims(key[0].as_py(), docs, found(), WINDOW)


def _remove(key: tuple, docs: pa.Table, runs: pa.Table) -> pa.Table:
    """Rows of a batch without the words of windows that a smaller document holds."""
    spans = spans_of(docs, runs, WINDOW)
    n_words, n_removed, kept = [], [], []
    for a, b, words, _ in _pieces(docs):
        gone = covered(spans, a, b, words.first)
        n_words += words.counts.tolist()
        n_removed += np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first]).tolist()
        kept += _joined(words, ~gone)
    return pa.table([docs.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def _joined(words: Words, keep: np.ndarray) -> list[bytes]:
    """Each row's kept words, joined by one space."""
    at = np.flatnonzero(keep)
    size = words.ends[at] - words.starts[at] + 1
    total = np.cumsum(size)
    begin = total - size
    out = words.buf[np.minimum(np.repeat(words.starts[at] - begin, size) + np.arange(total[-1] if len(total) else 0), max(0, len(words.buf) - 1))] if len(at) else np.zeros(0, np.uint8)
    if len(at):
        out[total - 1] = 0x20
    data = out.tobytes()
    cuts = np.concatenate([[0], total])[np.searchsorted(at, words.first)]
    return [data[max(c, 0) : max(c, d - 1)] for c, d in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def remove_repeats(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for each row: its words less the repeated ones.

    Words are runs of bytes other than ASCII white space. A word goes if a window of 50 words
    that covers it also starts in a document with a smaller id; windows are judged on the input.
    Keys of windows find repeats, their words confirm them (see ``agreement``).

    Null text has no words; a row with a null id counts as larger than any other and is never an
    original; rows that repeat an id are one document, so they never remove each other's words;
    texts of fewer than 50 words stay; an empty table gives an empty one; other columns are not read. Rows are dealt to
    batches by id and text; a batch holds about 8 MB of text, or its longest, at some tens of bytes a byte for 1 MB of it,
    or for its longest, at once.
    """
    size = text_bytes(docs, text)
    batches, buckets = parts_for(size, BATCH_BYTES), min(MOST_BUCKETS, parts_for(size, BUCKET_BYTES))
    rows = docs.select(bucket_of(batches, id_col, text).alias("batch"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = stored(rows, batches, size)
    by_batch = texts.groupBy("batch")
    probes = by_batch.applyInArrow(lambda key, docs: _send(key, docs, buckets), "bucket int, batch int, single binary, multi binary, blocks binary")
    shared = probes.groupBy("bucket").applyInArrow(_probe, "batch int, bucket int, shared binary")
    windows = by_batch.cogroup(shared.groupBy("batch")).applyInArrow(lambda key, docs, more: _extend(key, docs, more, buckets), "bucket int, batch int, keys binary, low binary, high binary")
    sent = bucketed(windows, "bucket", buckets, size // 2, "windows", "zstd")
    told = sent.groupBy("bucket").applyInArrow(lambda key, some: _originals(key, some, buckets), "batch int, keys binary, low binary")
    claimed = by_batch.cogroup(told.groupBy("batch")).applyInArrow(lambda key, docs, more: _claimed(key, docs, more, buckets), CLAIMS)
    smaller = F.col("least") < F.coalesce("doc_id", F.lit(int(NO_ID)))
    runs = confirmed(texts, sent, claimed, lambda docs: _windows(docs, buckets), bits=key_bits(buckets), ordered=True, true_of=smaller)
    return by_batch.cogroup(runs.groupBy("batch")).applyInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string")
