"""Repeated byte strings behind a difference-cover sample, by hash.

Positions whose residue modulo the period lies in a difference cover are the
sample. Any two equal strings of the wanted length hold, at one offset below the
period, a sample position in both, so the strings that begin there are equal too.
The sample's strings are sorted, one bucket of their hashes at a time, and those that
tie are told to their batches. Only strings of the wanted length that hold a tied
sample can repeat: their keys go to buckets, each sorted by itself. Strings whose keys occur again are
compared byte by byte before anything is removed.

No suffix is ordered by its bytes: see the README for what that would cost.

Buckets hold keys, and the bytes of as many strings as cover what repeats, so a bucket's memory
is bounded whatever repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agreement import CLAIMS, Piece, buckets_of, claims, confirmed, covered, key_bits, keyed, packed_keys, spans_of, stored, unpacked_keys
from .routing import MOST_BUCKETS, Shared, binary, bucket_rests, cat, column, cover, distinct, rests, rows_for, run_starts, short
from .shared import bucket_of, bucketed, parts_for, staged, text_bytes
from .textarrays import BYTE_VALUES, U64, Sums, pieces, text_buffer

LENGTH = 400
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20


def singer_cover(q: int) -> tuple[int, list[int]]:
    """The period q*q + q + 1 and a perfect difference set of q + 1 residues, for a prime q.

    Powers of a primitive element of the field of q**3 elements whose last coordinate is 0,
    taken modulo the period.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                residues, p = [], (1, 0, 0)  # powers of x modulo x**3 = a x**2 + b x + c
                for n in range(v):
                    if p[2] == 0:
                        residues.append(n)
                    top = p[2]
                    p = ((top * c) % q, (p[0] + top * b) % q, (p[1] + top * a) % q)
                if len(residues) == q + 1 and len({(s - t) % v for s in residues for t in residues}) == v:
                    return v, residues
    raise ValueError(f"no cover for {q}")


#: Fixed by the rule above: every difference modulo PERIOD is one of two members of COVER.
PERIOD, COVER = singer_cover(13)
#: Bytes that follow a sample position inside a string of LENGTH, wherever it begins.
DEPTH = LENGTH - PERIOD + 1
#: Bytes of a sample string, DEPTH at most: repeats of TIE + PERIOD - 1 bytes and more are seen, and told in ``n_shared``.
TIE = 96
#: Bits, below its bucket, by which a sample string is known: of the million strings of a bucket one in a million agrees with another by chance.
BITS = 40


def _samples(sums: Sums, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample positions of a piece (residues counted from each row's start) and their keys."""
    starts, lengths = offs[:-1], np.diff(offs)
    found = []
    for residue in COVER:
        n = np.maximum(0, (lengths - TIE - residue) // PERIOD + 1)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found.append(np.repeat(starts + residue, n) + nth * PERIOD)
    at = cat(found, np.int64)
    return at, sums.spans(at, at + TIE)


def _pieces(docs: pa.Table):
    buf, offs = text_buffer(docs.column("text"))
    for a, b in pieces(offs):
        part = buf[offs[a] : offs[b]]
        yield a, b, part, offs[a : b + 1] - offs[a], Sums(BYTE_VALUES[part])


def _windows(sums: Sums, offs: np.ndarray, buckets: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a string of LENGTH begins, and their keys; ``within`` marks those wanted."""
    n = int(offs[-1])
    whole = np.zeros(n, bool)
    lengths = np.diff(offs)
    room = np.maximum(0, lengths - LENGTH + 1)
    whole[np.repeat(offs[:-1], room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)] = True
    if within is not None:
        whole &= within
    at = np.flatnonzero(whole)
    return at, keyed(sums.spans(at, at + LENGTH), buckets)


def _piece(first: int, part: np.ndarray, offs: np.ndarray, at: np.ndarray, keys: np.ndarray) -> Piece:
    return Piece(first, offs, at, keys, lambda i: part[at[i] : at[i] + LENGTH].tobytes())


def _strings(docs: pa.Table, buckets: int) -> Iterator[Piece]:
    """All strings of LENGTH of a batch."""
    for a, _, part, offs, sums in _pieces(docs):
        yield _piece(a, part, offs, *_windows(sums, offs, buckets))


def _tied_strings(docs: pa.Table, tied: pa.Table, buckets: int) -> Iterator[Piece]:
    """A batch's strings that hold a tied sample."""
    ties = Shared(tied, buckets, BITS)
    for a, _, part, offs, sums in _pieces(docs) if len(ties.keys) else ():
        at, keys = _samples(sums, offs)
        at = at[ties.holds(keys)]
        marks = np.zeros(len(part) + 1, np.int32)
        np.cumsum(np.bincount(at, minlength=len(part)), out=marks[1:])
        begin = np.arange(len(part))
        # of any PERIOD offsets in a row at which a sample string fits into a repeated one, one is tied: the first such and the last
        near, far = begin, np.minimum(begin + LENGTH - TIE - PERIOD + 1, len(part))
        held = [marks[np.minimum(x + PERIOD, len(part))] > marks[x] for x in (near, far)]
        yield _piece(a, part, offs, *_windows(sums, offs, buckets, held[0] & held[1]))


def _sample(key: tuple, docs: pa.Table, buckets: int) -> pa.Table:
    """A batch's sample keys for each bucket, apart by whether they occur once or more here."""
    copied = docs.column("copied").to_numpy()
    found = []
    for a, _, _, offs, sums in _pieces(docs):
        at, keys = _samples(sums, offs)
        found += [keys, keys[copied[a + np.searchsorted(offs, at, side="right") - 1]]]
    keys = np.sort(cat(found, U64))
    starts = run_starts(keys)
    count = np.diff(np.append(starts, len(keys)))
    sent = [bucket_rests(keys[starts[count == 1]], buckets, BITS), bucket_rests(keys[starts[count > 1]], buckets, BITS)]
    some = np.union1d(sent[0][0], sent[1][0]).astype(np.int32)
    return pa.table([pa.array(some), pa.array(np.full(len(some), key[0].as_py(), np.int32)), *(rows_for(some, *x) for x in sent)], names=["bucket", "batch", "single", "multi"])


def _rank(key: tuple, sent: pa.Table) -> pa.Table:
    """Sort a bucket of the sample; the ranks that tie are told to their batches."""
    single, multi = rests(sent, "single", BITS), rests(sent, "multi", BITS)
    every = np.sort(np.concatenate([*single, *multi, *multi]))  # several here count twice
    starts = run_starts(every)
    tied = every[starts[np.diff(np.append(starts, len(every))) > 1]]
    told = []
    for batch, a, b in zip(sent.column("batch").to_pylist(), single, multi, strict=True):
        own = np.union1d(a, b)
        at = np.minimum(np.searchsorted(tied, own), max(0, len(tied) - 1))
        if len(tied) and (hit := tied[at] == own).any():
            told.append((batch, own[hit]))
    return pa.table([pa.array([b for b, _ in told], pa.int32()), pa.array([key[0].as_py()] * len(told), pa.int32()), binary([short(x, BITS) for _, x in told])], names=["batch", "bucket", "shared"])


def _distinct_keys(docs: pa.Table, pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys of a batch's strings, and whether each begins more than one."""
    copied = docs.column("copied").to_numpy()
    # what a copied text holds begins in its copies too
    every = [k for p in pieces for k in (p.keys, p.keys[copied[p.where(np.arange(len(p.at)))[0]]])]
    keys = np.sort(cat(every, U64))
    starts = run_starts(keys)
    return keys[starts], np.diff(np.append(starts, len(keys))) > 1


def _suffixes(key: tuple, docs: pa.Table, tied: pa.Table, buckets: int) -> pa.Table:
    """A batch's strings that hold a tied sample, as keys for each bucket."""
    keys, many = _distinct_keys(docs, list(_tied_strings(docs, tied, buckets)))
    bucket = buckets_of(keys, buckets)
    some = distinct(bucket)
    cuts = np.append(np.searchsorted(bucket, some), len(bucket)).tolist()
    bits = binary([np.packbits(many[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
    return pa.table([pa.array(some), pa.array(np.full(len(some), key[0].as_py(), np.int32)), packed_keys(bucket, some, keys, key_bits(buckets)), bits], names=["bucket", "batch", "keys", "many"])


def _settle(key: tuple, sent: pa.Table, buckets: int) -> pa.Table:
    """Sort a bucket's suffixes; each batch is told, a bit for each key that it sent, which occur again."""
    keys = unpacked_keys(sent, key_bits(buckets))
    many = [np.unpackbits(m, count=len(k)).astype(bool) for k, m in zip(keys, column(sent, "many", np.uint8), strict=True)]
    every = np.sort(np.concatenate([*keys, *(k[m] for k, m in zip(keys, many, strict=True))]))
    starts = run_starts(every)
    tied = every[starts[np.diff(np.append(starts, len(every))) > 1]]
    told = []
    for own in keys:
        hit = tied[np.minimum(np.searchsorted(tied, own), len(tied) - 1)] == own if len(tied) else np.zeros(len(own), bool)
        told.append(np.packbits(hit))
    return pa.table([sent.column("batch"), pa.array([key[0].as_py()] * len(told), pa.int32()), binary(told)], names=["batch", "bucket", "flags"])


def _claimed(key: tuple, docs: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    """A batch's runs of strings whose keys occur again, and the strings that cover them."""
    told = told.sort_by("bucket")
    flags = told.filter(pc.is_valid(told.column("flags")))
    pieces = list(_tied_strings(docs, told.filter(pc.is_valid(told.column("shared"))), buckets))
    keys, _ = _distinct_keys(docs, pieces)
    of_bucket = np.bincount(np.unique(buckets_of(keys, buckets), return_inverse=True)[1]).tolist()  # all buckets that were sent to answer
    bits = [np.unpackbits(f, count=n) for n, f in zip(of_bucket, column(flags, "flags", np.uint8), strict=True)]
    repeated = keys[cat(bits, np.uint8).astype(bool)]

    def found() -> Iterator[tuple[Piece, np.ndarray]]:
        for piece in pieces if len(repeated) else ():
            yield piece, repeated[np.minimum(np.searchsorted(repeated, piece.keys), len(repeated) - 1)] == piece.keys

    return claims(key[0].as_py(), docs, found(), LENGTH, docs.column("copied").to_numpy())


def _remove(key: tuple, docs: pa.Table, fates: pa.Table, buckets: int) -> pa.Table:
    """Rows of a batch without the bytes that a repeated string covers."""
    ties = Shared(fates.filter(pc.is_valid(fates.column("shared"))), buckets, BITS)
    spans = spans_of(docs, fates.filter(pc.is_valid(fates.column("nth"))), LENGTH)
    n_bytes, n_removed, n_spans, n_shared, kept = [], [], [], [], []
    for a, b, part, offs, sums in _pieces(docs):
        gone = covered(spans, a, b, offs)
        at, keys = _samples(sums, offs)
        shared = cover(at[ties.holds(keys)], TIE, len(part))
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edge = offs[:-1][offs[:-1] < len(part)]
        begins[edge] = gone[edge]
        runs, lost, left, again = (np.concatenate([[0], np.cumsum(x)])[offs] for x in (begins, gone, ~gone, gone | shared))
        data = part[~gone].tobytes()
        n_bytes += np.diff(offs).tolist()
        n_removed += np.diff(lost).tolist()
        n_spans += np.diff(runs).tolist()
        n_shared += np.diff(again).tolist()
        kept += [data[c:d] for c, d in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
    return pa.table([docs.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans, n_shared)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_shared", "kept"])


#: Texts that occur more than once are told to all tasks up to so many, 64 MB; beyond, the rows are joined by a shuffle.
BROADCAST_TEXTS = 2_000_000


def _with_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``copied`` (its text occurs in other rows too) and ``copy`` (one with a smaller id stands for it)."""
    name = [F.unhex(F.sha2("text", 256)).alias("_a")]
    groups = staged(docs.select("doc_id", *name).groupBy("_a").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_c")).where("_c > 1").drop("_c"), "copied-texts")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_TEXTS else groups
    first = F.col("_first")
    return docs.select("*", *name).join(groups.withColumn("_copied", F.lit(True)), "_a", "left").select(
        "doc_id", "text", F.coalesce("_copied", F.lit(False)).alias("copied"), F.coalesce(F.col("_copied") & ~F.col("doc_id").eqNullSafe(first), F.lit(False)).alias("copy")
    )


def remove_repeated_bytes(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, n_shared, kept`` (binary) for each row.

    A byte of the UTF-8 text goes if a string of 400 bytes that covers it also starts anywhere
    else, in the same row or another; overlaps count, and strings are judged on the input.
    Keys of strings find repeats, their bytes confirm them (see ``agreement``); whole copies are known by SHA-256. ``n_shared`` counts the bytes that
    are removed or lie in a string of TIE bytes at a sample position, counted from its text's start, that another sample position begins too.

    Null text is empty; a null id is kept as such; repeated rows remove each other; rows of fewer
    than 400 bytes stay; cuts may fall inside a character, so what is left is bytes; an empty table
    gives an empty one; other columns are not read. A text that fills a third of all rows is one key for
    each of its positions and batches. Rows are dealt to batches by id and text; a batch holds about 8 MB of text, or its
    longest, at some tens of bytes a byte for 1 MB of it, or for its longest, at once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = text_bytes(rows)
    batches, buckets = parts_for(size, BATCH_BYTES), min(MOST_BUCKETS, parts_for(size, BUCKET_BYTES))
    marked = _with_copies(rows)
    texts = stored(marked.where("not copy").select(bucket_of(batches, "doc_id", "text").alias("batch"), "doc_id", "text", "copied"), batches, size)
    by_batch = texts.groupBy("batch")
    sample = by_batch.applyInArrow(lambda key, docs: _sample(key, docs, buckets), "bucket int, batch int, single binary, multi binary")
    tied = staged(sample.groupBy("bucket").applyInArrow(_rank, "batch int, bucket int, shared binary"), "tied-samples")
    suffixes = by_batch.cogroup(tied.groupBy("batch")).applyInArrow(lambda key, docs, more: _suffixes(key, docs, more, buckets), "bucket int, batch int, keys binary, many binary")
    sent = bucketed(suffixes, "bucket", buckets, size // 2, "suffix-keys", "zstd")
    flags = sent.groupBy("bucket").applyInArrow(lambda key, some: _settle(key, some, buckets), "batch int, bucket int, flags binary")
    told = tied.unionByName(flags, allowMissingColumns=True)
    claimed = by_batch.cogroup(told.groupBy("batch")).applyInArrow(lambda key, docs, more: _claimed(key, docs, more, buckets), CLAIMS)
    runs = confirmed(texts, sent, claimed, lambda docs: _strings(docs, buckets), bits=key_bits(buckets), ordered=False, true_of=F.col("n") > 1)
    fates = tied.unionByName(runs, allowMissingColumns=True)
    kept = by_batch.cogroup(fates.groupBy("batch")).applyInArrow(lambda key, docs, more: _remove(key, docs, more, buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, n_shared long, kept binary")
    # a copy of LENGTH bytes or more repeats from end to end
    n, body = F.octet_length("text").cast("long"), F.encode("text", "UTF-8")
    long = n >= LENGTH
    none = F.lit(0).cast("long")
    copies = marked.where("copy").select("doc_id", n.alias("n_bytes"), F.when(long, n).otherwise(none).alias("n_removed"), F.when(long, none + 1).otherwise(none).alias("n_spans"), F.when(n >= TIE, n).otherwise(none).alias("n_shared"), F.when(long, F.encode(F.lit(""), "UTF-8")).otherwise(body).alias("kept"))
    return kept.unionByName(copies)
