"""Exact deduplication against immutable snapshots screened by fuse filters.

A snapshot is the digests already stored, in hash buckets of bounded size, each
bucket with a static binary fuse filter. Incoming texts are first grouped among
themselves, so that copies inside the new batch cost one digest. Those digests
meet the filter of their own bucket; what passes is joined with the bucket's
exact entries, and the two texts are compared byte for byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fusefilter
from .shared import has_plain_ids, one_of_each, parts_for, staged

#: Digests of a bucket, about; a bucket is what one task holds.
BUCKET_ROWS = 500_000
#: Ids of positives are broadcast up to so many, 16 MB; beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Groups of more than one row are broadcast up to so many, 32 MB.
BROADCAST_GROUPS = 500_000

_DIGESTS = "doc_id long, digest binary, n_bytes long"


def _normal(texts: pa.Array) -> pa.Array:
    """Only A-Z are lowered; null is empty."""
    return pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = _normal(b.column("text")).cast(pa.large_binary())
        found = [hashlib.sha256(x.as_buffer()).digest() for x in texts]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), pa.array(found, pa.binary()), pc.binary_length(texts).cast(pa.int64())],
            names=["doc_id", "digest", "n_bytes"],
        )


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, SHA-256 ``digest`` of the normalised text, ``n_bytes``."""
    return docs.select("doc_id", "text").mapInArrow(_digest_batches, _DIGESTS)


@dataclass
class Snapshot:
    """Stored texts: ``entries`` has a row for each distinct text, ``filters`` one for each bucket."""

    docs: DataFrame
    entries: DataFrame
    filters: DataFrame
    buckets: int


def _short(column: pa.ChunkedArray) -> np.ndarray:
    """The first 8 bytes of each digest as an integer."""
    whole = b"".join(x[:8] for x in column.to_pylist())
    return np.frombuffer(whole, "<u8")


def _bucket(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def _groups(found: DataFrame) -> DataFrame:
    """One row for each distinct text: its largest id and its count, added up before the shuffle."""
    return found.groupBy("digest", "n_bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))


def _build_filter(key: tuple, group: pa.Table) -> pa.Table:
    made = fusefilter.build(_short(group.column("digest")))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made], pa.binary())})


def build_snapshot(docs: DataFrame, found: DataFrame | None = None, bucket_rows: int = BUCKET_ROWS) -> Snapshot:
    """Write the entries and filters of ``docs`` once; they never change."""
    entries = staged(_groups(digests(docs) if found is None else found), "snapshot-groups")
    buckets = parts_for(entries.count(), bucket_rows)
    entries = entries.withColumn("bucket", _bucket(buckets))
    filters = entries.select("bucket", "digest").groupBy("bucket").applyInArrow(_build_filter, "bucket int, filter binary")
    return Snapshot(docs, entries, staged(filters, "snapshot-filters"), buckets)


def _screen(_key: tuple, new: pa.Table, filters: pa.Table) -> pa.Table:
    out = new.select(["digest", "n_bytes"])
    if not filters.num_rows or not new.num_rows:
        return out.slice(0, 0)
    hit = fusefilter.contains(filters.column("filter")[0].as_py(), _short(new.column("digest")))
    return out.filter(pa.array(hit))


def _texts_of(docs: DataFrame, wanted: DataFrame, n: int, nameless: int) -> DataFrame:
    """Normalised texts of the rows named by ``id`` and ``digest``; only their texts go through Python.

    ``nameless`` of ``wanted`` have no id: those are looked up by their digest among the rows without one.
    """
    docs = docs.select("doc_id", "text")
    ids = wanted.where("id IS NOT NULL").select(F.col("id").alias("doc_id")).distinct()

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = next(_digest_batches(iter([b])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), d.column("digest"), _normal(b.column("text")).cast(pa.large_binary())], names=["id", "digest", "body"])

    def texts(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(with_text, "id long, digest binary, body binary")

    found = texts(docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi"))
    if nameless:
        sought = wanted.where("id IS NULL").select("digest").distinct()
        found = found.unionByName(texts(docs.where("doc_id IS NULL")).join(sought, "digest", "left_semi"))
    return found.dropDuplicates(["id", "digest"])


def match_snapshot(new: DataFrame, incoming: DataFrame, snapshot: Snapshot, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Of the distinct new texts ``new``, those that ``snapshot`` holds: digest, n_bytes, old_id, old_n."""
    salts = parts_for(new.count(), bucket_rows * snapshot.buckets)
    salted = new.withColumn("bucket", _bucket(snapshot.buckets)).withColumn("salt", F.pmod(F.xxhash64("digest", F.lit(7)), F.lit(salts)).cast("int"))
    filters = snapshot.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    passed = salted.groupBy("bucket", "salt").cogroup(filters.groupBy("bucket", "salt")).applyInArrow(_screen, "digest binary, n_bytes long")
    pairs = staged(
        passed.join(new, ["digest", "n_bytes"]).join(snapshot.entries.select("digest", "n_bytes", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n")), ["digest", "n_bytes"]),
        "exact-positives",
    )
    n, our_nameless, their_nameless = pairs.agg(F.count("*"), F.count_if(F.col("keep_id").isNull()), F.count_if(F.col("old_id").isNull())).first()
    ours = _texts_of(incoming, pairs.select(F.col("keep_id").alias("id"), "digest"), n, our_nameless).toDF("a_id", "a_digest", "a")
    theirs = _texts_of(snapshot.docs, pairs.select(F.col("old_id").alias("id"), "digest"), n, their_nameless).toDF("b_id", "b_digest", "b")
    same = pairs.join(ours, F.col("keep_id").eqNullSafe(F.col("a_id")) & (F.col("digest") == F.col("a_digest")))
    same = same.join(theirs, F.col("old_id").eqNullSafe(F.col("b_id")) & (F.col("digest") == F.col("b_digest")))
    return same.where(F.col("a") == F.col("b")).select("digest", "n_bytes", "old_id", "old_n")


def exact_dedup(incoming: DataFrame, snapshots: list[Snapshot], found: DataFrame | None = None) -> DataFrame:
    """For each distinct text of ``incoming``: ``digest``, ``n_bytes``, ``keep_id``, ``n`` (copies in
    the batch), and ``old_id``, ``old_n`` if a snapshot holds it, else null. ``old_id`` is null too
    where the snapshot has the text only without an id.

    A text that a snapshot holds stays as the snapshot has it; of copies in the batch, the
    largest id stays. Null text counts as empty; a null id never beats another id; repeated rows
    count each; an empty batch or snapshot gives no matches; other columns are not read.
    """
    new = staged(_groups(digests(incoming) if found is None else found), "batch-groups")
    matched = None
    rest = new
    for s in snapshots:
        hit = staged(match_snapshot(rest, incoming, s), "exact-matches")
        matched = hit if matched is None else matched.unionByName(hit)
        rest = rest.join(hit.select("digest", "n_bytes"), ["digest", "n_bytes"], "left_anti")
    if matched is None:
        return new.withColumns({"old_id": F.lit(None).cast("long"), "old_n": F.lit(None).cast("long")})
    return new.join(matched, ["digest", "n_bytes"], "left")


def _stored(middle: int):
    """Whether a row belongs to the half that is stored already: ids above the middle.

    The stored ids are the larger ones, so keeping what is stored keeps the largest id.
    """
    return F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))


def group_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, digest``.

    The upper half of the ids is the snapshot and the rest the new batch. Texts equal after
    lowering A-Z form a group; its largest id stays. Null text counts as empty. Rows of one group that repeat an id are one
    document, all marked alike; rows without an id stay only if their group has no id. An empty table gives an
    empty one; other columns are not read. A long text costs a task its own size a few times. A group
    with a third of all rows is one entry; only rows whose text occurs more than once meet the groups again, as
    broadcast digests while those are few, else in a join whose large partitions Spark splits.
    """
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    stored = _stored(0 if low is None else (low + high) // 2)
    found = staged(digests(docs), "digests").withColumn("fresh", ~stored)
    snapshot = build_snapshot(docs.where(stored), found.where(~F.col("fresh")))
    new = staged(exact_dedup(docs.where(~stored), [snapshot], found.where("fresh")), "exact-new")
    fate_new = new.select("digest", "n_bytes", F.lit(True).alias("fresh"), F.coalesce("old_id", "keep_id").alias("keep_id"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("group_size"))
    more = new.where(F.col("old_n").isNotNull()).select("digest", "n_bytes", F.col("n").alias("more"))
    fate_old = snapshot.entries.join(more, ["digest", "n_bytes"], "left").select("digest", "n_bytes", F.lit(False).alias("fresh"), "keep_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("group_size"))
    fate = staged(fate_new.unionByName(fate_old).where("group_size > 1"), "exact-groups")
    fate = F.broadcast(fate) if fate.count() <= BROADCAST_GROUPS else fate
    joined = found.join(fate, ["digest", "n_bytes", "fresh"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    return joined.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns: of each group of group_report, one row.

    Of several rows of a group that share the id that stays (or are without one), the row with the smallest hash of
    all columns stays. Null and empty texts are one group; an empty table gives an empty one; columns of any names are kept.
    """
    if has_plain_ids(docs):
        return docs.join(group_report(docs).where("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    upper, lower = ascii_uppercase, ascii_uppercase.lower()
    own = F.sha2(F.encode(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), upper, lower), "UTF-8"), 256)
    # ids may repeat and be null: rows are told apart by id and text
    keyed = docs.withColumns({"_own_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_own_text": own})
    stays = group_report(docs).where("kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_own_id"), F.lower(F.hex("digest")).alias("_own_text")).distinct()
    return one_of_each(keyed.join(stays, ["_own_id", "_own_text"], "left_semi"), ["_own_id", "_own_text"]).select(docs.columns)
