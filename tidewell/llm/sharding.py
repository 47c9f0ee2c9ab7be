"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a key of two hashes, of the text and of the id, and a number among
the rows that share both. Splitters
that cut the order into parts of equal bytes are found by counting: each round
counts the exact bytes and rows below evenly spaced probes inside every interval
that still holds an unsettled splitter, and refines only those intervals. Rows
then cross the network once, to the part that their key names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

#: Bits of each part of the key.
KEY_BITS = 60


KEYS = ("_k1", "_k2", "_k3")


@dataclass
class Splitter:
    """The first key of a part and what lies below it."""

    key: tuple[int, ...]
    below_bytes: int
    below_rows: int


#: An interval of keys: the parts of the key that are settled, and the leading bits of the next one.
Prefix = tuple[tuple[int, ...], int]


def _within(prefixes: list[Prefix], part: int, bits: int) -> Column:
    """Whether a row's key begins with one of ``prefixes``, which have ``bits`` of the key's ``part``."""
    lead = F.shiftrightunsigned(F.col(KEYS[part]), KEY_BITS - bits)
    if not part:
        return lead.isin([p for _, p in prefixes])
    settled = lambda full: reduce(lambda a, b: a & b, (F.col(k) == x for k, x in zip(KEYS, full, strict=False)))
    return reduce(lambda a, b: a | b, (settled(full) & (lead == p) if bits else settled(full) for full, p in prefixes))


def find_splitters(keys: DataFrame, targets: list[float], tolerance: float) -> list[Splitter]:
    """Keys with as near ``targets`` bytes below them as whole rows allow.

    ``keys`` has the columns of KEYS and ``_size``. Every round reads the rows of the
    unsettled intervals alone and sends the driver one row for each probe: at most
    4,096 for each target, which are one for each shard, whatever the input.
    """
    found: dict[int, Splitter] = {}
    bits = max(4, min(12, 20 - len(targets).bit_length()))
    while KEY_BITS % bits:
        bits -= 1
    # interval -> (bytes below, rows below, targets inside)
    open_at: dict[Prefix, tuple[int, int, list[int]]] = {((), 0): (0, 0, list(range(len(targets))))}
    part, used = 0, 0
    while open_at:
        rows = keys.where(_within(list(open_at), part, used)) if part or used else keys
        shift = KEY_BITS - used - bits
        counted: dict[Prefix, list[tuple[int, int, int]]] = {}
        for r in rows.groupBy(*KEYS[:part], F.shiftrightunsigned(F.col(KEYS[part]), shift).alias("d")).agg(F.sum("_size").alias("b"), F.count("*").alias("n")).collect():
            counted.setdefault((tuple(r[:part]), r.d >> bits), []).append((r.d, r.b, r.n))
        used += bits
        last_round = part == len(KEYS) - 1 and used == KEY_BITS
        deeper: dict[Prefix, tuple[int, int, list[int]]] = {}
        for (full, lead), (bytes_below, rows_below, inside) in open_at.items():
            start = bytes_below
            edges = []
            for d, b, n in sorted(counted.get((full, lead), [])):
                edges.append((d, bytes_below, rows_below))
                bytes_below, rows_below = bytes_below + b, rows_below + n
            last = (max((d for d, *_ in edges), default=0) + 1, bytes_below, rows_below)
            for j in inside:
                # the probe interval that holds the target, and its two edges
                i = max((i for i, e in enumerate(edges) if e[1] <= max(targets[j], start)), default=0)
                low, high = edges[i], edges[i + 1] if i + 1 < len(edges) else last
                near = min(low, high, key=lambda e: abs(e[1] - targets[j]))
                if abs(near[1] - targets[j]) <= tolerance or last_round:
                    found[j] = Splitter((*full, near[0] << shift, *[0] * (len(KEYS) - part - 1)), near[1], near[2])
                else:
                    at = (full, low[0]) if used < KEY_BITS else ((*full, low[0]), 0)
                    deeper.setdefault(at, (low[1], low[2], []))[2].append(j)
        open_at = deeper
        if used == KEY_BITS:
            part, used = part + 1, 0
    return [found[j] for j in range(len(targets))]


#: Keys that several rows have are told to all tasks up to so many, some 40 MB; beyond, rows are joined to them by a shuffle.
BROADCAST_KEYS = 1_000_000


def _told_apart(keyed: DataFrame) -> DataFrame:
    """``keyed`` (_k1, _k2, ..) with ``_k3``, by which rows of one text and id differ; 0 for all others.

    Rows that share both hashes are written once with a number each, as which of them is which is nowhere else to see.
    """
    shared = staged(keyed.groupBy("_k1", "_k2").count().where("count > 1").drop("count"), "repeated-keys")
    n = shared.count()
    if not n:
        return keyed.withColumn("_k3", F.lit(0).cast("long"))
    shared = F.broadcast(shared) if n <= BROADCAST_KEYS else shared
    several = keyed.join(shared, ["_k1", "_k2"], "left_semi")
    several = staged(several.withColumn("_k3", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - KEY_BITS)), "repeated-rows")
    return keyed.join(shared, ["_k1", "_k2"], "left_anti").withColumn("_k3", F.lit(0).cast("long")).unionByName(several)


def shard(df: DataFrame, n_shards: int = 40, *, text: str = "text", id_col: str = "doc_id", overhead: int = 16, part_bytes: int = 64 << 20, tolerance: float = 0.002) -> DataFrame:
    """Rows of ``df`` with ``size``, ``shard``, ``slot`` and ``grown_shard``.

    Law: the shards' sizes (UTF-8 bytes of the text plus ``overhead``) are equal
    within ``tolerance`` of the mean, or else as near as whole rows allow. Equal
    texts are neighbours in the order and part only where a splitter needs it, so
    one text with a third of all rows spreads over a third of the shards. ``slot``
    counts a shard's rows from 0 without gaps: each shard's rows are dealt by a hash of text and id to
    parts of about ``part_bytes`` that number their rows alone, and the sums of the parts before are added, on the executors.
    ``grown_shard`` is null under this law.

    Null text has 0 bytes; a null id is one more id; repeated rows are all kept, and those
    equal in text and id are numbered, so that the law holds for them too; an empty table
    gives an empty one. Columns of ``df`` named like an output are replaced. A long text is one row and never cut:
    tasks sort by spilling.
    """
    out = ("size", "law", "shard", "slot", "grown_shard")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in out]).alias("_row"),
        F.shiftrightunsigned(F.xxhash64(body), 64 - KEY_BITS).alias("_k1"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 64 - KEY_BITS).alias("_k2"),
        (F.octet_length(body).cast("long") + overhead).alias("_size"),
    )
    keyed = _told_apart(keyed)
    keys = staged(keyed.select(*KEYS, "_size"), "shard-keys")
    total = int(keys.agg(F.sum("_size")).first()[0] or 0)
    splitters = find_splitters(keys, [total * j / n_shards for j in range(1, n_shards)], tolerance * total / n_shards) if total else []
    key = F.struct(*[F.col(k).alias(k) for k in KEYS])
    cuts = F.array(*[F.struct(*[F.lit(x).cast("long").alias(k) for k, x in zip(KEYS, s.key, strict=True)]) for s in splitters]).cast(f"array<struct<{', '.join(f'{k}: bigint' for k in KEYS)}>>")
    per_shard = max(1, -(-total // (n_shards * part_bytes)))
    shard_of = F.size(F.filter(cuts, lambda c: c <= key)) if splitters else F.lit(0)
    # the order's leading bits are alike within a shard, so parts are dealt by another hash
    part_of = F.pmod(F.xxhash64(*KEYS), F.lit(per_shard))
    where = {"_shard": shard_of.cast("int"), "_part": part_of.cast("int")}
    counts = staged(keys.withColumns(where).groupBy("_shard", "_part").agg(F.count("*").alias("_n")), "shard-parts")
    before = Window.partitionBy("_shard").orderBy("_part")
    starts = counts.withColumn("_start", F.sum("_n").over(before) - F.col("_n")).select("_shard", "_part", "_start")
    placed = keyed.withColumns(where).repartition(n_shards * per_shard, "_shard", "_part")
    nth = F.row_number().over(Window.partitionBy("_shard", "_part").orderBy(*KEYS, F.col(f"_row.`{id_col}`")))
    placed = placed.withColumn("_nth", nth).join(starts, ["_shard", "_part"])
    return placed.select(
        "_row.*",
        F.col("_size").alias("size"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_start") + F.col("_nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
