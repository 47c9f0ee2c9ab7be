"""Toxicity scores of restored text.

A character trigram model of all documents decodes disguised words (see
``deobfuscate``). Words and their leading bytes, as written and as restored, are the
features; a logistic regression over the telling ones, fitted on labelled rows,
gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deobfuscate import SYMBOLS, Decoder, prefix_features, suspicious_spans, trigram_counts
from .shared import in_share, staged
from .shingles import lowered
from .textarrays import U64, pieces, text_buffer

#: Leading bytes of words that are features; 0 is the whole word.
LENGTHS = (4, 5, 6, 7, 0)
#: At most about so many labelled rows are fitted on: a bounded, documented sample by a hash of the id.
TRAIN_ROWS = 40_000
#: A feature must be in so many distinct toxic texts, or in such a share of them if that is more, and so much likelier there.
LEAST_TEXTS, LEAST_SHARE, LEAST_LOG_ODDS = 3, 0.002, 3.0
#: At most so many features, those with the most evidence.
MOST_FEATURES = 20_000
#: Weight of the squared coefficients, and steps of the fit.
RIDGE, STEPS = 0.0002, 2000
THRESHOLD = 0.3


@dataclass
class Model:
    """Sorted feature hashes, their weights, the bias and the trigram counts."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    trigrams: np.ndarray


def _restored(buf: np.ndarray, offs: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of every row's restored spans."""
    rows, starts, ends = suspicious_spans(buf, offs)
    parts: list[list[str]] = [[] for _ in range(len(offs) - 1)]
    data = buf.tobytes()
    for r, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
        parts[r].append(decoder.restore(data[a:b].decode("utf-8", "ignore")))
    made = [" ".join(p).encode() for p in parts]
    return np.frombuffer(b"".join(made), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int64)


def _features(texts: pa.Array, decoder: Decoder, known: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Piece by piece: first row, number of rows, and the distinct (row, feature) pairs, of ``known`` only if given."""
    buf, offs = text_buffer(lowered(texts))
    for a, b in pieces(offs):
        part, bounds = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        rows, hashes = [], []
        for data, at in ((part, bounds), _restored(part, bounds, decoder)):
            row, found = prefix_features(data, at, LENGTHS)
            for h in found:
                keep = h != 0
                if known is not None:
                    keep &= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else False
                rows.append(row[keep])
                hashes.append(h[keep])
        row, h = np.concatenate(rows), np.concatenate(hashes)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        if len(row):
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
            row, h = row[first], h[first]
        yield a, b - a, row, h


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Symbol trigrams of all rows: each task counts its own, at most 22,000 sums meet in the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            buf, offs = text_buffer(b.column(0))
            for i, j in pieces(offs):
                total += trigram_counts(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["trigram", "n"])

    out = np.zeros(SYMBOLS**3, np.int64)
    for r in docs.select(F.col(text).cast("string")).mapInArrow(count, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        out[r.trigram] = r.n
    return out


def held_out(id_col: str = "doc_id"):
    """Whether a row is never learnt from: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Distinct labelled texts, ``text`` and ``label``; the labels that go to the executors are at most about ``most``."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sample = known.where(in_share("doc_id", most, known.count()))
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    # equal texts with unlike labels take the commoner one, toxic where they tie
    return staged(rows.groupBy("text").agg((F.avg("label") >= 0.5).cast("int").alias("label")), "toxic-training")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled rows that are not held out; only texts are inputs."""
    trigrams = count_trigrams(docs)
    rows = _training_rows(docs, labels, train_rows)
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not toxic or toxic == total:
        return Model(np.zeros(0, U64), np.zeros(0), -20.0 if not toxic else 20.0, trigrams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(trigrams)
        for b in batches:
            label = b.column("label").to_numpy()
            for first, _, row, h in _features(b.column("text"), decoder, None):
                names, inverse = np.unique(h, return_inverse=True)
                of = np.bincount(inverse, label[first + row], minlength=len(names)).astype(np.int64)
                every = np.bincount(inverse, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(of), pa.array(every - of)], names=["feature", "toxic", "clean"])

    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (total - toxic + 1))
    telling = rows.mapInArrow(count, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    telling = telling.where(F.col("toxic") >= max(LEAST_TEXTS, LEAST_SHARE * toxic)).withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS)
    top = telling.orderBy((F.col("odds") * F.col("toxic")).desc(), "feature").limit(MOST_FEATURES).select("feature").collect()
    features = np.sort(np.array([r.feature for r in top], np.int64).astype(U64))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(trigrams)
        for b in batches:
            for first, n, row, h in _features(b.column("text"), decoder, features):
                at = np.searchsorted(features, h).astype(np.int32)
                cuts = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("label").slice(first, n), pa.ListArray.from_arrays(pa.array(cuts), pa.array(at))], names=["label", "at"])

    # the sample is bounded, and so is what it holds of the chosen features
    sample = rows.mapInArrow(presence, "label int, at array<int>").toPandas()
    return Model(features, *_regress(sample["label"].to_numpy(float), [np.asarray(x, np.int64) for x in sample["at"]], len(features)), trigrams)


def _regress(y: np.ndarray, at: list[np.ndarray], n: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on presences by gradient steps with momentum."""
    row = np.repeat(np.arange(len(y)), [len(x) for x in at])
    col = np.concatenate(at) if at else np.zeros(0, np.int64)
    w, bias = np.zeros(n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    speed, bias_speed = np.zeros(n), 0.0
    share = np.bincount(col, minlength=n) / len(y)
    rate = 1 / (0.25 * np.maximum(share, 1e-4) + RIDGE)  # a bound on each coefficient's curvature
    scale = 1 / max(1.0, np.bincount(row, minlength=len(y)).max(initial=1) ** 0.5)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[col], minlength=len(y)) + bias)))
        off = (p - y) / len(y)
        speed = 0.8 * speed - 0.2 * scale * rate * (np.bincount(col, off[row], minlength=n) + RIDGE * w)
        bias_speed = 0.8 * bias_speed - 0.8 * off.sum()
        w, bias = w + speed, bias + bias_speed
    return w, bias + _shift(np.bincount(row, w[col], minlength=len(y)) + bias, y)


def _shift(logits: np.ndarray, y: np.ndarray) -> float:
    """What moves the best cut of the training rows (by F1, in the middle of its gap) to THRESHOLD."""
    order = np.argsort(-logits)
    x, hits = logits[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][x[1:] == x[:-1]] = 0  # no cut between equal logits
    best = int(np.argmax(f1))
    cut = (x[best] + x[best + 1]) / 2 if best + 1 < len(x) else x[best] - 1
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` for each row: 0 to 1, higher where the label is likelier 1.

    Null and empty texts have no feature and get the score of the bias; a null id stays null; repeated rows
    get equal scores; an empty table gives an empty one; other columns are not read. A task holds about 1 MB of
    text, or its longest, at some tens of bytes a byte; a span is decoded whole, however long.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights and 22,000 counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        decoder = Decoder(model.trigrams)
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            for first, n, row, h in _features(b.column("text"), decoder, model.features):
                sums = np.bincount(row, model.weights[np.searchsorted(model.features, h)], minlength=n) if len(row) else np.zeros(n)
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(1 / (1 + np.exp(-np.clip(sums + model.bias, -40, 40))))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``, by a model fitted on ``labels``."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all their columns.

    Rows are judged by id and text, so a null or repeated id is judged by each of its texts; null and empty texts
    stay unless the bias itself is toxic; repeated rows share a fate; without labels all stay; an empty table
    gives an empty one; columns of any names are kept. Long texts are as in score.
    """
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.withColumn("_row_key", F.xxhash64(F.col("doc_id").cast("long"), text))
    scored = score(keyed.select(F.col("_row_key").alias("doc_id"), "text"), fit(docs, labels))
    toxic = scored.where(F.col("score") >= threshold).select(F.col("doc_id").alias("_row_key")).distinct()
    return keyed.join(toxic, "_row_key", "left_anti").select(docs.columns)
