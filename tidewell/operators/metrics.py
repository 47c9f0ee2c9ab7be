"""Metrics, losses and summaries as aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import vectors as V


def auroc(rows: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """``by, auroc``: the chance that a positive outscores a negative, ties counting half; null with one class.

    Rows without a score or label don't count. Equal scores are added up first, so ties stay whole; sums by score are dealt to tasks by ranges, and
    each task tells, for each of ``by``, its sums and what its positives win inside its range. What they win below it follows from these few rows.
    """
    by = by or []
    there = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = there.groupBy(*by, score).agg(F.sum(F.when(F.col(label) > 0.5, 1.0).otherwise(0.0)).alias("_p"), F.sum(F.when(F.col(label) > 0.5, 0.0).otherwise(1.0)).alias("_n"))
    kept = [f for f in counts.schema.fields if f.name in by]
    ranges = counts.select(*by, F.col(score).cast("double").alias("_first"), "_p", "_n").repartitionByRange(*by, "_first").sortWithinPartitions(*by, "_first")
    schema = StructType([*kept, *(StructField(c, DoubleType()) for c in ("_first", "_p", "_n", "_won"))])
    parts = ranges.mapInArrow(lambda batches: _range_sums(batches, by), schema)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row a task
    won = parts.withColumn("_won", F.col("_won") + F.col("_p") * before)
    total = F.sum("_p") * F.sum("_n")
    return won.groupBy(*by).agg(F.when(total > 0, F.sum("_won") / total).alias("auroc"))


def _range_sums(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """For each of ``by`` in a sorted range: first score, positives, negatives, and what positives win of the range's negatives."""
    held: list | None = None  # [of, first, p, n, won]
    schema = None

    def told(h: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*h[0], *h[1:]), schema.types, strict=True)], names=schema.names)

    for b in batches:
        if not b.num_rows:
            continue
        schema = pa.schema([*(b.schema.field(c) for c in by), *((c, pa.float64()) for c in ("_first", "_p", "_n", "_won"))])
        first, p, n = (b.column(c).to_numpy() for c in ("_first", "_p", "_n"))
        new = np.zeros(b.num_rows, bool)
        for c in by:
            codes = b.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= (codes[1:] != codes[:-1]) & ~(np.isnan(codes[1:].astype(float)) & np.isnan(codes[:-1].astype(float)))
        new[0] = True
        starts = np.flatnonzero(new).tolist()
        for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
            of = tuple(b.column(c)[i].as_py() for c in by)
            won = float((p[i:j] * (np.cumsum(n[i:j]) - n[i:j] / 2)).sum())
            if held is not None and held[0] == of:
                held[2:] = [held[2] + p[i:j].sum(), held[3] + n[i:j].sum(), held[4] + won + p[i:j].sum() * held[3]]
                continue
            if held is not None:
                yield told(held)
            held = [of, float(first[i]), float(p[i:j].sum()), float(n[i:j].sum()), won]
    if held is not None:
        yield told(held)


def treatment_aurocs(rows: DataFrame) -> DataFrame:
    """One row: AUROC of y0 on the untreated, y1 on the treated and of the propensity on all."""
    parts = F.array(
        F.struct(F.lit("y0").alias("head"), (F.col("t") < 0.5).alias("use"), F.col("y0_logit").alias("score"), F.col("y").alias("label")),
        F.struct(F.lit("y1").alias("head"), (F.col("t") > 0.5).alias("use"), F.col("y1_logit").alias("score"), F.col("y").alias("label")),
        F.struct(F.lit("prop").alias("head"), F.lit(True).alias("use"), F.col("propensity_logit").alias("score"), F.col("t").alias("label")),
    )
    long = rows.select(F.inline(parts)).where("use")
    return auroc(long, "score", "label", ["head"])


def recovery_scores(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How estimated effects recover true ones: ``true_ite, estimated_ite`` by scenario."""
    t, e = F.col("true_ite"), F.col("estimated_ite")
    steady = (F.stddev_pop(t) <= 1e-9) | (F.stddev_pop(e) <= 1e-9)
    return rows.groupBy(*(by or [])).agg(
        F.avg(t).alias("true_ate"),
        F.avg(e).alias("estimated_ate"),
        (F.avg(e) - F.avg(t)).alias("ate_bias"),
        F.sqrt(F.avg(F.pow(e - t, 2))).alias("ate_rmse"),
        F.when(~steady, F.corr(t, e)).alias("ite_correlation"),
        F.when(F.stddev_pop(t) > 1e-9, F.covar_samp(t, e) / F.var_pop(t)).alias("ite_regression_slope"),
    )


def targeted_loss(beta: float = 0.1, alpha: float = 1.0) -> list[Column]:
    """Aggregates over ``t, y, y0_logit, y1_logit, propensity_logit``: outcome, propensity, targeted and total loss."""
    f = F.when(F.col("t") > 0.5, F.col("y1_logit")).otherwise(F.col("y0_logit"))
    e = V.clip(V.sigmoid("propensity_logit"), 1e-3, 1 - 1e-3)
    h = F.col("t") / e - (1 - F.col("t")) / (1 - e)
    outcome, propensity = F.avg(V.bce(f, "y")), F.avg(V.bce("propensity_logit", "t"))
    targeted = F.pow(F.avg((F.col("y") - V.sigmoid(f)) * h), 2)
    return [outcome.alias("outcome_loss"), propensity.alias("propensity_loss"), targeted.alias("targeted_loss"), (outcome + alpha * propensity + beta * targeted).alias("loss")]


def multi_arm_loss(beta: float = 0.1, alpha: float = 1.0) -> list[Column]:
    """Aggregates over ``arm, y, arm_logits, outcome_logits``: cross-entropy, observed outcome, spread, total."""
    observed = F.element_at("outcome_logits", F.col("arm") + 1)
    cross = -F.ln(F.element_at(V.softmax("arm_logits"), F.col("arm") + 1))
    p = F.transform("outcome_logits", lambda x: 1 / (1 + F.exp(-x)))
    mean = F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.size(p)
    var = F.aggregate(p, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / (F.size(p) - 1)
    c, o, v = F.avg(cross), F.avg(V.bce(observed, "y")), -F.avg(var)
    return [c.alias("arm_loss"), o.alias("outcome_loss"), v.alias("spread_loss"), (o + alpha * c + beta * v).alias("loss")]


def feature_stats(features: DataFrame, heads: int = 1) -> DataFrame:
    return features.groupBy("feat_idx").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), (F.max("value") - F.min("value")).alias("range")).select(
        F.floor(F.col("feat_idx") / heads).cast("int").alias("confounder_idx"), (F.col("feat_idx") % heads).cast("int").alias("sub_feature_idx"), "mean", "std", "min", "max", "range"
    )


def confounder_summary(stats: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Means of ``feature_stats`` for each confounder, with its name; those beyond ``names`` are ``latent_`` and their place after them."""
    names = names or []
    known = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("confounder_idx") + 1) if names else F.lit(None).cast("string")
    latent = F.concat(F.lit("latent_"), F.col("confounder_idx") - len(names))
    out = stats.groupBy("confounder_idx").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.avg("range").alias("range"))
    return out.withColumn("confounder_name", F.when(F.col("confounder_idx") < len(names), known).otherwise(latent))


def drift_summary(drift: DataFrame, drifted_below: float = 0.95) -> DataFrame:
    """One row: mean, least and greatest cosine of ``latent_drift``, and how many latents drifted."""
    c = F.col("cosine_similarity")
    return drift.agg(F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.count_if(c < drifted_below).alias("n_drifted"))


def latent_drift(first: DataFrame, last: DataFrame) -> DataFrame:
    """``latent_idx, cosine_similarity, drift`` of two banks (latent_idx, vec)."""
    cos = V.cosine("a", "b")
    return first.select("latent_idx", F.col("vec").alias("a")).join(last.select("latent_idx", F.col("vec").alias("b")), "latent_idx").select("latent_idx", cos.alias("cosine_similarity"), (1 - cos).alias("drift"))


#: Features whose products one task sums at once, 32 MB of sums; more of them go block by block.
_SUMMED = 2048


def correlations(features: DataFrame, least: float = 0.0) -> DataFrame:
    """``feature_i < feature_j, correlation, mean_i, mean_j, std_i, std_j`` (population) of documents' features, where the correlation exceeds ``least`` in size.

    Every document has all features. Tasks sum the outer products of their documents' features, a block of features by
    another at a time; only the sums cross the network, one row for each task and pair of features.
    """
    wide = features.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("feat_idx", "value"))).alias("f"))  # a document's features number as the bank
    wide = wide.select(F.transform("f", lambda x: x["feat_idx"]).alias("i"), F.transform("f", lambda x: x["value"].cast("double")).alias("x"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        names, n, first, linear, square = np.zeros(0, np.int64), 0, None, 0.0, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            names = b.column("i")[0].values.to_numpy(zero_copy_only=False)
            n, linear, square = n + len(x), linear + x.sum(0), square + (x * x).sum(0)
            for p in range(0, x.shape[1], _SUMMED):
                for q in range(p, x.shape[1], _SUMMED):
                    total[p, q] = total.get((p, q), 0.0) + x[:, p : p + _SUMMED].T @ x[:, q : q + _SUMMED]
        for (p, q), s in total.items():
            i, j = np.nonzero(np.ones(s.shape, bool))
            up = i + p < j + q
            i, j = i[up] + p, j[up] + q
            cols = [names[i], names[j], np.full(len(i), float(n)), s[up.reshape(s.shape)], linear[i], linear[j], square[i], square[j]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if k < 2 else c) for k, c in enumerate(cols)], names=["feature_i", "feature_j", "n", "ij", "i", "j", "ii", "jj"])

    parts = wide.mapInArrow(sums, "feature_i int, feature_j int, n double, ij double, i double, j double, ii double, jj double")
    out = parts.groupBy("feature_i", "feature_j").agg(*[F.sum(c).alias(c) for c in ("n", "ij", "i", "j", "ii", "jj")])
    mean = {k: F.col(k) / F.col("n") for k in ("i", "j")}
    std = {k: F.sqrt(F.greatest(F.col(k + k) / F.col("n") - mean[k] * mean[k], F.lit(0.0))) for k in ("i", "j")}
    r = F.when(std["i"] * std["j"] > 0, (F.col("ij") / F.col("n") - mean["i"] * mean["j"]) / (std["i"] * std["j"]))
    out = out.select("feature_i", "feature_j", r.alias("correlation"), *[c.alias(f"{n}_{k}") for n, d in (("mean", mean), ("std", std)) for k, c in d.items()])
    return out.where(F.abs("correlation") > least)


def top_chunks(matches: DataFrame, k: int = 10, explicit: int = 0) -> DataFrame:
    """The k chunks of each bank vector with the highest cosine, ties by document and position, with their ``chunk`` where ``matches`` has it.

    ``confounder_type``: ``explicit`` for the first ``explicit`` confounders, else ``latent``. Spark keeps each task's own k before the shuffle.
    """
    order = Window.partitionBy("conf_idx", "head").orderBy(F.col("s").desc(), "doc_id", "pos")
    kind = F.when(F.col("conf_idx") < explicit, "explicit").otherwise("latent").alias("confounder_type")
    text = [F.col("chunk").alias("chunk_text")] if "chunk" in matches.columns else []
    top = matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("conf_idx", "head", kind, "rank", F.col("s").alias("activation"), "doc_id", "pos", *text)
