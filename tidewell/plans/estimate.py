"""Cross-fitted effect estimation: many networks trained in the same data-parallel passes.

An epoch is one job, for all folds or experiments at once: of one step, for which tasks sum the gradients of
their rows by network and the driver, which holds nothing but weights, takes it; or of mini-batches, for
which tasks step in lockstep. No driver gathers the data.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import nets
from ..operators import tables as T
from ..operators.nets import AdamW, Design, Weights
from ..sources import datasets as S
from . import batches


@dataclass
class Fitted:
    design: Design
    weights: dict[int, Weights]  # by fold; 0 is trained on all rows
    log: list[dict]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


#: Bins of a probability from which the log's AUROCs are read; ties inside a bin count half.
BINS = 200
HEADS = ("y0", "y1", "prop")


def _counts(design: Design, out: dict[str, np.ndarray], t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows by head, class and bin of probability; none for arms."""
    found = np.zeros((len(HEADS), 2, BINS))
    if design.kind != "arms":
        for h, (use, logit, label) in enumerate(((t < 0.5, out["y0"], y), (t > 0.5, out["y1"], y), (t > -1, out["propensity"], t))):
            at = np.minimum((BINS / (1 + np.exp(-np.clip(logit[use], -50, 50)))).astype(int), BINS - 1)
            for c in (0, 1):
                found[h, c] = np.bincount(at[(label[use] > 0.5) == bool(c)], minlength=BINS)
    return found.ravel()


def _aurocs(counts: np.ndarray, name: str) -> dict:
    out = {}
    for h, (no, yes) in zip(HEADS, counts.reshape(len(HEADS), 2, BINS), strict=True):
        both = no.sum() * yes.sum()
        out[f"{name}_auroc_{h}"] = float((yes * (np.cumsum(no) - no / 2)).sum() / both) if both else None
    return out


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_buffer()) for v in rows.column("v"))
    return pa.table({"f": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[-1].as_py()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})


def _full_pass(data: DataFrame, design: Design, weights: dict[int, Weights], optimisers: dict[int, AdamW], alpha: float, beta: float, marks: int, uses) -> dict[int, dict]:
    """One step over all rows: tasks sum gradients by model, and the driver, which holds nothing but weights, takes it."""
    held = data.sparkSession.sparkContext.broadcast(weights)  # the networks' size
    merged = math.ceil(data.rdd.getNumPartitions() ** 0.5)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x, t, y, own, val = _matrix(b.column("features")), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("t", "y", "fold", "val"))
            for f in held.value:
                mine = uses(own, f)
                if not mine.any():
                    continue
                use, check = mine & ~val, mine & val
                found = [np.zeros(marks), np.zeros(marks), np.zeros(2 * len(nets.flat(held.value[f])))]
                if use.any():
                    grads, moment, lost, out = nets.gradients(design, held.value[f], x[use], t[use], y[use], alpha, beta)
                    own_grads = nets.flat(grads)
                    found[0] = np.concatenate([lost, _counts(design, out, t[use], y[use])])
                    found[2] = np.concatenate([own_grads, nets.flat(moment) if moment else np.zeros(len(own_grads))])
                if check.any():
                    out = nets.forward(design, held.value[f], x[check])
                    found[1] = np.concatenate([nets.losses(design, out, t[check], y[check]), _counts(design, out, t[check], y[check])])
                total[f] = total.get(f, 0) + np.concatenate(found)
        part = TaskContext.get().partitionId() % merged
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([part] * len(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["f", "part", "v"])

    # sums of tasks meet in two rounds of about the square root of their number; the driver gets one network's size for each model
    parts = data.mapInArrow(sums, "f int, part int, v binary")
    if merged > 2:
        parts = parts.groupBy("f", "part").applyInArrow(_added, "f int, part int, v binary")
    out = {}
    for r in parts.groupBy("f").applyInArrow(_added, "f int, part int, v binary").collect():
        v = np.frombuffer(r.v)
        trained, checked, g = v[:marks], v[marks : 2 * marks], v[2 * marks :]
        if trained[0]:
            out[r.f] = {"loss": nets.total_loss(design, trained, alpha, beta), "trained": trained, "checked": checked, "grads": g}
    held.destroy()
    return out


def train(
    rows: DataFrame, design: Design, folds: int = 0, *, steps: int = 40, rate: float = 1e-2, alpha: float = 1.0, beta: float = 0.0, seed: int = 42,
    start: Weights | None = None, validation: Column | float | None = None, optimizer: str = "adamw", decay: float = 1e-4, schedule: str = "linear", id_col: str = "doc_id",
    batch_size: int | None = None, models: list[int] | None = None, model_col: str = "model", by_epoch: bool = False, validation_beta: float | None = None,
    tasks: int | None = None,
) -> Fitted:
    """Networks on ``features`` (array of doubles), ``t`` and ``y``; with ``folds``, one for each value of
    ``cv_fold`` from 1, trained on the rows of the others; with ``models``, one for each of these values of ``model_col``, trained on its own rows.
    All of them are trained in the same jobs, one an epoch.

    ``validation`` marks rows that no network learns from (a share: drawn by id); the weights kept are those of the least
    validation loss, or training loss where no row validates. ``start``: pretrained weights, of which what fits is taken over.
    ``beta`` weighs the targeted term, ``validation_beta`` (as ``beta`` if None) that of the validation loss. The log has a row for each network and epoch.

    With ``batch_size`` an epoch is as many steps as the rows have batches (see ``batches``), its training loss the mean of theirs, and the
    rate falls by the batch, or by the epoch if ``by_epoch``; its tasks must run at once, so the rows are dealt to as many as Spark has cores (or ``tasks``), and
    each keeps its share. Without, an epoch is one step over all rows, of which no task or driver keeps any.
    """
    if optimizer not in ("adamw", "adam"):
        raise ValueError(f"unknown optimizer {optimizer!r}")
    if batch_size is not None and batch_size < 1:
        raise ValueError("batch_size must be positive")
    wanted = list(models) if models is not None else list(range(1, folds + 1)) if folds else [0]
    weights = {f: transferred(start, design, seed + f) if start else nets.initial(design, seed + f) for f in wanted}
    group = F.col(model_col).cast("int") if models is not None else F.col("cv_fold").cast("int") if folds else F.lit(-1)
    keyed = models is not None
    uses = (lambda own, f: own == f) if keyed else (lambda own, f: own != f)
    if isinstance(validation, float):
        validation = rng.uniform(seed, "validation", id_col) < validation if validation else None
    held_in = F.lit(False) if validation is None else F.coalesce(validation, F.lit(False))
    data = rows.select(id_col, "features", F.col("t").cast("double"), F.col("y").cast("double"), group.alias("fold"), held_in.alias("val"))
    marks = 4 + len(HEADS) * 2 * BINS
    plan = None
    if batch_size is None:
        data = data.drop(id_col).persist(StorageLevel.MEMORY_AND_DISK)
        optimisers = {f: AdamW(rate, decay if optimizer == "adamw" else 0.0, steps, falls=schedule == "linear") for f in wanted}
    else:
        cores = tasks or rows.sparkSession.sparkContext.defaultParallelism
        data = T.numbered(data.withColumn("_of", F.struct("fold", "val")), "_of", "nth", seed, id_col).drop("_of", id_col).repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
        sizes = {r.fold: r["count"] for r in data.where("NOT val").groupBy("fold").count().collect()}  # a number for each fold or model
        offsets = {f: dict(zip(gs := sorted(g for g in sizes if uses(g, f)), np.cumsum([0, *(sizes[g] for g in gs)]).tolist(), strict=False)) for f in wanted}
        plan = batches.Plan(design, offsets, {f: sum(sizes[g] for g in offsets[f]) for f in wanted}, batch_size, alpha, beta, seed, by_epoch, steps)
        wanted_now = [f for f in wanted if plan.rows[f]]
        plan.offsets = {f: plan.offsets[f] for f in wanted_now}
        optimisers = {f: plan.optimiser(f, rate, decay if optimizer == "adamw" else 0.0, schedule == "linear") for f in wanted_now}
    best: dict[int, tuple[float, Weights]] = {}
    log = []
    for epoch in range(steps):
        if plan is None:
            found = _full_pass(data, design, weights, optimisers, alpha, beta, marks, uses)
        elif optimisers:
            found, made, optimisers = batches.run_epoch(data, plan, epoch, {f: weights[f] for f in optimisers}, optimisers, marks, _matrix, _counts, uses)
            weights |= made
        else:
            found = {}
        for f, r in found.items():
            trained, checked, n = r["trained"], r["checked"], r["trained"][0]
            val_loss = nets.total_loss(design, checked, alpha, beta if validation_beta is None else validation_beta) if checked[0] else None
            entry = {"fold": f, "epoch": epoch + 1, "train_loss": r["loss"], "outcome_loss": float(trained[1] / n), "treatment_loss": float(trained[2] / n), "targeted_loss": float((trained[3] / n) ** 2 if design.kind != "arms" else trained[3] / n)}
            log.append(entry | _aurocs(trained[4:], "train") | {"val_loss": val_loss} | _aurocs(checked[4:], "val"))
            judged = r["loss"] if val_loss is None else val_loss
            if f not in best or judged < best[f][0]:
                best[f] = (judged, {k: w.copy() for k, w in weights[f].items()})
            if plan is None:
                batches.step(design, weights[f], optimisers[f], trained, r["grads"], beta)
    data.unpersist()
    return Fitted(design, {f: best[f][1] if f in best else weights[f] for f in wanted}, sorted(log, key=lambda x: (x["fold"], x["epoch"])))


#: Columns of the training log.
LOG_SCHEMA = "fold int, epoch int, train_loss double, outcome_loss double, treatment_loss double, targeted_loss double, " + ", ".join([*(f"train_auroc_{h} double" for h in HEADS), "val_loss double", *(f"val_auroc_{h} double" for h in HEADS)])


def log_table(fitted: Fitted, spark) -> DataFrame:
    names = [x.split()[0] for x in LOG_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in fitted.log], LOG_SCHEMA)


def predict(rows: DataFrame, fitted: Fitted, phi: bool = False, model_col: str | None = None) -> DataFrame:
    """``rows`` with logits, probabilities and the effect; each row by the network that did not see its fold, or that ``model_col`` names.

    ``phi``: with the trunk's representation too, as an array.
    """
    held = rows.sparkSession.sparkContext.broadcast(fitted)
    by_fold = model_col is not None or 0 not in fitted.weights
    arms = fitted.design.kind == "arms"
    names = ["propensity_logits array<double>", "outcome_logits array<double>"] if arms else ["y0_logit double", "y1_logit double", "ite_logit double", "propensity_logit double"]
    names += ["phi array<double>"] * phi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            x = _matrix(b.column("features"))
            fold = b.column("_fold").to_numpy() if by_fold else np.zeros(b.num_rows, int)
            out: dict[str, np.ndarray] = {}
            for f in np.unique(fold):
                for k, v in nets.forward(model.design, model.weights[int(f)], x[fold == f]).items():
                    out.setdefault(k, np.zeros((b.num_rows, *v.shape[1:])))[fold == f] = v
            if b.num_rows:
                cols = [out["propensity"], out["outcome"]] if arms else [out["y0"], out["y1"], out["tau"], out["propensity"]]
                cols += [out["phi"]] * phi
                made = [pa.array(c.tolist()) for c in cols]
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns - 1)] + made, names=b.schema.names[:-1] + [n.split()[0] for n in names])

    fold = F.col(model_col or "cv_fold").cast("int") if by_fold else F.lit(0)
    source = rows.withColumn("_fold", fold)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = source.mapInArrow(run, f"{kept}, {', '.join(names)}")
    if arms:
        return out
    p = lambda c: 1 / (1 + F.exp(-F.col(c)))
    return out.withColumns({"y0_prob": p("y0_logit"), "y1_prob": p("y1_logit"), "propensity_prob": p("propensity_logit"), "ite_prob": p("y1_logit") - p("y0_logit")})


def fold_models(rows: DataFrame, folds: int, eps: float = 1e-5) -> DataFrame:
    """``rows`` (``features``, ``cv_fold`` from 1, ..) once for each fold, as ``model``, with features standardised by the moments of the other folds' rows.

    Train on rows whose ``cv_fold`` isn't their ``model``, predict the others: no row then bears on how it is judged. Sums by fold and feature, as
    many as the network's inputs, are broadcast.
    """
    own = rows.select("cv_fold", F.posexplode("features").alias("i", "x")).groupBy("cv_fold", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    model = F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("model")
    others = own.select("*", model).where("cv_fold <> model").groupBy("model", "i").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)) + eps)
    by_model = others.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", mean.alias("m"), std.alias("d")))), lambda z: F.struct(z["m"].alias("m"), z["d"].alias("d"))).alias("_z"))
    joined = rows.select("*", model).join(F.broadcast(by_model), "model")
    return joined.withColumn("features", F.zip_with("features", "_z", lambda x, z: (x - z["m"]) / z["d"])).drop("_z")


def weight_table(fitted: Fitted, spark) -> DataFrame:
    """A checkpoint: ``fold, layer, shape, data``."""
    rows = [(f, k, list(w.shape), w.ravel().tolist()) for f, ws in fitted.weights.items() for k, w in ws.items()]
    return spark.createDataFrame(rows, "fold int, layer string, shape array<int>, data array<double>")


def save_network(fitted: Fitted, path: str, spark, bank: DataFrame | None = None, **meta) -> str:
    """A checkpoint in the folder ``path``: ``weights``, ``bank`` if given, and ``meta`` (the design and what else is named)."""
    S.write_table(weight_table(fitted, spark), f"{path}/weights")
    if bank is not None:
        S.write_table(bank, f"{path}/bank")
    S.write_json({"design": dataclasses.asdict(fitted.design), "has_bank": bank is not None, **meta}, f"{path}/meta", spark)
    return path


@dataclass
class Network:
    """A checkpoint that was read: the fitted networks, the bank (None without) and what else was named."""

    fitted: Fitted
    bank: DataFrame | None
    meta: dict


def load_network(path: str, spark) -> Network:
    meta = S.read_json(f"{path}/meta", spark)
    design = Design(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta["design"].items()})
    weights: dict[int, Weights] = {}
    for r in spark.read.parquet(f"{path}/weights").collect():  # a network's size, whatever the data
        weights.setdefault(r.fold, {})[r.layer] = np.array(r.data).reshape(r.shape)
    return Network(Fitted(design, weights, []), spark.read.parquet(f"{path}/bank") if meta["has_bank"] else None, meta)


def extractor_config(network: Network) -> dict:
    """What a checkpoint's features are: vectors' width, confounders, features of each, pooling mode, outputs."""
    mode = network.meta.get("aggregator_mode", "attn")
    dim, latent, explicit, heads = None, 0, network.meta.get("num_explicit_confounders", 0), 1
    if network.bank is not None:
        every, heads, dim = network.bank.agg(F.count_distinct("conf_idx"), F.count_distinct("head"), F.max(F.size("vec"))).first()
        latent = every - explicit
    each = 2 if mode == "stats" else 1
    return {
        "embedding_dim": dim, "num_latent_confounders": latent, "num_explicit_confounders": explicit, "features_per_confounder": heads, "aggregator_mode": mode,
        "num_total_confounders": latent + explicit, "aggregator_features_per_conf": each, "total_output_dim": (latent + explicit) * heads * each,
    }


def compatibility(network: Network, confounders: int, features_per_confounder: int = 1, embedding_dim: int | None = None) -> dict:
    """Whether and how a checkpoint serves ``confounders`` of ``features_per_confounder`` features."""
    have = extractor_config(network)
    want = confounders * features_per_confounder * have["aggregator_features_per_conf"]
    strategy = transfer_strategy(have["total_output_dim"], want, have["embedding_dim"], embedding_dim)
    return {
        "compatible": not strategy.startswith("incompatible"), "pretrained_confounders": have["num_total_confounders"], "target_confounders": confounders,
        "load_strategy": strategy, "requires_adjustment": strategy != "direct", "phantom_features_needed": max(0, have["total_output_dim"] - want),
    }


def transferred_bank(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (conf_idx, head, vec) with the vectors of ``old`` where both have one of the same width; what ``old`` has beyond is left."""
    was = old.select("conf_idx", "head", F.col("vec").alias("_old"))
    joined = new.join(F.broadcast(was), ["conf_idx", "head"], "left")  # banks are bounded by pooling.MOST_BANK
    return joined.select("conf_idx", "head", F.when(F.size("_old") == F.size("vec"), F.col("_old")).otherwise(F.col("vec")).alias("vec"))


def model_from_checkpoint(path: str, spark, confounders: int, features_per_confounder: int = 1, kind: str | None = None, embedding_dim: int | None = None, seed: int = 42) -> Network:
    """A network for ``confounders`` of ``features_per_confounder`` features that starts from a checkpoint: all trunk layers that fit, the part that
    overlaps of those that don't, new heads; of ``kind``, or the checkpoint's. Its ``meta`` tells the strategy; with phantom padding its inputs are the checkpoint's.
    """
    old = load_network(path, spark)
    told = compatibility(old, confounders, features_per_confounder, embedding_dim)
    if not told["compatible"]:
        raise ValueError(f"the checkpoint can't serve: {told['load_strategy']}")
    each = extractor_config(old)["aggregator_features_per_conf"]
    inputs = max(old.fitted.design.inputs, confounders * features_per_confounder * each)
    design = dataclasses.replace(old.fitted.design, inputs=inputs, kind=kind or old.fitted.design.kind)
    weights = {f: transferred(w, design, seed + f) for f, w in old.fitted.weights.items()}
    return Network(Fitted(design, weights, []), old.bank, old.meta | told)


def transfer_strategy(have_inputs: int, want_inputs: int, have_dim: int | None = None, want_dim: int | None = None) -> str:
    """How pretrained weights fit a new design: direct, phantom_padding, partial_load or incompatible."""
    if have_dim is not None and want_dim is not None and have_dim != want_dim:
        return "incompatible_dimensions"
    if have_inputs == want_inputs:
        return "direct"
    if have_inputs <= 0 or want_inputs <= 0:
        return "incompatible"
    return "phantom_padding" if have_inputs > want_inputs else "partial_load"


def transferred(weights: Weights, design: Design, seed: int = 42) -> Weights:
    """New weights of ``design`` with every trunk layer of ``weights`` that fits, the overlapping part of those that don't."""
    out = nets.initial(design, seed)
    for k, w in weights.items():
        if k.startswith("trunk.") and k in out and w.ndim == out[k].ndim:
            part = tuple(slice(0, min(a, b)) for a, b in zip(w.shape, out[k].shape, strict=True))
            out[k][part] = w[part]
    return out
