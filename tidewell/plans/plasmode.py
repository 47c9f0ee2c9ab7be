"""Plasmode simulation: known effects put onto observed features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions import vectors as V

MODES = ("phi_linear", "deep_nonlinear", "uplift_nonlinear")


@dataclass(frozen=True)
class Scenario:
    generation_mode: str = "phi_linear"
    preserve_observed_treatments: bool = True
    baseline_control_outcome_rate: float = 0.2
    target_ate_logit: float = 0.5
    outcome_heterogeneity_scale: float = 1.0
    ite_heterogeneity_scale: float = 1.0
    deep_nonlinear_hidden_dims: tuple[int, ...] = (64, 32)
    uplift_hidden_dims: tuple[int, ...] = ()
    uplift_activation: str = "relu"

    def __post_init__(self) -> None:
        if self.generation_mode not in MODES:
            raise ValueError(f"unknown generation mode {self.generation_mode!r}; known: {', '.join(MODES)}")


def direction(seed: int, dim: int) -> list[float]:
    """A seeded unit vector."""
    v = np.random.default_rng(seed).normal(size=dim)
    return (v / np.linalg.norm(v)).tolist()


def _layers(seed: int, dims: list[int]) -> list[np.ndarray]:
    r = np.random.default_rng(seed)
    return [r.normal(size=(a, b)) * (2 / a) ** 0.5 for a, b in zip(dims, dims[1:], strict=False)]


def _network(x: Column, layers: list[np.ndarray], activation: str) -> Column:
    """A small random network of literal weights, as an expression on an array column."""
    act = (lambda c: F.greatest(c, F.lit(0.0))) if activation == "relu" else F.tanh
    for i, w in enumerate(layers):
        x = F.array(*[_dot(x, w[:, j]) for j in range(w.shape[1])])
        if i < len(layers) - 1:
            x = F.transform(x, act)
    return F.element_at(x, 1)


def _dot(x: Column, w: np.ndarray) -> Column:
    return V.dot(x, F.array(*[F.lit(float(v)) for v in w]))


def _standard(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """z-scores by the moments of the training rows, one row that is broadcast."""
    m = df.where(train).agg(*[f(c).alias(f"_{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.crossJoin(F.broadcast(m))
    for c in columns:
        mean, std = F.col(f"_{c}_m"), F.col(f"_{c}_s")
        joined = joined.withColumn(c, F.when(std < 1e-9, F.col(c) - mean).otherwise((F.col(c) - mean) / std))
    return joined.drop(*m.columns)


def simulate(rows: DataFrame, dim: int, scenario: Scenario, scenario_idx: int = 0, repeat_idx: int = 0, train: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """``rows`` (id, ``features`` of ``dim`` numbers, ``t``) with simulated ``t, y`` and ``true_y0_logit, true_y1_logit, true_ite``.

    One data-generating process holds for all splits of a scenario and repeat; its draws follow from both numbers and a row's id.
    """
    seed = 1000 * scenario_idx + repeat_idx
    base = float(np.log(scenario.baseline_control_outcome_rate / (1 - scenario.baseline_control_outcome_rate)))
    x, on = F.col("features"), F.lit(True) if train is None else train
    linear = lambda k: V.dot(x, F.array(*[F.lit(v) for v in direction(seed * 10 + k, dim)]))
    scale_y, scale_t, ate = scenario.outcome_heterogeneity_scale, scenario.ite_heterogeneity_scale, scenario.target_ate_logit
    if scenario.generation_mode == "phi_linear":
        out = _standard(rows.withColumns({"_y": linear(0), "_tau": linear(1)}), ["_y", "_tau"], on)
        out = out.withColumns({"true_y0_logit": base + scale_y * F.col("_y"), "true_ite": ate + scale_t * F.col("_tau")})
    elif scenario.generation_mode == "deep_nonlinear":
        layers = _layers(seed * 10 + 2, [dim + 1, *scenario.deep_nonlinear_hidden_dims, 1])
        at = lambda t: _network(F.concat(V.doubles(x), F.array(F.lit(float(t)))), layers, "relu")
        out = rows.withColumns({"_y": at(0), "_tau": at(1)}).withColumn("_tau", F.col("_tau") - F.col("_y"))
        out = _standard(out, ["_y", "_tau"], on)
        out = out.withColumns({"true_y0_logit": base + scale_y * F.col("_y"), "true_ite": ate + scale_t * F.col("_tau")})
    else:
        tau = _network(V.doubles(x), _layers(seed * 10 + 3, [dim, *scenario.uplift_hidden_dims, 1]), scenario.uplift_activation) if scenario.uplift_hidden_dims else linear(1)
        out = _standard(rows.withColumns({"_y": linear(0), "_tau": tau}), ["_tau"], on)
        out = out.withColumns({"true_y0_logit": base + scale_y * F.col("_y"), "true_ite": ate + scale_t * F.col("_tau")})
    if not scenario.preserve_observed_treatments:
        out = out.withColumn("t", rng.bernoulli(0.5, seed, "treatment", id_col).cast("double"))
    out = out.withColumn("true_y1_logit", F.col("true_y0_logit") + F.col("true_ite"))
    chance = V.sigmoid(F.when(F.col("t") > 0.5, F.col("true_y1_logit")).otherwise(F.col("true_y0_logit")))
    return out.withColumn("y", rng.bernoulli(chance, seed, "outcome", id_col).cast("double")).drop("_y", "_tau")
