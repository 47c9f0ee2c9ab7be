"""Settings of experiments, as nested dataclasses that come from and go to JSON.

Field names and defaults are fixed values: users' configuration files hold them.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import typing
from dataclasses import dataclass, field

from ..operators.pooling import MODES as POOLING
from .plasmode import MODES, Scenario


#: Names of optimizers.
OPTIMIZERS = ("adamw", "adam")


@dataclass
class Architecture:
    model_type: str = "dragonnet"
    embedding_model_name: str = "hash"
    dragonnet_representation_dim: int = 128
    dragonnet_hidden_outcome_dim: int = 64
    aggregator_mode: str = "attn"
    num_latent_confounders: int = 20
    features_per_confounder: int = 1
    explicit_confounder_texts: list[str] | None = None
    chunk_size: int = 128
    chunk_overlap: int = 32
    arctanh_transform: bool = False


@dataclass
class Training:
    """``batch_size`` rows make a step; None makes an epoch one step over all rows."""

    learning_rate: float = 1e-4
    optimizer: str = "adamw"
    lr_schedule: str = "linear"
    epochs: int = 50
    batch_size: int | None = 8
    alpha_propensity: float = 1.0
    beta_targreg: float = 0.1
    init_latents_from_kmeans: bool = True


@dataclass
class Pretraining:
    enabled: bool = False
    dataset_path: str | None = None
    treatment_column: str = "treatment"
    architecture: Architecture = field(default_factory=Architecture)
    training: Training = field(default_factory=Training)


@dataclass
class PlasmodeScenario:
    generation_mode: str = "phi_linear"
    preserve_observed_treatments: bool = True
    baseline_control_outcome_rate: float = 0.20
    target_ate_logit: float = 0.50
    outcome_heterogeneity_scale: float = 1.0
    ite_heterogeneity_scale: float = 1.0
    deep_nonlinear_hidden_dims: list[int] = field(default_factory=lambda: [64, 32])
    deep_nonlinear_dropout: float = 0.0
    uplift_hidden_dims: list[int] = field(default_factory=list)
    uplift_activation: str = "relu"
    uplift_dropout: float = 0.0

    def scenario(self) -> Scenario:
        known = {f.name for f in dataclasses.fields(Scenario)}
        return Scenario(**{k: tuple(v) if isinstance(v, list) else v for k, v in dataclasses.asdict(self).items() if k in known})


@dataclass
class AppliedInference:
    dataset_path: str = ""
    text_column: str = "clinical_text"
    outcome_column: str = "outcome_indicator"
    treatment_column: str = "treatment_indicator"
    split_column: str = "split"
    cv_folds: int = 5
    architecture: Architecture = field(default_factory=Architecture)
    training: Training = field(default_factory=Training)
    use_pretrained_weights: bool = True
    skip: bool = False


@dataclass
class PlasmodeExperiments:
    enabled: bool = False
    num_repeats: int = 1
    save_datasets: bool = False
    train_fraction: float = 0.8
    generator_architecture: Architecture = field(default_factory=Architecture)
    generator_training: Training = field(default_factory=Training)
    evaluator_architecture: Architecture = field(default_factory=Architecture)
    evaluator_training: Training = field(default_factory=Training)
    plasmode_scenarios: list[PlasmodeScenario] = field(default_factory=list)
    oracle_mode: bool = False


@dataclass
class Experiment:
    """What one run does: pretraining, then inference on the data, then plasmode experiments."""

    output_dir: str = "./tidewell_results"
    seed: int = 42
    device: str | None = None
    num_workers: int = 1
    cache_dir: str | None = None
    gpu_ids: list[int] | None = None
    pretraining: Pretraining = field(default_factory=Pretraining)
    applied_inference: AppliedInference = field(default_factory=AppliedInference)
    plasmode_experiments: PlasmodeExperiments = field(default_factory=PlasmodeExperiments)

    @classmethod
    def from_dict(cls, data: dict) -> Experiment:
        return _build(cls, data, "")

    @classmethod
    def from_json(cls, path: str) -> Experiment:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    def to_json(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, indent=2)

    def get_hash(self) -> str:
        return hashlib.md5(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()[:12]

    def validate(self) -> None:
        """Raise one ValueError that lists everything wrong."""
        wrong = []
        if not self.applied_inference.skip and not self.applied_inference.dataset_path:
            wrong.append("applied_inference.dataset_path is missing")
        if self.pretraining.enabled and not self.pretraining.dataset_path:
            wrong.append("pretraining.dataset_path is missing")
        plasmode = self.plasmode_experiments
        if plasmode.enabled:
            if not plasmode.plasmode_scenarios:
                wrong.append("plasmode_experiments has no scenario")
            if not 0 < plasmode.train_fraction < 1:
                wrong.append("plasmode_experiments.train_fraction must lie between 0 and 1")
            if not self.applied_inference.dataset_path:
                wrong.append("plasmode experiments need applied_inference.dataset_path")
            wrong += [f"unknown generation_mode {s.generation_mode!r}" for s in plasmode.plasmode_scenarios if s.generation_mode not in MODES]
        for where, a in (("applied_inference", self.applied_inference.architecture), ("pretraining", self.pretraining.architecture), ("generator", plasmode.generator_architecture), ("evaluator", plasmode.evaluator_architecture)):
            if a.model_type not in ("dragonnet", "uplift"):
                wrong.append(f"{where}: unknown model_type {a.model_type!r}")
            if a.aggregator_mode not in POOLING:
                wrong.append(f"{where}: unknown aggregator_mode {a.aggregator_mode!r}")
            if not 0 <= a.chunk_overlap < a.chunk_size:
                wrong.append(f"{where}: chunk_overlap must be at least 0 and below chunk_size")
        for where, t in (("applied_inference", self.applied_inference.training), ("pretraining", self.pretraining.training), ("generator", plasmode.generator_training), ("evaluator", plasmode.evaluator_training)):
            if t.optimizer not in OPTIMIZERS:
                wrong.append(f"{where}: unknown optimizer {t.optimizer!r}")
            if t.epochs < 1 or t.learning_rate <= 0:
                wrong.append(f"{where}: epochs and learning_rate must be above 0")
            if t.batch_size is not None and t.batch_size < 1:
                wrong.append(f"{where}: batch_size must be above 0, or null for one step an epoch")
        for s in plasmode.plasmode_scenarios:
            if s.deep_nonlinear_dropout or s.uplift_dropout:
                wrong.append("simulated effects have no dropout: deep_nonlinear_dropout and uplift_dropout must be 0")
        if wrong:
            raise ValueError("; ".join(wrong))


#: Fixed value: the older name of a setting.
LEGACY = {"evaluator_use_generator_confounders": "oracle_mode"}


def _build(kind: type, data: dict, where: str):
    data = {LEGACY.get(k, k): v for k, v in data.items()}
    types = typing.get_type_hints(kind)
    if unknown := sorted(set(data) - set(types)):
        raise ValueError(f"unknown settings: {', '.join(where + k for k in unknown)}")
    made = {}
    for k, v in data.items():
        inner = next(iter(typing.get_args(types[k])), None)
        if dataclasses.is_dataclass(types[k]):
            v = _build(types[k], v, f"{where}{k}.")
        elif dataclasses.is_dataclass(inner):
            v = [_build(inner, x, f"{where}{k}.") for x in v]
        made[k] = v
    return kind(**made)


def create_default_config(path: str) -> Experiment:
    """Write a file to start from: inference on a dataset, and one scenario of each kind that is off."""
    made = Experiment(applied_inference=AppliedInference(dataset_path="./dataset.parquet"), plasmode_experiments=PlasmodeExperiments(plasmode_scenarios=[PlasmodeScenario(m) for m in MODES]))
    made.to_json(path)
    return made
