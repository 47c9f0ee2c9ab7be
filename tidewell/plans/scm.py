"""Synthetic patients from a structural causal model, as columns over a range of ids."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..functions import vectors as V


@dataclass
class Variable:
    name: str
    type: str = "continuous"
    categories: list[str] = field(default_factory=list)  # the first is the reference level
    mean: float = 0.0
    std: float = 1.0
    shares: list[float] | None = None
    unit: str | None = None

    def __post_init__(self) -> None:
        if not self.name or self.type not in ("continuous", "categorical"):
            raise ValueError(f"bad variable {self.name!r} of type {self.type!r}")
        if self.type == "categorical" and not self.categories:
            raise ValueError(f"{self.name} has no categories")


@dataclass
class Equation:
    intercept: float = 0.0
    coefficients: dict[str, float] = field(default_factory=dict)  # a variable, or variable_category
    interactions: list[tuple[tuple[str, ...], float]] = field(default_factory=list)
    treatment: float = 0.0
    treatment_interactions: dict[str, float] = field(default_factory=dict)

    def scaled(self, factor: float) -> Equation:
        """All but the intercept and the treatment's own coefficient, times ``factor``."""
        return Equation(self.intercept, {k: v * factor for k, v in self.coefficients.items()}, [(t, c * factor) for t, c in self.interactions], self.treatment, {k: v * factor for k, v in self.treatment_interactions.items()})


@dataclass
class Model:
    variables: list[Variable]
    treatment: Equation
    outcome: Equation
    seed: int = 42

    def terms(self) -> dict[str, Column]:
        """What equations may name: z-scores of continuous variables, dummies of categories but the first."""
        out = {}
        for v in self.variables:
            if v.type == "continuous":
                out[v.name] = (F.col(v.name) - v.mean) / v.std if v.std else F.col(v.name) - v.mean
            else:
                out |= {f"{v.name}_{c}": F.when(F.col(v.name) == c, 1.0).otherwise(0.0) for c in v.categories[1:]}
        return out


def default_model() -> Model:
    """A small model to try things on."""
    age, stage, sex = Variable("age", mean=60, std=12, unit="years"), Variable("marker", mean=1.5, std=0.5), Variable("sex", "categorical", ["female", "male"], shares=[0.55, 0.45])
    site = Variable("site", "categorical", ["north", "south", "west"], shares=[0.5, 0.3, 0.2])
    treatment = Equation(0.1, {"age": 0.6, "marker": -0.4, "sex_male": 0.3, "site_south": -0.2}, [(("age", "marker"), 0.15)])
    outcome = Equation(-0.8, {"age": 0.5, "marker": 0.7, "site_west": 0.4}, [(("marker", "sex_male"), 0.2)], 1.0, {"age": -0.3})
    return Model([age, stage, sex, site], treatment, outcome)


def all_pairs(equation: Equation, names: list[str], coefficient) -> Equation:
    """With an interaction for each pair of terms that lacks one; ``coefficient`` gives its weight."""
    there = {tuple(sorted(t)) for t, _ in equation.interactions}
    more = [(p, coefficient(p)) for p in combinations(names, 2) if tuple(sorted(p)) not in there]
    return Equation(equation.intercept, equation.coefficients, [*equation.interactions, *more], equation.treatment, equation.treatment_interactions)


#: How far drawn coefficients reach, and what given ones are scaled by.
MAIN_SCALE, INTERACTION_SCALE = 0.3, 0.1


def model_from_spec(spec: dict, treatment_coefficient: float = 1.0, main_scale: float = MAIN_SCALE, interaction_scale: float = INTERACTION_SCALE, seed: int = 42) -> Model:
    """A model from ``confounders``, ``treatment_equation``, ``outcome_equation`` and ``summary_statistics``, as JSON holds them.

    Given coefficients are scaled down; every term gets an interaction with the treatment, and every pair of terms
    without one an interaction in the treatment equation, drawn from -1 to 1 times ``interaction_scale``.
    A variable without statistics has mean 0 and spread 1, a category without shares an equal one.
    """
    given = spec.get("summary_statistics", {})
    variables = []
    for c in spec["confounders"]:
        name, kind, known = c.get("name", ""), c.get("type", ""), given.get(c.get("name"), {})
        shares = known.get("proportions", {})
        levels = list(c.get("categories", []))
        variables.append(Variable(name, kind, levels, known.get("mean", 0.0), known.get("std", 1.0), [shares.get(x, 0.0) for x in levels] if sum(shares.get(x, 0.0) for x in levels) > 0 else None, c.get("unit")))
    if len({v.name for v in variables}) < len(variables):
        raise ValueError("confounders have unlike names")
    draws = np.random.default_rng(seed)
    drawn = lambda _: float(draws.uniform(-1, 1) * interaction_scale)

    def equation(name: str) -> Equation:
        e = spec.get(name, {})
        pairs = [(tuple(i["terms"]), i.get("coefficient", 0.0) * interaction_scale) for i in e.get("interactions", [])]
        return Equation(e.get("intercept", 0.0), {k: v * main_scale for k, v in e.get("coefficients", {}).items()}, pairs)

    treatment, outcome = equation("treatment_equation"), equation("outcome_equation")
    terms = [t for v in variables for t in ([v.name] if v.type == "continuous" else [f"{v.name}_{c}" for c in v.categories[1:]])]
    outcome.treatment, outcome.treatment_interactions = treatment_coefficient, {t: drawn(t) for t in terms}
    return Model(variables, all_pairs(treatment, terms, drawn), outcome, seed)


@dataclass
class GeneratorConfig:
    """Settings of a synthetic dataset. ``spec``: a JSON file of a model; without it the built-in one serves."""

    question: str = "Does the treatment change the outcome?"
    dataset_size: int = 500
    treatment_coefficient: float = 0.5
    target_treatment_rate: float = 0.5
    target_control_outcome_rate: float = 0.2
    main_coefficient_scale: float = MAIN_SCALE
    interaction_coefficient_scale: float = INTERACTION_SCALE
    target_logit_std: float = 2.0
    num_confounders: int | None = None
    output_dir: str = "./synthetic_output"
    spec: str | None = None
    seed: int = 42

    @classmethod
    def from_json(cls, path: str) -> GeneratorConfig:
        with open(path, encoding="utf-8") as f:
            return cls(**json.load(f))

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, indent=2)

    def validate(self) -> None:
        wrong = []
        if self.dataset_size < 1:
            wrong.append("dataset_size must be at least 1")
        if not self.question.strip():
            wrong.append("the question is empty")
        if self.num_confounders is not None and self.num_confounders < 1:
            wrong.append("num_confounders must be at least 1")
        wrong += [f"{n} must lie between 0 and 1" for n in ("target_treatment_rate", "target_control_outcome_rate") if not 0 < getattr(self, n) < 1]
        if self.target_logit_std <= 0:
            wrong.append("target_logit_std must be above 0")
        if wrong:
            raise ValueError("; ".join(wrong))

    def model(self, provider: Callable[[str, int | None], dict] | None = None) -> Model:
        """The model: of ``provider``, which makes a spec for a question and a number of confounders, of the file, or built in."""
        self.validate()
        if provider is None and self.spec is None:
            made = default_model()
            return Model(made.variables, made.treatment, replace(made.outcome, treatment=self.treatment_coefficient), self.seed)
        if provider is not None:
            spec = provider(self.question, self.num_confounders)
        else:
            with open(self.spec, encoding="utf-8") as f:
                spec = json.load(f)
        if self.num_confounders is not None and len(spec["confounders"]) != self.num_confounders:
            raise ValueError(f"the spec has {len(spec['confounders'])} confounders, not {self.num_confounders}")
        return model_from_spec(spec, self.treatment_coefficient, self.main_coefficient_scale, self.interaction_coefficient_scale, self.seed)


def characteristics(ids: DataFrame, model: Model, id_col: str = "patient_id") -> DataFrame:
    columns = {v.name: rng.normal(model.seed, v.name, id_col, v.mean, v.std) if v.type == "continuous" else rng.categorical(v.categories, v.shares, model.seed, v.name, id_col) for v in model.variables}
    return ids.withColumns(columns)


def logit(equation: Equation, model: Model, treated: Column | float | None = None) -> Column:
    """The equation as one column; a term that the model lacks is an error."""
    terms = model.terms()
    if unknown := [n for n in [*equation.coefficients, *(t for ts, _ in equation.interactions for t in ts), *equation.treatment_interactions] if n not in terms]:
        raise ValueError(f"no such terms: {', '.join(unknown)}")
    out = F.lit(float(equation.intercept))
    for name, c in equation.coefficients.items():
        out = out + c * terms[name]
    for names, c in equation.interactions:
        out = out + c * reduce(lambda a, b: a * b, [terms[n] for n in names])
    if treated is not None:
        t = F.lit(float(treated)) if isinstance(treated, (int, float)) else treated
        out = out + t * (equation.treatment + sum((c * terms[n] for n, c in equation.treatment_interactions.items()), F.lit(0.0)))
    return out


def rescaled(model: Model, spark: SparkSession, treatment_std: float = 2.0, outcome_std: float = 2.0, n: int = 10_000) -> Model:
    """Equations scaled so that the logits spread as wanted; the wider arm counts for the outcome."""
    rows = characteristics(spark.range(n).withColumnRenamed("id", "patient_id"), model)
    t, y0, y1 = rows.agg(F.stddev_pop(logit(model.treatment, model)), F.stddev_pop(logit(model.outcome, model, 0.0)), F.stddev_pop(logit(model.outcome, model, 1.0))).first()
    scale = lambda e, want, have: e.scaled(want / have) if have > 1e-12 else e
    return Model(model.variables, scale(model.treatment, treatment_std, t), scale(model.outcome, outcome_std, max(y0, y1)), model.seed)


def calibrated(model: Model, spark: SparkSession, treatment_rate: float = 0.5, control_outcome_rate: float = 0.2, n: int = 10_000, steps: int = 40) -> Model:
    """Intercepts at which the mean probabilities meet the wanted rates, by bisection on [-10, 10].

    Sixteen probes a round are one aggregate, so a round narrows the interval seventeenfold.
    """
    rows = characteristics(spark.range(n).withColumnRenamed("id", "patient_id"), model)
    parts = {"t": (model.treatment, treatment_rate, None), "y": (model.outcome, control_outcome_rate, 0.0)}
    base = rows.select(*[(logit(e, model, arm) - e.intercept).alias(k) for k, (e, _, arm) in parts.items()]).cache()
    found = {}
    for k, (_, want, _) in parts.items():
        low, high = -10.0, 10.0
        while high - low > 1e-9:
            probes = [low + (high - low) * i / 17 for i in range(18)]
            rates = base.agg(*[F.avg(V.sigmoid(F.col(k) + p)).alias(f"p{i}") for i, p in enumerate(probes)]).first()
            at = max((i for i in range(17) if rates[i] <= want), default=0)
            low, high = probes[at], probes[at + 1]
        found[k] = (low + high) / 2
    base.unpersist()
    t, y = model.treatment, model.outcome
    return Model(model.variables, Equation(found["t"], t.coefficients, t.interactions), Equation(found["y"], y.coefficients, y.interactions, y.treatment, y.treatment_interactions), model.seed)


def described(model: Model) -> Column:
    """A patient's characteristics as text, one to a line; a unit, not a name, decides the form."""
    lines = [F.concat(F.lit(f"- {v.name}: "), F.format_string("%.0f " + v.unit if v.unit else "%.2f", F.col(v.name)) if v.type == "continuous" else F.col(v.name)) for v in model.variables]
    return F.concat_ws("\n", *lines)


def patients(ids: DataFrame, model: Model, id_col: str = "patient_id") -> DataFrame:
    """Ids with treatment, both potential outcomes' logits, the outcome, the true effect and a note made from a template."""
    rows = characteristics(ids, model, id_col)
    rows = rows.withColumns({"true_treatment_logit": logit(model.treatment, model), "outcome_logit_0": logit(model.outcome, model, 0.0), "outcome_logit_1": logit(model.outcome, model, 1.0)})
    rows = rows.withColumn("treatment_indicator", rng.bernoulli(V.sigmoid("true_treatment_logit"), model.seed, "treatment", id_col))
    rows = rows.withColumn("true_outcome_logit", F.when(F.col("treatment_indicator") == 1, F.col("outcome_logit_1")).otherwise(F.col("outcome_logit_0")))
    rows = rows.withColumn("outcome_indicator", rng.bernoulli(V.sigmoid("true_outcome_logit"), model.seed, "outcome", id_col))
    rows = rows.withColumn("true_ite", F.col("outcome_logit_1") - F.col("outcome_logit_0"))
    prompt = F.concat(F.lit("Write a clinical note about this patient.\n"), described(model))
    note = F.concat(F.lit("Patient seen today. Findings:\n"), described(model), F.when(F.col("treatment_indicator") == 1, "\nTreatment was given.").otherwise("\nNo treatment was given."))
    return rows.withColumns({"patient_prompt": prompt, "clinical_text": note})


def dataset_statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n_patients"), F.avg("treatment_indicator").alias("treatment_rate"), F.avg("outcome_indicator").alias("outcome_rate"),
        F.avg("true_treatment_logit").alias("treatment_logit_mean"), F.stddev_samp("true_treatment_logit").alias("treatment_logit_std"),
        F.avg("true_outcome_logit").alias("outcome_logit_mean"), F.stddev_samp("true_outcome_logit").alias("outcome_logit_std"),
        F.avg(F.length("clinical_text")).alias("text_mean_length"), F.count_if(F.length("clinical_text") > 0).alias("texts"),
    )
