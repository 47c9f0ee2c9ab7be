"""Outcome networks in numpy: forward passes, gradients, and AdamW over summed gradients."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

Weights = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass(frozen=True)
class Design:
    """Widths of a trunk and of its heads.

    ``kind``: ``dragon`` (potential outcomes), ``uplift`` (baseline and effect) or ``arms`` (a head for
    each of ``arms`` treatments). ``trunk`` empty: heads on the features alone. A layer's
    activation is ReLU, the last hidden one's ELU, but for the propensity's, which are all ReLU.
    """

    inputs: int
    kind: str = "dragon"
    trunk: tuple[int, ...] = (128,) * 6
    propensity: tuple[int, ...] = ()
    outcome: tuple[int, ...] = (64, 64)
    arms: int = 2

    @property
    def heads(self) -> dict[str, tuple[tuple[int, ...], int]]:
        """Hidden widths and outputs of each head."""
        if self.kind == "arms":
            return {"propensity": (self.propensity, self.arms)} | {f"outcome{k}": (self.outcome, 1) for k in range(self.arms)}
        if self.kind not in ("dragon", "uplift"):
            raise ValueError(f"unknown network {self.kind!r}")
        names = ("y0", "y1") if self.kind == "dragon" else ("y0", "tau")
        return {"propensity": (self.propensity, 1)} | {n: (self.outcome, 1) for n in names}


def _stack(name: str, dims: list[int], rng: np.random.Generator) -> Weights:
    out = {}
    for i, (a, b) in enumerate(zip(dims, dims[1:], strict=False)):
        out[f"{name}.{i}.w"], out[f"{name}.{i}.b"] = rng.normal(size=(a, b)) * (2 / a) ** 0.5, np.zeros(b)
    return out


def initial(design: Design, seed: int = 42) -> Weights:
    rng = np.random.default_rng(seed)
    out = _stack("trunk", [design.inputs, *design.trunk], rng)
    width = design.trunk[-1] if design.trunk else design.inputs
    for name, (hidden, n) in design.heads.items():
        out |= _stack(name, [width, *hidden, n], rng)
    return out


@dataclass
class _Pass:
    """One stack's forward pass, kept for its gradient."""

    weights: Weights
    name: str
    n: int
    final_elu: bool
    inputs: list[np.ndarray] = field(default_factory=list)
    sums: list[np.ndarray] = field(default_factory=list)

    def _hidden(self, i: int) -> str:
        if i == self.n - 1:
            return "elu" if self.final_elu else "none"
        return "elu" if i == self.n - 2 and not self.final_elu and self.name != "propensity" else "relu"

    def forward(self, x: np.ndarray) -> np.ndarray:
        for i in range(self.n):
            self.inputs.append(x)
            z = x @ self.weights[f"{self.name}.{i}.w"] + self.weights[f"{self.name}.{i}.b"]
            self.sums.append(z)
            kind = self._hidden(i)
            x = z if kind == "none" else np.maximum(z, 0) if kind == "relu" else np.where(z > 0, z, np.expm1(np.minimum(z, 0)))
        return x

    def backward(self, g: np.ndarray, grads: Weights) -> np.ndarray:
        for i in reversed(range(self.n)):
            z, kind = self.sums[i], self._hidden(i)
            if kind != "none":
                g = g * ((z > 0) if kind == "relu" else np.where(z > 0, 1, np.exp(np.minimum(z, 0))))
            grads[f"{self.name}.{i}.w"], grads[f"{self.name}.{i}.b"] = self.inputs[i].T @ g, g.sum(0)
            g = g @ self.weights[f"{self.name}.{i}.w"].T
        return g


def _passes(design: Design, weights: Weights, x: np.ndarray) -> tuple[_Pass, np.ndarray, dict[str, _Pass], dict[str, np.ndarray]]:
    trunk = _Pass(weights, "trunk", len(design.trunk), True)
    phi = trunk.forward(x)
    heads = {k: _Pass(weights, k, len(h) + 1, False) for k, (h, _) in design.heads.items()}
    return trunk, phi, heads, {k: p.forward(phi) for k, p in heads.items()}


def _outputs(design: Design, phi: np.ndarray, out: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    if design.kind == "arms":
        return {"phi": phi, "propensity": out["propensity"], "outcome": np.hstack([out[f"outcome{k}"] for k in range(design.arms)])}
    y0 = out["y0"][:, 0]
    tau = out["tau"][:, 0] if design.kind == "uplift" else out["y1"][:, 0] - y0
    return {"phi": phi, "propensity": out["propensity"][:, 0], "y0": y0, "y1": y0 + tau, "tau": tau}


def forward(design: Design, weights: Weights, x: np.ndarray) -> dict[str, np.ndarray]:
    """Logits of every head, and ``phi``; ``uplift`` gives y1 as baseline plus effect."""
    _, phi, _, out = _passes(design, weights, x)
    return _outputs(design, phi, out)


#: Propensities are held this far from 0 and 1 in the targeted term.
CLIP = 1e-3


def _bce(logits: np.ndarray, y: np.ndarray) -> float:
    return float((np.maximum(logits, 0) - logits * y + np.log1p(np.exp(-np.abs(logits)))).sum())


def losses(design: Design, out: dict[str, np.ndarray], t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums over the rows of what ``forward`` gave: rows, outcome loss, treatment loss, and the targeted moment (for arms: minus the spread)."""
    n = len(y)
    if design.kind == "arms":
        arm = t.astype(int)
        logits = out["propensity"] - out["propensity"].max(1, keepdims=True)
        treatment = (np.log(np.exp(logits).sum(1)) - logits[np.arange(n), arm]).sum()
        p = _sigmoid(out["outcome"])
        return np.array([n, _bce(out["outcome"][np.arange(n), arm], y), treatment, -p.var(axis=1, ddof=1).sum() if design.arms > 1 else 0.0])
    f = np.where(t > 0.5, out["y1"], out["y0"])
    return np.array([n, _bce(f, y), _bce(out["propensity"], t), ((y - _sigmoid(f)) * _weight(out["propensity"], t)).sum()])


def _weight(propensity: np.ndarray, t: np.ndarray) -> np.ndarray:
    e = np.clip(_sigmoid(propensity), CLIP, 1 - CLIP)
    return t / e - (1 - t) / (1 - e)


def total_loss(design: Design, sums: np.ndarray, alpha: float, beta: float) -> float:
    """Outcome plus ``alpha`` times treatment loss plus ``beta`` times the squared targeted moment (for arms: the spread itself)."""
    n, outcome, treatment, moment = sums[:4]
    extra = moment / n if design.kind == "arms" else (moment / n) ** 2
    return float(outcome / n + alpha * treatment / n + beta * extra)


def gradients(design: Design, weights: Weights, x: np.ndarray, t: np.ndarray, y: np.ndarray, alpha: float = 1.0, beta: float = 0.0) -> tuple[Weights, Weights | None, np.ndarray, dict[str, np.ndarray]]:
    """Summed gradients over the rows, the targeted moment's own (propensities held fixed in it), the sums of ``losses``, and the outputs.

    The moment is a mean over all rows and enters the loss squared, so its gradient is scaled once the sums of all tasks are
    known; the spread of arms is a sum over rows and is in the first gradient.
    """
    trunk, phi, heads, raw = _passes(design, weights, x)
    out = _outputs(design, phi, raw)
    seed: dict[str, np.ndarray] = {}
    n = len(y)
    second: dict[str, np.ndarray] = {}
    if design.kind == "arms":
        arm = t.astype(int)
        logits = out["propensity"] - out["propensity"].max(1, keepdims=True)
        p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
        seed["propensity"] = alpha * (p - np.eye(design.arms)[arm])
        chance = _sigmoid(out["outcome"])
        off = chance[np.arange(n), arm] - y
        spread = -beta * 2 * (chance - chance.mean(1, keepdims=True)) / max(1, design.arms - 1) * chance * (1 - chance)
        for k in range(design.arms):
            seed[f"outcome{k}"] = (off * (arm == k) + spread[:, k])[:, None]
    else:
        treated = t > 0.5
        seed["propensity"] = alpha * (_sigmoid(out["propensity"]) - t)[:, None]
        q = _sigmoid(np.where(treated, out["y1"], out["y0"]))
        moved = -q * (1 - q) * _weight(out["propensity"], t)
        for found, g in ((seed, q - y), (second, moved)):
            found["y0"] = (g * ~treated if design.kind == "dragon" else g)[:, None]
            found["y1" if design.kind == "dragon" else "tau"] = (g * treated)[:, None]
        second["propensity"] = np.zeros((n, 1))

    def back(seeds: dict[str, np.ndarray]) -> Weights:
        grads: Weights = {}
        trunk.backward(sum(heads[k].backward(seeds[k], grads) for k in heads), grads)
        return grads

    return back(seed), back(second) if second and beta else None, losses(design, out, t, y), out


@dataclass
class AdamW:
    """Decoupled weight decay (0: Adam); the learning rate falls linearly to a tenth over ``steps``, unless ``falls`` is off."""

    rate: float = 1e-2
    decay: float = 1e-4
    steps: int = 50
    falls: bool = True
    at: int = 0
    first: Weights = field(default_factory=dict)
    second: Weights = field(default_factory=dict)

    def step(self, weights: Weights, grads: Weights, done: int | None = None) -> None:
        """One step; the rate has fallen by the steps so far, or by ``done`` of ``steps``."""
        self.at += 1
        rate = self.rate * (1 - 0.9 * min(1.0, (self.at - 1 if done is None else done) / max(1, self.steps - 1)) * self.falls)
        for k, g in grads.items():
            m = self.first[k] = 0.9 * self.first.get(k, 0) + 0.1 * g
            v = self.second[k] = 0.999 * self.second.get(k, 0) + 0.001 * g * g
            weights[k] -= rate * (m / (1 - 0.9**self.at) / (np.sqrt(v / (1 - 0.999**self.at)) + 1e-8) + self.decay * weights[k])


def count_parameters(weights: Weights) -> int:
    """Numbers that training may change."""
    return sum(w.size for w in weights.values())


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unflat(values: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k], at = values[at : at + n].reshape(like[k].shape), at + n
    return out
