"""Columns over arrays of numbers, and the scalar functions of the models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, though ``use`` names it for every element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def doubles(v: Column | str) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column | str, least: float = 1e-12) -> Column:
    return once(F.greatest(norm(v), F.lit(least)), lambda n: F.transform(doubles(v), lambda x: x / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-clip(x, -500.0, 500.0)))


def logit(p: Column | str) -> Column:
    return F.ln(_col(p) / (1 - _col(p)))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(_col(x), F.lit(low)), F.lit(high))


def stretched(x: Column | str) -> Column:
    """Inverse hyperbolic tangent, kept finite."""
    return F.atanh(clip(x, -0.999, 0.999))


def softmax(v: Column | str) -> Column:
    e = once(F.array_max(doubles(v)), lambda top: F.transform(doubles(v), lambda x: F.exp(x - top)))
    shares = lambda w: once(F.aggregate(w, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(w, lambda x: x / total))
    return once(e, shares)


def padded(v: Column | str, have: int, want: int) -> Column:
    """An array of ``have`` numbers with zeros up to ``want``, as a network of more inputs expects."""
    return F.concat(doubles(v), F.array_repeat(F.lit(0.0), want - have)) if want > have else doubles(v)


def bce(x: Column | str, y: Column | str) -> Column:
    """Binary cross-entropy of a logit."""
    x, y = _col(x), _col(y)
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
