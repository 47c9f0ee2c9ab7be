"""Deterministic draws: every number is a function of a seed, a tag and a row's id."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed: int | Column, tag: str, id_col: Column | str) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat_ws(":", s, F.lit(tag), c.cast("string")))


def uniform(seed: int | Column, tag: str, id_col: Column | str) -> Column:
    """In [0, 1): the first 32 bits of an MD5."""
    return F.conv(F.substring(_key(seed, tag, id_col), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def bernoulli(p: Column | float, seed: int, tag: str, id_col: Column | str) -> Column:
    return (uniform(seed, tag, id_col) < (F.lit(p) if isinstance(p, (int, float)) else p)).cast("int")


def normal(seed: int, tag: str, id_col: Column | str, mean: float = 0.0, std: float = 1.0) -> Column:
    """Box and Muller's transform of two uniforms."""
    u, v = uniform(seed, f"{tag}:u", id_col), uniform(seed, f"{tag}:v", id_col)
    return F.lit(mean) + F.lit(std) * F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def categorical(levels: list[str], shares: list[float] | None, seed: int, tag: str, id_col: Column | str) -> Column:
    """A level with the given shares, brought to sum 1; equal shares if none are given or all are 0."""
    shares = shares if shares and sum(shares) > 0 else [1.0] * len(levels)
    u, out = uniform(seed, tag, id_col), F.lit(levels[-1])
    for level, share in reversed(list(zip(levels[:-1], _running(shares), strict=False))):
        out = F.when(u < share, F.lit(level)).otherwise(out)
    return out


def _running(shares: list[float]) -> list[float]:
    total, sums = 0.0, []
    for s in shares:
        total += s
        sums.append(total / sum(shares))
    return sums


def order_key(seed: int, tag: str, id_col: Column | str) -> Column:
    """A hash by which rows are shuffled alike on any partitioning."""
    return _key(seed, tag, id_col)


def fold(k: int, seed: int, id_col: Column | str) -> Column:
    """Fold 1 to k of a row: its draw's k-th part. Folds are equal in expectation, and need no global sort."""
    return (F.floor(uniform(seed, "fold", id_col) * k) + 1).cast("int")
