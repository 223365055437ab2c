"""Periodic encoding of numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def coefficients(n: int, sigma: float, kind: str = "log-linear", seed: int = 0) -> list[float]:
    """sigma ** (i / n), or repeatable normal draws of that deviation."""
    if kind == "log-linear":
        return [sigma ** (i / n) for i in range(n)]
    if kind == "normal":
        import random

        rng = random.Random(seed)
        return [rng.gauss(0.0, sigma) for _ in range(n)]
    raise ValueError(f"unknown kind: {kind}")


def periodic(x: Column, coefs: list[float]) -> Column:
    """[cos(2 pi c x) ..., sin(2 pi c x) ...] as an array of doubles."""
    arg = [F.lit(2.0 * math.pi * c) * x.cast("double") for c in coefs]
    return F.array(*[F.cos(a) for a in arg], *[F.sin(a) for a in arg])
