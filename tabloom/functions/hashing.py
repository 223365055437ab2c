"""Repeatable randomness: every draw is a hash of (seed, stable keys), never ``rand()``.

A retried task therefore draws the same numbers, and the same run can be repeated elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(seed, keys):
    return [F.lit(str(seed))] + [
        (F.lit(k) if isinstance(k, str) else k).cast("string") for k in keys
    ]


def digest(seed, *keys) -> Column:
    """md5 hex of ``seed:key:key...``; strings are literals, Columns are values."""
    return F.md5(F.concat_ws(":", *_parts(seed, keys)).cast("binary"))


def uniform(seed, *keys) -> Column:
    """Double in [0, 1) with 32 random bits."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def below(n: Column, seed, *keys) -> Column:
    """Whole number in [0, n)."""
    return F.floor(uniform(seed, *keys) * n).cast("long")


def _hex(n: int) -> str:
    return format(n, "08x")


def chance(p: float, seed, *keys) -> Column:
    """uniform < p, decided on the hex text: no conversion to numbers per row."""
    edge = math.ceil(float(p) * 2**32)
    if edge >= 2**32:
        return F.lit(True)
    return digest(seed, *keys) < F.lit(_hex(max(edge, 0)))


def exceeds(p: float, seed, *keys) -> Column:
    """uniform > p, decided on the hex text."""
    edge = math.floor(float(p) * 2**32)
    if edge < 0:
        return F.lit(True)
    if edge >= 2**32:
        return F.lit(False)
    return digest(seed, *keys) > F.lit(_hex(edge) + "f" * 24)
