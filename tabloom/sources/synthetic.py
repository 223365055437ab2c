"""Labelled toy tables (two coordinates and a class), computed from row numbers.

Each takes a DataFrame with a row-number column and the row count, so the rows are made in
parallel; ``table`` makes one from a range. Noise is Gaussian from hashed uniforms.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import hashing

N, SEED = 100_000, 30
# Fixed values of the toy tables.
CIRCLE_FACTOR, NOISE = 0.5, 0.05
LINEAR_NOISE = 0.1
VARIED_STD = (1.0, 2.5, 0.5)
ANISOTROPIC = ((0.6, -0.6), (-0.4, 0.8))
BLOB_BOX = 10.0


def gaussian(seed, *keys) -> Column:
    """Standard normal from two uniforms."""
    u, v = hashing.uniform(seed, "u", *keys), hashing.uniform(seed, "v", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


def _with_noise(df, x0, x1, y, noise, seed, row):
    r = F.col(row)
    if noise:
        x0 = x0 + F.lit(noise) * gaussian(seed, "x0", r)
        x1 = x1 + F.lit(noise) * gaussian(seed, "x1", r)
    return df.select(row, x0.alias("x_0"), x1.alias("x_1"), y.cast("int").alias("y"))


def circles(df: DataFrame, row: str, n: int, factor: float = CIRCLE_FACTOR, noise: float = NOISE, seed=SEED) -> DataFrame:
    """Outer circle (class 0) and inner circle (class 1), evenly spaced."""
    outer = n // 2
    inside = F.col(row) >= outer
    k = F.when(inside, F.col(row) - outer).otherwise(F.col(row)).cast("double")
    m = F.when(inside, F.lit(float(max(n - outer, 1)))).otherwise(F.lit(float(max(outer, 1))))
    angle = F.lit(2.0 * math.pi) * k / m
    r = F.when(inside, F.lit(float(factor))).otherwise(F.lit(1.0))
    return _with_noise(df, r * F.cos(angle), r * F.sin(angle), inside.cast("int"), noise, seed, row)


def moons(df: DataFrame, row: str, n: int, noise: float = NOISE, seed=SEED) -> DataFrame:
    """Two interleaving half circles."""
    outer = n // 2
    inside = F.col(row) >= outer
    k = F.when(inside, F.col(row) - outer).otherwise(F.col(row)).cast("double")
    m = F.when(inside, F.lit(float(max(n - outer - 1, 1)))).otherwise(F.lit(float(max(outer - 1, 1))))
    angle = F.lit(math.pi) * k / m
    x0 = F.when(inside, F.lit(1.0) - F.cos(angle)).otherwise(F.cos(angle))
    x1 = F.when(inside, F.lit(0.5) - F.sin(angle)).otherwise(F.sin(angle))
    return _with_noise(df, x0, x1, inside.cast("int"), noise, seed, row)


def blobs(df: DataFrame, row: str, n: int, std: tuple[float, ...] = (1.0, 1.0, 1.0), seed=SEED,
          transform=None) -> DataFrame:
    """Gaussian clusters of equal size around centers drawn in a box, optionally mapped linearly."""
    rng = random.Random(seed)
    centers = [(rng.uniform(-BLOB_BOX, BLOB_BOX), rng.uniform(-BLOB_BOX, BLOB_BOX)) for _ in std]
    k = len(std)
    y = F.pmod(F.col(row), F.lit(k)).cast("int")

    def pick(vals):
        return F.element_at(F.array(*[F.lit(float(v)) for v in vals]), y + 1)

    s = pick(std)
    x0 = pick([c[0] for c in centers]) + s * gaussian(seed, "x0", F.col(row))
    x1 = pick([c[1] for c in centers]) + s * gaussian(seed, "x1", F.col(row))
    if transform:
        (a, b), (c, d) = transform
        x0, x1 = x0 * a + x1 * c, x0 * b + x1 * d
    return df.select(row, x0.alias("x_0"), x1.alias("x_1"), y.alias("y"))


def varied_blobs(df, row, n, seed=SEED):
    return blobs(df, row, n, VARIED_STD, seed)


def anisotropic_blobs(df, row, n, seed=SEED):
    return blobs(df, row, n, seed=seed, transform=ANISOTROPIC)


def linearly_separable(df: DataFrame, row: str, n: int, noise: float = LINEAR_NOISE, seed=SEED) -> DataFrame:
    """Uniform points; the class is the side of the diagonal, blurred."""
    r = F.col(row)
    x0, x1 = hashing.uniform(seed, "x0", r), hashing.uniform(seed, "x1", r)
    y = (x1 - x0 + F.lit(noise) * gaussian(seed, "n", r)) > 0
    return df.select(row, x0.alias("x_0"), x1.alias("x_1"), y.cast("int").alias("y"))


GENERATORS = {
    "noisy_circles": circles,
    "noisy_moons": moons,
    "varied_clusters": varied_blobs,
    "anisotropic_clusters": anisotropic_blobs,
    "blobs": blobs,
    "linearly_separable": linearly_separable,
}


def table(spark: SparkSession, name: str, n: int = N, seed=SEED) -> DataFrame:
    """``x_0, x_1, y`` of a named toy table."""
    return GENERATORS[name](spark.range(n).withColumnRenamed("id", "row"), "row", n, seed=seed).drop("row")
