"""Centroid clustering against plain rounds over all pairs."""

import hashlib

import numpy as np
import pytest

from tabloom.llm import centroids
from tabloom.llm.registered import op13_centroids
from tests.conftest import SF


def brute(rows, k=40, rounds=5, scale=256, dim=64):
    kept = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        label = [j for _, j in assign()]
        for j in range(len(cents)):
            own = [v for (_, v), m in zip(kept, label, strict=True) if m == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = assign()
    by = {j: sum(d for d, m in last if m == j) for j in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, j, d, by[j], sum(by.values()), sha[j]) for (i, _), (d, j) in zip(kept, last, strict=True)], key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], key=str)


def test_query_on_the_whole_table(spark, table):
    rows = [(r["vec_id"], r["embedding"]) for r in table("embeddings").collect()]
    assert got(op13_centroids(spark, SF)) == brute(rows)


def test_ties_hot_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i) % 90, x.tolist()) for i, x in enumerate(rng.integers(-3, 3, size=(200, 4)) / 4)]
    rows += [(500 + i, [0.5, 0.5, -0.25, 0.0]) for i in range(100)]
    rows += [(None, [0.1, 0.2, 0.3, 0.4]), (1, None), (2, [1.0]), (3, [float("nan")] * 4), (4, [None, 1.0, 1.0, 1.0]), (5, [float("inf")] * 4)]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(5)
    out = centroids.cluster(df, k=12, rounds=3, scale=4, dim=4)
    assert got(out) == brute(rows, 12, 3, 4, 4)
    assert got(centroids.cluster(df, k=1000, rounds=2, scale=4, dim=4)) == brute(rows, 1000, 2, 4, 4)
    far = spark.createDataFrame([(1, [1e300] * 4), (2, [5e8, 0.0, 0.0, 0.0]), (3, [-5e8, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert got(centroids.cluster(far, k=1, rounds=1, scale=1, dim=4)) == brute([(2, [5e8, 0, 0, 0]), (3, [-5e8, 0, 0, 0])], 1, 1, 1, 4)


def test_nothing_to_cluster(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    for rows in (df, df.limit(0)):
        assert centroids.cluster(rows).count() == 0


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_inequalities_lose_nothing_and_save_distances(dim):
    rng = np.random.default_rng(dim)
    x = rng.integers(-200, 200, size=(2000, dim)) + rng.integers(-500, 500, size=(2000, 1))
    c = x[rng.choice(2000, 40, replace=False)]
    label, best, computed = centroids.Centroids(c).nearest(x)
    d = ((x[:, None, :] - c) ** 2).sum(2)
    assert (best == d.min(1)).all() and (label == d.argmin(1)).all()
    assert computed < 0.6 * d.size
