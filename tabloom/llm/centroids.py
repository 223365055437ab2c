"""Centroid clustering in whole numbers, by equal-average equal-variance search.

For vectors x and c of d components, with means and deviations (the length of what is left when the mean
is taken from every component), |x - c|^2 >= d (mean x - mean c)^2 + (dev x - dev c)^2. Centroids lie
sorted by mean. A vector looks at them from its own mean outwards and stops when the first term alone
exceeds the least distance found, as it only grows from there; a centroid that both terms together rule
out is passed over. What remains is settled by the exact distance in whole numbers.

Vectors are read once per round; what returns is a row per centroid and task, summed up by Spark, and
the new centroids are as many numbers as the parameters say, however large the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import map_batches
from tabloom.session import scratch_path

DIM = 64
BLOCK = 8192  # vectors compared at a time
SLACK = 1e-9  # error granted to deviations, as a share of the value


def largest_component(dim: int) -> int:
    """Components stay below, so that a squared distance stays below 2^62."""
    return int(2**30 / np.sqrt(max(1, dim)))


class Centroids:
    """Centroids in the order of their sums, ready to be searched."""

    def __init__(self, c: np.ndarray):
        self.c = c
        sums = c.sum(1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]
        self.sorted = c[self.order]
        self.dev = _deviation(self.sorted, self.sums)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of ``x`` the number of the nearest centroid, ties to the smaller, the squared
        distance, and how many distances were computed in all."""
        n, dim, k = len(x), x.shape[1], len(self.c)
        sums = x.sum(1)
        dev = _deviation(x, sums)
        best = np.full(n, np.iinfo(np.int64).max)
        label = np.full(n, k)
        # Next centroid to look at below and above; both sides end where there is none.
        above = np.searchsorted(self.sums, sums)
        below = above - 1
        far = np.float64(np.inf)
        active, computed = np.arange(n), 0
        while len(active):
            lo, hi, s = below[active], above[active], sums[active]
            d_lo = np.where(lo >= 0, np.abs(s - self.sums[np.maximum(lo, 0)]).astype(np.float64), far)
            d_hi = np.where(hi < k, np.abs(self.sums[np.minimum(hi, k - 1)] - s).astype(np.float64), far)
            down = d_lo <= d_hi
            at = np.where(down, lo, hi)
            below[active[down]] -= 1
            above[active[~down]] += 1
            gap = np.minimum(d_lo, d_hi)
            by_mean = gap * gap / dim
            limit = best[active].astype(np.float64) * (1 + SLACK)
            go_on = (by_mean <= limit) & np.isfinite(gap)  # beyond, no centroid on either side can be nearer
            active, at, by_mean, limit = active[go_on], at[go_on], by_mean[go_on], limit[go_on]
            apart = np.maximum(np.abs(dev[active] - self.dev[at]) - SLACK * (dev[active] + self.dev[at]), 0)
            close = by_mean + apart * apart <= limit
            who, to = active[close], at[close]
            computed += len(who)
            diff = x[who] - self.sorted[to]
            exact = (diff * diff).sum(1)
            name = self.order[to]
            better = (exact < best[who]) | ((exact == best[who]) & (name < label[who]))
            best[who[better]], label[who[better]] = exact[better], name[better]
        return label, best, computed


def _deviation(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return np.sqrt((((x - (sums / x.shape[1])[:, None])) ** 2).sum(1))


def whole(vectors: DataFrame, scale: int, dim: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (id, v): floor(scale * x) of every component x, of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    below = float(largest_component(dim))
    fits = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < below))
    made = F.when(fits, F.transform(v, lambda x: F.floor(x * scale).cast("int")))
    return vectors.select(F.col(vec_id).cast("long").alias("id"), made.alias("v")).where(F.col("v").isNotNull())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.int64)


def _step(rows: DataFrame, centroids: np.ndarray, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Count and sum of the vectors nearest to each centroid."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(shared.value)
        count = np.zeros(len(shared.value), dtype=np.int64)
        total = np.zeros(shared.value.shape, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for a in range(0, len(x), BLOCK):
                label, _, _ = search.nearest(x[a : a + BLOCK])
                count += np.bincount(label, minlength=len(count))
                np.add.at(total, label, x[a : a + BLOCK])
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(count[held]), pa.array(total[held].tolist(), type=pa.list_(pa.int64()))], names=["cluster", "n", "total"]
        )

    part = rows.select("v").mapInArrow(add_up, "cluster int, n long, total array<long>")
    # Decimals, as the sum over a very large table may leave 64 bits.
    sums = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    got = part.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect()  # a row per centroid
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(dim)]) for r in got}


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2", dim: int = DIM, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256), one per vector kept.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; a component counts as
    floor(scale * x). Components that reach 2^30 / sqrt(dim) as whole numbers are treated like
    non-finite ones, as distances would not fit a long. The first centroids are the k vectors with the smallest
    hex sha256 of ``<seed>:<vec_id>`` (without an id: of ``<seed>:``), fewer if there are fewer; rows that
    repeat an id are vectors of their own, told apart by their components. Each round assigns every
    vector to the nearest centroid, ties to the smaller number, and puts every centroid that has any at
    the floor of their mean; then vectors are assigned once more. ``distance`` is squared. Inertia is the sum of
    distances, null where it does not fit a long.
    """
    spark = vectors.sparkSession
    path = scratch_path(spark, "cluster-vectors")
    whole(vectors, scale, dim, vec_id, vector).write.parquet(path)
    rows = spark.read.parquet(path)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(name, "v").limit(k).select("v").collect()  # k vectors
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    for _ in range(rounds):
        found = _step(rows, centroids, dim)
        centroids = centroids.copy()
        for c, (n, total) in found.items():
            centroids[c] = [t // n for t in total]
    shared = spark.sparkContext.broadcast(centroids)

    def start():
        search = Centroids(shared.value)

        def each(batch):
            x = _matrix(batch.column(1), dim)
            done = [search.nearest(x[a : a + BLOCK])[:2] for a in range(0, len(x), BLOCK)] or [(np.zeros(0, int), np.zeros(0, int))]
            yield {"vec_id": batch.column(0), "cluster": np.concatenate([d[0] for d in done]), "distance": np.concatenate([d[1] for d in done])}

        return each

    path = scratch_path(spark, "cluster-assigned")
    map_batches(rows.select("id", "v"), "vec_id long, cluster int, distance long", start).write.parquet(path)
    assigned = spark.read.parquet(path)
    exact = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()  # a row per centroid
    fit = lambda n: n if n < 1 << 63 else None
    total = fit(sum(int(r["sum"]) for r in exact))
    told = [
        (r["cluster"], fit(int(r["sum"])), total, centroids[r["cluster"]].tolist(), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest())
        for r in exact
    ]
    kinds = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return assigned.join(F.broadcast(kinds), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
