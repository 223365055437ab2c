"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into partitions of equal size that keep neighbours
together, and a small classifier learns which partition a vector belongs to. Every row is indexed in its
most probable partition; a query visits its most probable partitions, as many as held-out queries of the
sample needed, and all rows there are ranked by exact distance.

Rows and queries meet in tiles: a partition's rows are cut into chunks of bounded size by a hash, its
queries too, and a tile is one chunk of each. So a partition may hold any share of the rows, and
a third of them may be one and the same vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import map_batches

SAMPLE = 16_384  # vectors that partitions and classifier are fitted on, at most
HELD_OUT = 512  # further vectors on which the number of visits is settled, at most
PART_ROWS = 4096  # rows a partition is meant for
MAX_PARTS = 512  # outputs of the classifier; beyond PART_ROWS * MAX_PARTS rows partitions grow, and are cut into tiles
LEAST_PARTS = 8  # where there are FEW rows or more
FEW = 256
NEIGHBOURS = 10
RECALL = 0.95  # share of held-out neighbours that the visits must cover
TILE = 8192  # rows and queries of a tile
BLOCK = 1 << 21  # distances computed at a time in a tile
FIT_BLOCK = 1 << 19  # and where partitions are fitted, on the driver


# --- learning the partitions -------------------------------------------------------------------


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, skip_first: bool = False) -> np.ndarray:
    """Indices of the k nearest rows of each query; with ``skip_first`` query i is row i and left out."""
    out = []
    norms = (rows**2).sum(1)
    step = max(1, FIT_BLOCK // max(1, len(rows)))
    for a in range(0, len(queries), step):
        d = norms - 2 * queries[a : a + step] @ rows.T
        if skip_first:
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k].copy())
    return np.concatenate(out)


def halves(x: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A first balanced partition: the widest direction is cut so that both sides suit their number of parts."""
    label = np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        at, first, n = todo.pop()
        if n == 1 or len(at) < 2:
            label[at] = first
            continue
        centred = x[at] - x[at].mean(0)
        v = rng.normal(size=x.shape[1])
        for _ in range(8):
            v = centred.T @ (centred @ v)
            v /= np.linalg.norm(v) or 1.0
        order = np.argsort(centred @ v, kind="stable")
        left = n // 2
        cut = len(at) * left // n
        todo += [(at[order[:cut]], first, left), (at[order[cut:]], first + left, n - left)]
    return label


def balance(graph: np.ndarray, label: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Moves vertices to the part that most of their neighbours are in, while no part exceeds its share by a tenth."""
    n = len(label)
    room = int(np.ceil(1.1 * n / parts))
    links = np.concatenate([np.column_stack([np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)])])
    links = np.concatenate([links, links[:, ::-1]])
    label = label.copy()
    for _ in range(rounds):
        votes = np.zeros((n, parts), dtype=np.int32)
        np.add.at(votes, (links[:, 0], label[links[:, 1]]), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[want[v]] < room:
                size[label[v]] -= 1
                size[want[v]] += 1
                label[v] = want[v]
                moved += 1
        if moved < n // 200:
            break
    return label


@dataclass(frozen=True)
class Router:
    """A softmax classifier over partitions, and how many of them a query visits."""

    centre: np.ndarray
    scale: float
    weights: np.ndarray
    bias: np.ndarray
    visits: int

    @property
    def parts(self) -> int:
        return len(self.bias)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.scale @ self.weights + self.bias


def train(x: np.ndarray, label: np.ndarray, parts: int, steps: int = 200) -> Router:
    """Softmax regression by gradient descent with momentum scaling (Adam), from zero weights."""
    centre, scale = x.mean(0), float(x.std()) or 1.0
    z = (x - centre) / scale
    hot = np.eye(parts)[label]
    params = [np.zeros((x.shape[1], parts)), np.zeros(parts)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        s = z @ params[0] + params[1]
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - hot) / len(x)
        for i, grad in enumerate((z.T @ g + 1e-4 * params[0], g.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad**2
            params[i] = params[i] - 0.05 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-9)
    return Router(centre, scale, params[0], params[1], parts)


def learn(sample: np.ndarray, held_out: np.ndarray, parts: int, k: int, recall: float) -> Router:
    """Partitions of the sample's neighbour graph, the classifier, and the visits that held-out queries need.

    Held-out neighbours are looked for in the sample, where they are farther off than among all rows,
    so their partitions are harder to guess: the visits are on the safe side.
    """
    if parts < 2 or len(sample) <= 2 * parts:
        d = sample.shape[1] if sample.ndim == 2 else 0
        return Router(np.zeros(d), 1.0, np.zeros((d, 1)), np.zeros(1), 1)
    rng = np.random.default_rng(0)
    graph = nearest(sample, sample, min(NEIGHBOURS, len(sample) - 1), skip_first=True)
    router = train(sample, balance(graph, halves(sample, parts, rng), parts), parts)
    place = router.scores(sample).argmax(1)
    if not len(held_out):
        return router
    true = place[nearest(held_out, sample, min(k, len(sample)))]
    order = np.argsort(-router.scores(held_out), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    needed = np.take_along_axis(rank, true, axis=1) + 1
    covered = [(needed <= n).mean() for n in range(1, parts + 1)]
    visits = next(n for n, c in enumerate(covered, 1) if c >= recall or n == parts)
    return Router(router.centre, router.scale, router.weights, router.bias, visits)


# --- search ------------------------------------------------------------------------------------


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (id, v) that can take part: an id, and a vector of finite numbers that is not zero."""
    v = F.col(vector).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    picked = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    return picked.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def rank_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of each query of a tile, by exact distance, then id; a row of the query's id is left out."""
    norms = (x**2).sum(1)
    found: list[tuple[int, int, float]] = []
    step = max(1, BLOCK // max(1, len(x)))
    with np.errstate(over="ignore", invalid="ignore"):
        for a in range(0, len(q), step):
            squares = norms - 2 * q[a : a + step] @ x.T
            for i, row in enumerate(squares, a):
                row[ids == q_ids[i]] = np.inf
                near = np.arange(len(row))
                if len(row) > k and not np.isnan(row).any():
                    # What rounding may have confused is kept, and so are all ties.
                    slack = 1e-9 * (float(norms.max()) + float(q[i] @ q[i]))
                    near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + slack)
                near = near[ids[near] != q_ids[i]]
                diff = x[near] - q[i]
                exact = np.sqrt((diff**2).sum(1))
                if not np.isfinite(exact).all():  # squares beyond the range of doubles
                    top = np.abs(diff).max(1)
                    exact = np.where(np.isfinite(exact), exact, top * np.sqrt(((diff / np.where(top, top, 1)[:, None]) ** 2).sum(1)))
                best = np.lexsort((ids[near], exact))[:k]
                found += zip([int(q_ids[i])] * len(best), ids[near][best].tolist(), exact[best].tolist(), strict=True)
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def search(
    vectors: DataFrame, queries, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
    sample: int = SAMPLE, part_rows: int = PART_ROWS, recall: float = RECALL, tile: int = TILE,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of every row that ``queries`` (a condition on ``id``) selects.

    Candidates are all rows but the query's own; nearest first by Euclidean distance on the original
    vectors in double precision, ties to the smaller id; fewer than k candidates are all returned.
    Rows without an id, and vectors that are null, zero, or hold null or non-finite numbers, take no
    part; neither do vectors of another length than the most frequent one. Rows that repeat an id are
    one item, as near as the nearest of them. Partitions and classifier are fitted on at most
    ``sample`` rows, chosen by the hash of their id; the index and the ranking cover every row.
    """
    rows = usable(vectors, vec_id, vector)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if most is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, n = most["d"], most["n"]
    rows = rows.where(F.size("v") == dim)

    parts = int(min(MAX_PARTS, max(n // part_rows, LEAST_PARTS if n >= FEW else 1)))
    held_out = min(HELD_OUT, n // 5)
    if parts > 1:
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample + held_out).select("v").toPandas()["v"]
        x = np.stack(drawn.to_numpy())
        router = learn(np.unique(x[held_out:], axis=0), x[:held_out], parts, k, recall)
    else:
        router = learn(np.zeros((0, dim)), np.zeros((0, dim)), 1, k, recall)
    shared = vectors.sparkSession.sparkContext.broadcast(router)  # parts x dimensions

    def place():
        def each(batch):
            v = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            yield {"id": batch.column(0), "v": batch.column(1), "part": shared.value.scores(v).argmax(1)}

        return each

    index = map_batches(rows, "id long, v array<double>, part int", place)
    held_by = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.array([held_by.get(p, 0) for p in range(router.parts)])

    def route():
        def each(batch):
            v = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            order = np.argsort(-shared.value.scores(v), axis=1, kind="stable")
            # As many as learned, and on until there are k rows besides the query.
            enough = (np.cumsum(counts[order], axis=1) <= k).sum(1) + 1
            visits = np.minimum(np.maximum(shared.value.visits, enough), len(counts))
            who = np.repeat(np.arange(len(v)), visits)
            part = np.concatenate([o[:m] for o, m in zip(order, visits, strict=True)]) if len(v) else np.zeros(0, int)
            yield {"id": batch.column(0).take(_arrow(who)), "v": batch.column(1).take(_arrow(who)), "part": part}

        return each

    asked = map_batches(rows.where(queries(F.col("id"))), "id long, v array<double>, part int", route)
    asked_of = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}

    def chunks(by: dict):
        return F.get(F.array(*[F.lit(max(1, -(-by.get(p, 0) // tile))) for p in range(router.parts)]), F.col("part"))

    own = lambda by: F.pmod(F.xxhash64("id"), chunks(by)).cast("int")
    every = lambda by: F.explode(F.sequence(F.lit(0), chunks(by) - 1))
    index = index.where(F.col("part").isin([p for p in asked_of]))
    tiles = index.select("part", own(held_by).alias("i"), every(asked_of).alias("j"), F.lit(False).alias("asks"), "id", "v").unionByName(
        asked.select("part", every(held_by).alias("i"), own(asked_of).alias("j"), F.lit(True).alias("asks"), "id", "v")
    )

    def rank(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        v = np.stack(group["v"].to_numpy())
        ids = group["id"].to_numpy()
        return rank_tile(ids[asks], v[asks], ids[~asks], v[~asks], k)

    near = tiles.groupBy("part", "i", "j").applyInPandas(rank, "query_id long, vec_id long, score double")
    # A query gets k rows from each tile it is in.
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _arrow(indices: np.ndarray) -> pa.Array:
    return pa.array(indices, type=pa.int64())
