"""Exact top-k search by inner product with an M-tree.

Vectors become integers. With the largest squared length M of all, a further component
sqrt(M - |x|^2) turns the largest inner product into the smallest Euclidean distance, whose square is
|q|^2 + M - 2 q.x, so a metric tree finds it exactly. The tree is paged: a node is a row with its
routing objects, their covering radii and their distances to the routing object above. Its top level
are regions around pivots from a bounded sample; a region's rows are cut into subtrees of bounded size
by a hash, each built by one task.

A query first searches one subtree of the region that it lies in, best node first. Its k-th score there
bounds the rest: it goes on only to the regions whose covering radius reaches inside that bound, and
in a node only to the entries that the stored distances do not rule out, which saves computing theirs.
Queries and subtrees meet in tiles, a block of queries and a subtree each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import map_batches
from tabloom.operators.ordering import broadcast_if_small
from tabloom.session import scratch_path

PIVOTS = 256  # regions of the top level, at most
REGION_ROWS = 2048  # rows a region is meant for
SUBTREE_ROWS = 16_384  # rows of a subtree, about
QUERY_BLOCK = 32_768  # queries of a tile, about
LEAF = 128  # rows of a leaf page
FANOUT = 32  # entries of an inner page
ROOM = 1 << 60  # squared lengths stay below, so that no sum leaves 64 bits
EXACT = 1 << 52  # whole numbers up to here are exact in doubles
SLACK = 1e-9  # error granted to distances, as a share of the largest
LAST = np.iinfo(np.int64).max  # stands for a missing id, which comes last among equal scores

PAGE = (
    "region int, chunk int, page int, child array<int>, rows array<long>, ids array<long>, vectors binary, "
    "to_parent array<double>, radius array<double>, router binary"
)


def integers(vectors: DataFrame, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (id, v, size): every component x as floor(scale * x) and the squared length, of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float(1 << 31)))
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("int"))
    square = F.aggregate(F.col("v"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.when(fits, whole).alias("v")).where(F.col("v").isNotNull())
    exact = F.aggregate(F.col("v"), F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    return rows.where(square < float(ROOM)).select("id", "v", exact.alias("size"))


# --- distances, pages and the search in them ---------------------------------------------------


class Space:
    """Integer vectors with their lift, the component that gives all of them one length."""

    def __init__(self, v: np.ndarray, top: int):
        self.v = v.astype(np.float64)
        self.size = (v.astype(np.int64) ** 2).sum(1)
        self.lift = np.sqrt((top - self.size).astype(np.float64))
        self.exact = 4 * int(self.size.max(initial=0)) < EXACT

    def between(self, at: np.ndarray, i: int) -> np.ndarray:
        """Distances of the rows ``at`` to row i."""
        if self.exact:
            flat = (self.size[at] + self.size[i]) - 2 * (self.v[at] @ self.v[i])
        else:
            flat = ((self.v[at] - self.v[i]) ** 2).sum(1)
        return np.sqrt(flat + (self.lift[at] - self.lift[i]) ** 2)


def pages(space: Space, leaf: int = LEAF, fanout: int = FANOUT) -> Iterator[dict]:
    """Nodes of one tree. An entry stands for a child page or, in a leaf (``child`` is None), for a row.

    ``to_parent`` is an entry's distance to the row that routes its page, ``radius`` covers all rows
    below it. Row 0 routes page 0.
    """
    todo = [(np.arange(len(space.v)), 0, 0)]  # rows, page, routing row
    made = 1
    while todo:
        at, page, router = todo.pop()
        to_router = space.between(at, router)
        if len(at) <= leaf:
            yield {"page": page, "child": None, "entry": at, "to_parent": to_router, "radius": np.zeros(len(at))}
            continue
        # Routing rows lie regularly in the order of distance, so that near and far ones are among them.
        n = min(fanout, 2 * -(-len(at) // leaf))
        chosen = np.argsort(to_router, kind="stable")[np.arange(n) * len(at) // n]
        away = np.stack([space.between(at, at[c]) for c in chosen])
        own = away.argmin(0)
        if np.bincount(own).max() == len(at):  # all alike: cut by number
            own = np.arange(len(at)) * n // len(at)
        held = [i for i in range(n) if (own == i).any()]
        child = np.arange(made, made + len(held))
        made += len(held)
        for i, c in zip(held, child.tolist(), strict=True):
            todo.append((at[own == i], c, int(at[chosen[i]])))
        radius = np.array([away[i][own == i].max() for i in held])
        yield {"page": page, "child": child, "entry": at[chosen[held]], "to_parent": to_router[chosen[held]], "radius": radius}


class Tree:
    """Pages read back."""

    def __init__(self, nodes: pd.DataFrame, top: int):
        self.top = top
        self.nodes, self.largest = {}, 0
        for r in nodes.itertuples(index=False):
            v = np.frombuffer(r.vectors, dtype="<i4").reshape(len(r.ids), -1)
            self.largest = max(self.largest, int(np.abs(v.astype(np.int64)).max(initial=0)))
            child = None if r.child is None else np.asarray(r.child)
            self.nodes[r.page] = (v, v.astype(np.float64), np.asarray(r.to_parent), np.asarray(r.radius), child, np.asarray(r.rows), np.asarray(r.ids))
            if r.page == 0:
                self.router = np.frombuffer(r.router, dtype="<i4")

    def search(self, q: np.ndarray, row: int, k: int, least: int | None = None) -> tuple[list[tuple[int, int, int]], int]:
        """The k best (score, id, row) of all rows but ``row`` that score ``least`` or more, ids breaking ties;
        and the number of products that were computed."""
        q = q.astype(np.int64)
        length, flat = int((q * q).sum()), q.astype(np.float64)
        exact = self.largest * int(np.abs(q).max(initial=0)) * max(1, len(q)) < EXACT
        slack = SLACK * (np.sqrt(float(self.top)) + np.sqrt(float(length)) + 1)

        def products(some: np.ndarray, same: np.ndarray) -> np.ndarray:
            return (same @ flat).astype(np.int64) if exact else (some.astype(np.int64) * q).sum(1)

        def distance(score):
            return np.sqrt(np.maximum(length + self.top - 2 * score, 0).astype(np.float64))

        best: list[tuple[int, int, int]] = []
        reach = np.inf if least is None else float(distance(np.int64(least))) + slack
        to_root = float(distance(products(self.router[None, :], self.router[None, :].astype(np.float64)))[0])
        computed = 1
        heap = [(0.0, 0, to_root)]
        while heap and heap[0][0] <= reach:
            _, page, to_router = heapq.heappop(heap)
            v, same, to_parent, radius, child, rows, ids = self.nodes[page]
            near = np.flatnonzero(np.abs(to_router - to_parent) - radius <= reach)
            if not len(near):
                continue
            computed += len(near)
            score = products(v, same) if len(near) == len(v) else products(v[near], same[near])
            if child is not None:
                away = distance(score)
                low = np.maximum(away - radius[near], 0)
                for i in np.flatnonzero(low <= reach).tolist():
                    heapq.heappush(heap, (float(low[i]), int(child[near[i]]), float(away[i])))
                continue
            good = rows[near] != row
            if least is not None:
                good &= score >= least
            at = np.flatnonzero(good)
            if len(at) > k:  # the k best of this page and what ties with them
                at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
            if len(at):
                made = zip(score[at].tolist(), ids[near[at]].tolist(), rows[near[at]].tolist(), strict=True)
                best = heapq.nsmallest(k, [*best, *made], key=lambda b: (-b[0], b[1], b[2]))
                if len(best) == k:
                    least = best[-1][0]
                    reach = float(distance(np.int64(least))) + slack
        return best, computed


def build(rows: np.ndarray, ids: np.ndarray, v: np.ndarray, top: int, leaf: int = LEAF, fanout: int = FANOUT) -> pd.DataFrame:
    """The pages of one subtree as a table."""
    out = []
    for p in pages(Space(v, top), leaf, fanout):
        at = p.pop("entry")
        first = v[0].astype("<i4").tobytes() if p["page"] == 0 else None
        out.append(p | {"rows": rows[at], "ids": ids[at], "vectors": v[at].astype("<i4").tobytes(), "router": first})
    return pd.DataFrame(out)


# --- on Spark ----------------------------------------------------------------------------------


class Pivots:
    """Routing objects of the top level, for vectors of the most frequent length; other lengths are a region each."""

    def __init__(self, v: np.ndarray, dim: int, top: int):
        self.v, self.dim, self.top = v.astype(np.float64), dim, top
        self.size = (v.astype(np.int64) ** 2).sum(1).astype(np.float64)
        self.lift = np.sqrt(np.maximum(top - self.size, 0))

    def away(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances of vectors to all pivots; queries have no lift."""
        x = x.astype(np.float64)
        size = (x * x).sum(1)
        lift = np.sqrt(np.maximum(self.top - size, 0)) if lifted else np.zeros(len(x))
        flat = np.maximum(size[:, None] + self.size - 2 * x @ self.v.T, 0)
        return np.sqrt(flat + (lift[:, None] - self.lift) ** 2)

    @property
    def slack(self) -> float:
        """The products above lose up to the root of a double's precision where two vectors are close."""
        return 1e-6 * (np.sqrt(float(self.top)) + 1)


def _vectors(column: pa.Array, where: np.ndarray, dim: int) -> np.ndarray:
    return column.filter(pa.array(where)).flatten().to_numpy().reshape(-1, dim)


def search(
    vectors: DataFrame, queries, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS,
    region_rows: int = REGION_ROWS, subtree_rows: int = SUBTREE_ROWS, query_block: int = QUERY_BLOCK, leaf: int = LEAF, fanout: int = FANOUT,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k rows of the largest inner product with every row that ``queries`` selects.

    ``queries`` is a condition on ``id``. Components count as floor(scale * x). Candidates are all rows but
    the query's own, also those that repeat its id; ties go to the smaller id, rows without an id come last
    among equals; fewer than k candidates are all returned. Vectors that are null or hold null or non-finite
    numbers take no part, nor do those whose squared length in integers is 2^60 or more, as products would
    not fit a long. Vectors of unlike length have no inner product and do not meet. Pivots are at most
    ``pivots`` rows, chosen by a hash; every row is in the tree.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    path = scratch_path(spark, "mtree-rows")
    # Rows are told apart by a number; a negative one marks a missing id.
    number = F.monotonically_increasing_id()
    taking = integers(vectors, scale, vec_id, vector).withColumn("row", number)
    taking.withColumn("row", F.when(F.col("id").isNull(), -1 - F.col("row")).otherwise(F.col("row"))).withColumn(
        "id", F.coalesce("id", F.lit(int(LAST)))
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    top = rows.agg(F.max("size")).first()[0]
    if top is None:
        return spark.createDataFrame([], schema)
    dim, n = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    wanted = int(min(pivots, max(4, -(-n // region_rows))))
    drawn = rows.where(F.size("v") == dim).orderBy(F.xxhash64("id", "v"), "row").limit(wanted).select("v").collect()
    chosen = np.unique(np.array([r["v"] for r in drawn], dtype=np.int64).reshape(len(drawn), dim), axis=0)
    shared = spark.sparkContext.broadcast(Pivots(chosen, dim, top))  # at most ``pivots`` vectors

    def place():
        def each(batch):
            lengths = batch.column(1).value_lengths().to_numpy()
            region, away = (-1 - lengths).astype(np.int32), np.full(len(lengths), np.sqrt(float(top)))
            here = lengths == shared.value.dim
            if here.any():
                d = shared.value.away(_vectors(batch.column(1), here, shared.value.dim), lifted=True)
                region[here], away[here] = d.argmin(1), d.min(1)
            yield {"id": batch.column(0), "v": batch.column(1), "row": batch.column(2), "region": region, "away": away}

        return each

    path = scratch_path(spark, "mtree-placed")
    map_batches(rows.select("id", "v", "row"), "id long, v array<int>, row long, region int, away double", place).write.parquet(path)
    placed = spark.read.parquet(path)
    regions = placed.groupBy("region").agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / subtree_rows)).cast("int").alias("chunks"), F.max("away").alias("reach")
    )
    cut = broadcast_if_small(regions.select("region", "chunks"), regions.count())  # a row per region
    chunked = placed.join(cut, "region").withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks").cast("int"))

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        v = np.array(group["v"].tolist(), dtype=np.int64).reshape(len(group), -1)
        made = build(group["row"].to_numpy(), group["id"].to_numpy(), v, top, leaf, fanout)
        return made.assign(region=key[0], chunk=key[1])[[f.split()[0] for f in PAGE.split(", ")]]

    path = scratch_path(spark, "mtree-pages")
    chunked.select("region", "chunk", "row", "id", "v").groupBy("region", "chunk").applyInPandas(grow, PAGE).write.parquet(path)
    tree = spark.read.parquet(path)

    asking = chunked.where(queries(F.when(F.col("row") >= 0, F.col("id"))))
    blocks = max(1, -(-asking.count() // query_block))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))
    nodes = tree.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("region", "chunk", "block")
    hits_of = "row long, scores array<long>, ids array<long>, rows array<long>"

    def visit(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        searched = Tree(held, top) if len(asked) and len(held) else None
        for v, row, least in zip(asked["v"], asked["row"].tolist(), asked["least"].tolist(), strict=True) if searched else ():
            best, _ = searched.search(np.asarray(v), row, k, least)
            found.append((row, [b[0] for b in best], [b[1] for b in best], [b[2] for b in best]))
        return pd.DataFrame(found, columns=["row", "scores", "ids", "rows"])

    def tiles(asked: DataFrame) -> DataFrame:
        to = asked.select("region", "chunk", "block", "row", "v", "least").groupBy("region", "chunk", "block")
        return to.cogroup(nodes).applyInPandas(visit, hits_of)

    # Without k rows at home there is no bound: all scores are above -ROOM.
    path = scratch_path(spark, "mtree-home")
    tiles(asking.withColumn("least", F.lit(-ROOM).cast("long"))).write.parquet(path)
    home = spark.read.parquet(path)
    kth = F.coalesce(F.get("scores", F.lit(k - 1)), F.lit(-ROOM))
    bound = asking.join(home.select("row", kth.alias("least")), "row")

    reach = {r["region"]: r["reach"] for r in regions.where("region >= 0").collect()}  # at most ``pivots``
    radius = np.array([reach.get(i, -np.inf) for i in range(len(chosen))])  # of a region without rows: nothing reaches it

    def route():
        def each(batch):
            at, row, chunk, region, least = (batch.column(i) for i in range(5))
            lengths = at.value_lengths().to_numpy()
            where, to = [np.flatnonzero(lengths != shared.value.dim)], [region.to_numpy()[lengths != shared.value.dim]]
            here = np.flatnonzero(lengths == shared.value.dim)
            if len(here):
                q = _vectors(at, lengths == shared.value.dim, shared.value.dim)
                size = (q.astype(np.int64) ** 2).sum(1)
                limit = np.sqrt(np.maximum(size + top - 2 * least.to_numpy()[here], 0).astype(np.float64))
                q_i, p_i = np.nonzero(shared.value.away(q, lifted=False) - radius <= limit[:, None] + 2 * shared.value.slack)
                where, to = [*where, here[q_i]], [*to, p_i]
            who = pa.array(np.concatenate(where))
            yield {
                "region": np.concatenate(to).astype(np.int32), "row": row.take(who), "v": at.take(who), "own_region": region.take(who),
                "own_chunk": chunk.take(who), "least": least.take(who), "block": batch.column(5).take(who),
            }

        return each

    going = map_batches(
        bound.select("v", "row", "chunk", "region", "least", "block"),
        "region int, row long, v array<int>, own_region int, own_chunk int, least long, block int", route,
    )
    away = going.join(cut, "region").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    away = away.where((F.col("region") != F.col("own_region")) | (F.col("chunk") != F.col("own_chunk")))
    # A query gets at most k hits from each subtree that it visits.
    hits = home.unionByName(tiles(away)).select("row", F.inline(F.arrays_zip("scores", "ids", "rows")).alias("score", "id", "found"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id", "found")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asking.select("row", F.col("id").alias("query_id")), "row").select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("found") >= 0, F.col("id")).alias("vec_id"), "score"
    )
