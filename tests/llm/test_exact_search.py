"""The M-tree against all products."""

import numpy as np
import pytest

from tabloom.llm import mtree
from tabloom.llm.registered import op12_exact_search
from tests.conftest import SF


def brute(rows, chosen, k=10, scale=1024):
    """rows: (id, vector); every row but the query's own is a candidate."""
    made = []
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            made.append((i, [int(np.floor(x * scale)) for x in v]))
    out = []
    for n, (i, q) in enumerate(made):
        if i is not None and chosen(i):
            others = [(-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for m, (j, v) in enumerate(made) if m != n and len(v) == len(q)]
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(others)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted([(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()], key=str)


def test_query_on_the_whole_table(spark, table):
    rows = [(r["vec_id"], r["embedding"]) for r in table("embeddings").collect()]
    assert got(op12_exact_search(spark, SF)) == brute(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("small", [True, False])
def test_clusters_ties_and_hot_vectors(spark, small):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 3
    v = np.concatenate([centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) * 0.05, np.repeat(centres[:1], 150, 0)]).round(2)
    rows = [(int(i) % 400 if i % 7 else None, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    size = dict(pivots=5, region_rows=50, subtree_rows=40, query_block=10, leaf=4, fanout=3) if small else {}
    assert got(mtree.search(df, lambda i: i % 10 == 0, k=7, scale=16, **size)) == brute(rows, lambda i: i % 10 == 0, 7, 16)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-1.0, 0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]),
        (6, [1.0]), (100, [3.0]), (None, [9.0, 9.0]), (200, []), (300, []), (7, [1e300, 1.0]), (8, [2000.0, -2000.0]), (-100, [0.3, -0.2]),
    ]
    schema = "vec_id long, embedding array<double>, row int, region string, id string"
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], schema)
    want = brute([r for r in rows if r[0] != 7], lambda i: i % 100 == 0, 3)  # the one that no long can hold
    assert got(mtree.search(df, lambda i: i % 100 == 0, k=3)) == want
    assert mtree.search(df.limit(0), lambda i: i % 100 == 0).count() == 0
    assert mtree.search(df.where("vec_id = 1"), lambda i: i % 100 == 0).columns == ["query_id", "rank", "vec_id", "score"]
    assert got(mtree.search(df, lambda i: i == 55)) == []


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-(2**28), 2**28, 6).astype(float).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(mtree.search(df, lambda i: i % 5 == 0, k=4, scale=1, leaf=4, fanout=3, region_rows=10)) == brute(rows, lambda i: i % 5 == 0, 4, 1)


def test_stored_distances_save_products():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 1000
    v = np.floor(np.repeat(centres, 100, 0) + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    top = int((v * v).sum(1).max())
    tree = mtree.Tree(mtree.build(np.arange(4000), np.arange(4000), v, top, 32, 8), top)
    computed = 0
    for q in range(0, 4000, 40):
        best, n = tree.search(v[q], q, 10)
        score = v @ v[q]
        score[q] = np.iinfo(np.int64).min
        assert [b[0] for b in best] == sorted(score.tolist(), reverse=True)[:10]
        computed += n
    assert computed < 0.5 * 100 * 4000  # of all pairs; inner pages included
