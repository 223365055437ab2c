"""SimHash groups and shared lines against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tabloom.llm import graph, line_dedup, simhash
from tabloom.llm.registered import op3_simhash, op9_line_dedup
from tests.conftest import SF

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "").translate(LOWER) + " ":
        if c in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, most=4):
    """Component of each (doc_id, fingerprint), comparing all."""
    parent = {f: f for _, f in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= most:
                parent[top(a)] = top(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return sorted((str(d), f"{f:016x}", str(least.get(top(f)))) for d, f in prints)


def found(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_whole_table(spark, table):
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in table("documents").collect()]
    assert found(op3_simhash(spark, SF)) == plain_groups(prints)


def test_odd_rows(nasty, empty):
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in nasty.collect()]
    assert found(simhash.near_duplicates(nasty)) == plain_groups(prints)
    assert simhash.near_duplicates(empty).collect() == []
    left = simhash.drop_near_duplicates(nasty)
    assert left.columns == nasty.columns
    assert simhash.drop_near_duplicates(empty).collect() == []


@pytest.mark.parametrize(("blocks", "unit_rows", "seed"), [(3, 1 << 15, 0), (3, 40, 1), (2, 1 << 15, 2), (3, 7, 3)])
def test_anchors_lose_no_link(spark, blocks, unit_rows, seed):
    rnd = random.Random(seed)
    near = [rnd.getrandbits(64) for _ in range(40)]
    for _ in range(260):  # chains of near fingerprints
        f = rnd.choice(near)
        for b in rnd.sample(range(64), rnd.randrange(1, 6)):
            f ^= 1 << b
        near.append(f)
    near = sorted(set(near))
    signed = [f - (1 << 64) if f >> 63 else f for f in near]
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long")
    edges = simhash.links(nodes, blocks, 4, unit_rows).collect()
    assert all((near[r.a] ^ near[r.b]).bit_count() <= 40 for r in edges)
    named = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    got = sorted((str(i), f"{f:016x}", str(named.get(i, i))) for i, f in enumerate(near))
    assert got == plain_groups(list(enumerate(near)))


def test_every_value_has_one_home_in_radius_and_all_visits():
    rnd = random.Random(4)
    fp = np.array([rnd.getrandbits(64) for _ in range(50)], dtype=np.uint64)
    cell, who, home = simhash.visits(fp)
    assert sorted(who[home].tolist()) == sorted(list(range(50)) * 3)
    code = {v for v in range(1 << 15) if simhash.syndrome(np.array([v]))[0] == 0}
    assert len(code) == 1 << 11
    for c, w in zip(cell.tolist(), who.tolist(), strict=True):
        block, anchor = c >> 56, c & ((1 << 56) - 1)
        first, width = simhash.block_bounds()[block]
        assert anchor & 0x7FFF in code
        assert ((int(fp[w]) >> first & ((1 << width) - 1)) ^ anchor).bit_count() <= 2


def test_a_group_gives_a_forest_not_all_pairs():
    n = 500
    fp = np.array([1 << (i % 64) | 1 << (i * 7 % 64) for i in range(n)], dtype=np.uint64)
    a, b = simhash.link_units(np.zeros(n), fp, np.arange(n), np.ones(n, dtype=bool), 4)
    assert len(a) == n - 1 and set(b.tolist()) == {0}


def test_components_of_chains(spark):
    rnd = random.Random(6)
    names = rnd.sample(range(1000), 200)
    edges = [(names[i], names[i + 1]) for i in range(199) if i % 50 != 49] + [(5000, 5000), (None, 1), (6001, 6000)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {names[i]: min(names[i // 50 * 50 : i // 50 * 50 + 50]) for i in range(200)} | {6000: 6000, 6001: 6000}
    assert got == want


def plain_lines(rows, least=10, docs=2):
    """(doc_id, lines, dropped, text left) of each row."""
    key = lambda x: x.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= least:
                holders[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if d is None or len(holders[key(x)]) < docs or min(holders[key(x)]) == d]
        out.append((str(d), len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


def test_lines_of_the_table(spark, table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    want = sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in plain_lines(rows))
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in op9_line_dedup(spark, SF).collect()) == want
    assert any(k for _, _, k, _ in want)


@pytest.mark.parametrize("docs", [2, 3])
def test_lines_of_odd_rows(nasty, empty, docs):
    out = line_dedup.dedup_lines(nasty, min_docs=docs, counts=("n_before", "n_gone"))
    got = sorted((str(r.doc_id), r.n_before, r.n_gone, r.text) for r in out.collect())
    assert got == plain_lines([(r.doc_id, r.text) for r in nasty.collect()], docs=docs)
    assert line_dedup.dedup_lines(empty).collect() == []
    assert line_dedup.dedup_lines(nasty).columns == nasty.columns


def test_rows_without_an_id_link_and_bridge(spark):
    words = [f"w{i}" for i in range(400)]
    texts, seen = [], set()
    for i in range(60):  # one word more is changed each time, so that fingerprints drift
        words[(i * 37) % 400] = f"x{i}"
        texts.append(" ".join(words))
        seen.add(plain_fingerprint(texts[-1]))
    assert len(seen) > 3
    rows = [(i if i % 3 == 0 else None, t) for i, t in enumerate(texts)] + [(None, "only here"), (None, "and here too, far from it"), (7, None)]
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert found(simhash.near_duplicates(df)) == plain_groups(prints)


def test_lines_of_rows_that_repeat_an_id_with_other_texts(spark):
    rows = [
        (1, "shared line of text"), (2, "shared line of text\nx"), (2, "unique keepable line\ny"), (2, "unique keepable line\ny"),
        (2, None), (None, "shared line of text"), (3, "y\nUnique keepable LINE \nz"),
    ]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out = line_dedup.dedup_lines(df, counts=("n_before", "n_gone"))
        assert sorted((str(r.doc_id), r.n_before, r.n_gone, r.text) for r in out.collect()) == plain_lines(rows)


def test_time_of_a_text_of_many_lines_grows_with_it(spark):
    import time

    def seconds(n):
        rows = [(1, "a line that two share"), (2, "a line that two share\n" + "\n".join(f"own line number {i}" for i in range(n)))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        began = time.time()
        assert sum(r.text.count("\n") for r in line_dedup.dedup_lines(df).collect()) == n - 1
        return time.time() - began

    seconds(1000)
    assert seconds(200_000) < 20 * seconds(20_000)
