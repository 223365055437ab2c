"""The near-duplicate stage against exact five-word Jaccard similarities of all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tabloom.llm import similar
from tests.conftest import SF

WORDS = [f"w{i}" for i in range(2000)]


def plain_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(docs, least=0.8):
    """Smallest id of each group linked by pairs of at least this similarity."""
    sets = {i: plain_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if not (sets[a] or sets[b]) or both >= least * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted({top(i) for i in ids})


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_name = dict(corpus_pipeline.STAGES)
    out = by_name.get("near_duplicates", by_name.get("simhash"))(spark, docs, SF)
    assert out.columns == ["doc_id", "text"]
    return out.collect()


def edited(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        out[draw.randrange(len(out))] = draw.choice(WORDS)
    return out


def test_edited_copies_are_one_group(spark):
    draw = random.Random(3)
    rows = []
    for _ in range(30):
        base = [draw.choice(WORDS) for _ in range(draw.randrange(60, 400))]
        for edits in (0, len(base) // 60, len(base) // 45, len(base) // 20):
            rows.append((len(rows), " ".join(edited(draw, base, edits))))
    rows += [(1000, ""), (1001, "  \n"), (1002, "one two"), (1003, "One  TWO"), (1004, "one three")]
    want = plain_kept(rows)
    assert 40 < len(want) < 100
    assert sorted(r.doc_id for r in stage(spark, rows)) == want


def test_rows_of_one_id_and_without_one(spark):
    text = " ".join(WORDS[:50])
    got = stage(spark, [(7, text), (7, "another text"), (9, text), (None, text), (None, "alone"), (7, "another text")])
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("7", text), ("7", "another text"), ("None", "alone")])


def test_equal_fingerprints_link_below_the_similarity(spark):
    def text(words):
        return "one two three four five " * 50 + " ".join(words)

    rows = [(1, text(WORDS[:30])), (2, text(WORDS[30:60])), (3, " ".join(WORDS[100:160]))]
    assert plain_kept(rows) == [1, 2, 3]
    assert sorted(r.doc_id for r in stage(spark, rows)) == [1, 3]


def loose_copies(n=160, words=130, edits=2):
    """Copies of one text most of which are less alike than 0.8, though they share bands."""
    draw = random.Random(5)
    base = [draw.choice(WORDS) for _ in range(words)]
    rows = [(i, " ".join(edited(draw, base, edits))) for i in range(n)]
    return [*rows, (n, rows[3][1]), (n + 1, " ".join(WORDS[:80]))]


@pytest.mark.parametrize("settings", [{}, {"unit_shingles": 3000}])
def test_loose_copies_meet_in_units_not_as_pairs(spark, monkeypatch, settings):
    rows, pairs = loose_copies(), []
    alike = similar._alike
    monkeypatch.setattr(similar, "_alike", lambda met, *rest: pairs.append(met.count()) or alike(met, *rest))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar.drop_similar(docs, **settings)
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)
    # Each text meets the first of its buckets. All pairs that share a band are several times as many.
    sets = {similar.shingles(t.encode()).tobytes(): similar.band_keys(similar.shingles(t.encode())) for _, t in rows}
    bands = np.array(list(sets.values()))
    together = sum(int((bands[k + 1 :] == bands[k]).any(axis=1).sum()) for k in range(len(bands)))
    assert sum(pairs) < together / 2


def test_unit_links_connect_what_is_alike():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 40, 60)
    sets = sorted((np.unique(np.concatenate([base[draw.random(60) < 0.9], draw.integers(0, 1 << 40, 3)])) for _ in range(80)), key=len)
    n, values = np.array([len(s) for s in sets]), np.concatenate(sets)
    label, own = np.arange(80) // 2, np.zeros(80, dtype=int)
    jaccard = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets]

    def groups(x, y, given):
        root = given.copy()
        for a, b in zip(x, y, strict=True):
            root[root == root[b]] = root[a]
        return {frozenset(np.flatnonzero(root == r).tolist()) for r in root}

    for chunk in (own, np.arange(80) % 3 % 2):
        met = [(a, b) for a in range(80) for b in range(a) if jaccard[a][b] >= 0.8 and (chunk is own or chunk[a] != chunk[b])]
        x, y = similar.unit_links(label, chunk, n, values, 0.8)
        assert all(jaccard[a][b] >= 0.8 and label[a] != label[b] for a, b in zip(x, y, strict=True))
        assert len(x) == len(groups([], [], label)) - len(groups(x, y, label))  # a spanning forest
        assert groups(x, y, label) == groups(*zip(*met, strict=True), label) != groups([], [], label)
