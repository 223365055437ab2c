"""Quality rules, URL verdicts, mixing and nearest neighbours."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import ann, mixing, quality, urls
from tabloom.llm.registered import op4_url_filter, op5_mix_sources, op7_quality_rules, op8_nearest
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + o for at in grams.values() if len(at) > 1 for i in at for o in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(spark, table):
    docs = {r.doc_id: r.text for r in table("documents").collect()}
    rows = op7_quality_rules(spark, SF).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
    good = {r.doc_id for r in table("labels").where("quality = 1").collect()}
    lost = [r for r in rows if r.doc_id in good and not r.kept and not r.base_failed]
    assert not lost  # beyond the base rules, clean documents stay


def test_quality_of_odd_rows(spark, nasty, empty):
    more = spark.createDataFrame(
        [(100, " ".join("abcab" * 7)), (101, "a b c d e f g h i j " * 2), (102, "a b c d e x a b c d e y " * 3), (103, "w " * 5)], "doc_id long, text string"
    )
    docs = nasty.select("doc_id", "text").unionByName(more)
    q = F.col("quality")
    got = quality.judge(docs).select("text", *[q[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")])
    assert all(tuple(r)[1:] == plain_counts(r.text) for r in got.collect())
    assert quality.keep(nasty).columns == nasty.columns and quality.keep(empty).collect() == []


def test_quality_rules_are_a_table(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "one")], "doc_id long, text string")
    assert [r.doc_id for r in quality.keep(docs, (quality.Rule("n_words", "<", 2),)).collect()] == [1]
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# --- urls --------------------------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]


def plain_rule(host, path):
    fits = []
    for rule, verdict in urls.RULES:
        domain, _, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_url_verdicts(spark, table):
    pages = {r.page_id: r.url for r in table("pages").select("page_id", "url").collect()}
    rows = op4_url_filter(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.host, r.path) == plain_url(pages[r.page_id])
        rule, verdict = plain_rule(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_url_odd_rows(spark):
    given = [None, "", "nothing", "://", "http://", "HTTP://A.Example.ORG/en/12?x#y", "http://org", "http://org/", "a://b://c", "x://ORG/es/\n", "http://com/de/", "http://é.com/fr/", "http://h/" + "p/" * 5000]
    rows = [(i if i % 3 else None, u, 1, "z") for i, u in enumerate(given)] + [(1, "http://com/de/", 1, "z")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host int, u string")
    got = urls.judge_urls(pages).collect()
    want = sorted((str(r[0]), *plain_url(r[1]), str(plain_rule(*plain_url(r[1]))[0])) for r in rows)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got) == want
    assert urls.judge_urls(pages.limit(0)).collect() == []


def test_url_model_on_held_out_urls(spark, table):
    pages = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/pages.parquet")
    rows = pages.select(F.col("url").alias("u")).distinct().withColumns(urls.parts(F.col("u")))
    rows = rows.withColumn("r", urls.rule_for(F.col("host"), F.col("path"))).where("r is not null").withColumn("label", (F.col("r.verdict") == "block").cast("double"))
    test = F.pmod(F.xxhash64("u", F.lit(1)), F.lit(4)) == 0
    model = urls.fit(rows.where(~test))
    right, n, blocked = (
        model.blocks(rows.where(test)).agg(F.avg((F.col("blocked") == (F.col("label") == 1)).cast("int")), F.count("*"), F.avg("label")).first()
    )
    assert n > 10 and right >= 0.85 and right > max(blocked, 1 - blocked)


def test_rates_cover_every_labelled_url(spark):
    urls_ = [(f"http://a{i % 3}.h{i % 7000}.net/s{i % 11}/{i}", float(i % 5 == 0)) for i in range(21_000)]
    rows = spark.createDataFrame([*urls_, *urls_[:500]], "u string, label double").withColumns(urls.parts(F.col("u")))
    model = urls.fit(rows, train_rows=200, trees=1)
    got = {r["_s"]: (r["n"], r["b"]) for r in model.rates["_s"].all.collect()}
    assert len(got) == 7000 and sum(n for n, _ in got.values()) == 21_000
    assert all(n == 3 for n, _ in got.values()) and sum(b for _, b in got.values()) == sum(x for _, x in urls_)
    once = rows.limit(50).withColumn("_f", F.pmod(F.xxhash64(F.lit("fold"), "u"), F.lit(urls.FOLDS)).cast("int"))
    # Of its own fold, a row sees no count: of three URLs of a suffix at most two are left.
    assert {r[0] for r in model.features(once, own_fold=True).select("_s_n").collect()} <= {0, 1, 2}
    assert {r[0] for r in model.features(once).select("_s_n").collect()} == {3}


# --- mixing ------------------------------------------------------------------------------------


def test_mix_of_the_table(spark, table):
    docs = table("documents").collect()
    held = {}
    for r in docs:
        held[r.source] = held.get(r.source, 0) + len(WORD.findall(r.text or ""))
    weights = dict(zip(sorted(held), (3, 1, 2) * len(held), strict=False))
    target, open_ = {}, set(held)
    budget = 1.5 * sum(held.values())
    while True:
        rate = (budget - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if rate * weights[s] > 2 * held[s]}
        if not over:
            break
        target |= {s: 2.0 * held[s] for s in over}
        open_ -= over
    target |= {s: rate * weights[s] for s in open_}
    rows = op5_mix_sources(spark, SF).collect()
    source = {r.doc_id: r.source for r in docs}
    taken = dict.fromkeys(held, 0)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == held[s] and math.isclose(r.target, target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert len(rows) == len(docs)
    for s in held:  # as near as whole documents come
        rest, sums = target[s] - target[s] // held[s] * held[s], {0}
        for r in rows:
            if source[r.doc_id] == s and rest:
                sums |= {x + r.size for x in sums}
        assert abs(taken[s] - target[s]) <= 0.5 + min(abs(x - rest) for x in sums)
    again = op5_mix_sources(spark.newSession(), SF).repartition(3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_fit_is_the_nearest_sum():
    rnd = random.Random(7)
    for _ in range(300):
        sizes = np.array(rnd.sample(range(1, 30), rnd.randrange(1, 6)))
        counts = np.array([rnd.randrange(0, 4) for _ in sizes])
        whole = int((sizes * counts).sum())
        budget = rnd.random() * whole
        picks = mixing.fit(sizes, counts, budget)
        assert (picks >= 0).all() and (picks <= counts).all()
        if whole:
            got = abs(float((picks * sizes).sum()) - budget)
            sums = {0}
            for s, n in zip(sizes.tolist(), counts.tolist(), strict=True):
                sums = {x + k * s for x in sums for k in range(n + 1)}
            assert got <= 0.5 + min(abs(x - budget) for x in sums)


def test_fit_of_large_documents():
    assert mixing.fit(np.array([10**6]), np.array([3]), 1.9e6).tolist() == [2]
    assert mixing.fit(np.array([10**6]), np.array([3]), 1.4e6).tolist() == [1]
    assert mixing.fit(np.array([5, 10**6]), np.array([10, 9]), 4.3e6 + 25).sum() > 0
    assert mixing.fit(np.array([3]), np.array([0]), 5.0).tolist() == [0]


def test_mix_odd_rows(spark, nasty, empty):
    rows = mixing.mix(nasty).collect()
    assert len(rows) == nasty.count()
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(r.doc_id), len(WORD.findall(r.text or ""))) for r in nasty.collect())
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.times * r.size for r in rows)
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert sum(r.size for r in mine) == mine[0].source_size
    table = mixing.take(nasty)
    assert table.columns == nasty.columns
    assert table.count() == sum(r.times for r in rows)
    assert mixing.mix(empty).collect() == [] and mixing.take(empty).collect() == []


def test_take_repeats_documents(spark, table):
    docs = table("documents")
    plan = {r.doc_id: r.times for r in mixing.mix(docs).collect()}
    got = {r.doc_id: r.n for r in mixing.take(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {d: n for d, n in plan.items() if n}
    assert set(plan.values()) >= {1, 2}


# --- nearest neighbours ------------------------------------------------------------------------


def brute(ids, x, picks, k=10):
    out = {}
    for i in np.flatnonzero(picks):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [v for v, _ in got[q]] == [v for v, _ in rows]
        assert np.allclose([s for _, s in got[q]], [s for _, s in rows], rtol=1e-12, atol=1e-12)


def test_whole_table_recall(spark, table):
    rows = table("embeddings").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    same(answers(op8_nearest(spark, SF)), brute(ids, x, ids % 100 == 0))  # one partition at this size


def test_partitions_reach_their_recall(spark):
    rows = spark.read.parquet(SF.replace("sf0.001", "sf0.1") + "/embeddings.parquet").select("vec_id", "embedding")
    got = answers(ann.search(rows, lambda i: i % 50 == 0, part_rows=400, sample=3000, tile=300))
    local = rows.collect()
    ids, x = np.array([r.vec_id for r in local]), np.array([r.embedding for r in local], dtype=np.float64)
    want = brute(ids, x, ids % 50 == 0)
    assert got.keys() == want.keys()
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9, recall


def test_partitions_are_balanced_and_keep_neighbours():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(200, 8)) + 8 * rng.normal(size=8) for _ in range(6)])
    graph = ann.nearest(x, x, 8, skip_first=True)
    label = ann.balance(graph, ann.halves(x, 6, rng), 6)
    assert np.bincount(label, minlength=6).max() <= 1.1 * 200 + 1
    assert (label[graph] == label[:, None]).mean() > 0.8


@pytest.mark.parametrize("part_rows", [10_000, 20])
def test_odd_vectors(spark, part_rows):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1), rnd.gauss(0, 1)]) for i in range(60)] + [(i, [1.0, 1.0]) for i in range(100, 160)]
    bad = [(200, None), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [float("nan"), 1.0]), (600, [float("inf"), 1.0]), (700, [1.0]), (None, [2.0, 2.0]), (800, [])]
    big = [(900, [1e200, 1e200]), (901, [1e200, -1e200])]
    spark_rows = spark.createDataFrame([(a, b, 1, 2) for a, b in rows + bad + big], "vec_id long, embedding array<double>, part int, id int")
    got = answers(ann.search(spark_rows, lambda i: i % 50 == 0, k=4, part_rows=part_rows, tile=25))
    assert set(got) == {0, 50, 100, 150, 900} and all(len(r) == 4 for r in got.values())
    assert [v for v, _ in got[150]] == [100, 101, 102, 103] and all(s == 0 for _, s in got[150])
    assert got[900][0][1] < 1.5e200 or math.isclose(got[900][0][1], math.sqrt(2) * 1e200)
    few = ann.search(spark_rows.where("vec_id < 3"), lambda i: i == 0, k=10)
    assert len(few.collect()) == 2
    assert ann.search(spark_rows.limit(0), lambda i: i == 0).collect() == []
