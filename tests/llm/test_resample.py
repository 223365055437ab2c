"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tabloom.llm import resample
from tabloom.llm.registered import op11_resample
from tests.conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, max_run=1):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    return words, [" ".join(words[i : i + n]) for n in range(1, max_run + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, min_words=20, buckets=10_000, max_run=1):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in features(text, max_run)[1]:
            s[place(f)] += 1
    for text in target:
        for f in features(text, max_run)[1]:
            t[place(f)] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for doc_id, text in docs:
        words, found = features(text, max_run)
        weight = sum(gain[place(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(words)])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted([tuple(r[:5]) for r in rows], key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()], key=str)


def test_query_on_the_whole_table(spark, table):
    docs = [tuple(r) for r in table("documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in table("benchmark").collect()]
    assert got(op11_resample(spark, SF)) == brute(docs, target)


@pytest.mark.parametrize("max_run", [1, 3])
def test_odd_rows(spark, nasty, max_run):
    docs = [tuple(r) for r in nasty.select("doc_id", "text").collect()]
    target = spark.createDataFrame([("Line of some length",), (None,), ("",), ("é漢 ß same text",)], "text string")
    out = resample.resample(nasty, target, percent=50, min_words=2, max_run=max_run, buckets=50, run_rows=4)
    assert got(out) == brute(docs, [r["text"] for r in target.collect()], 50, 2, 50, max_run)
    assert len([r for r in got(out) if r[4]]) > 2


def test_empty_tables(spark, nasty, empty):
    assert resample.resample(empty, nasty, run_rows=4).count() == 0
    out = resample.resample(nasty, empty, percent=100, min_words=1)
    assert got(out) == brute([tuple(r) for r in nasty.select("doc_id", "text").collect()], [], 100, 1)


def test_kept_columns_with_clashing_names(spark, nasty):
    docs = nasty.withColumnsRenamed({"h1": "row", "lang": "segment", "size": "n_words"})
    out = resample.resample(docs, nasty, percent=100, min_words=1, keep=("text", "row", "segment", "n_words"), run_rows=3)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank", "text", "row", "segment", "n_words"]
    assert out.where("row = 1 and n_words = 7").count() == nasty.count()
    assert out.where("rank is not null and text is null").count() == 0
    with pytest.raises(ValueError):
        resample.resample(nasty.withColumn("rank", F.lit(1)), nasty, keep=("rank",))


def test_blocks_of_a_long_text_are_one_text(monkeypatch):
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("abé漢9Z") for _ in range(rnd.randrange(1, 9))) for _ in range(500))
    for block in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(resample, "BLOCK_BYTES", block)
        for max_run in (1, 2, 3):
            made = sorted(int(b) for part in resample.buckets_of(text.encode(), max_run) for b in part)
            assert made == sorted(zlib.crc32(f.encode()) % 10_000 for f in features(text, max_run)[1])


def test_ranks_where_a_third_of_the_rows_is_one_key(spark):
    rnd = random.Random(3)
    keys = [(rnd.randrange(40), rnd.choice([None, *range(20)]), rnd.randrange(3)) for _ in range(4000)] + [(17, None, 1)] * 2000
    rnd.shuffle(keys)
    rows = spark.createDataFrame(keys, "score long, doc_id long, n_features long").repartition(7)
    want = sorted(keys, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    for drawn in (0, 1, 2500, 6000):
        out = resample.ranked(rows, drawn, run_rows=200).collect()
        assert len(out) == 6000
        chosen = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
        assert [r["rank"] for r in chosen] == list(range(1, drawn + 1))
        assert [(r["score"], r["doc_id"], r["n_features"]) for r in chosen] == want[:drawn]
