import random

import pytest
from pyspark.sql import functions as F

from tabloom.functions import tokens as K
from tabloom.operators import packing, sampling, shards, tokenize


def brute_pack(rows, max_len, size, merge, trim, tail):
    """rows: (key, ids, labels) in order; gives (batch, part, four lists)."""
    out = []
    for b in range(0, len(rows), size):
        ids, labs, ex, ps = [], [], [], []
        cur, pos, prev = -1, 0, None
        for i, (key, x, y) in enumerate(rows[b:b + size]):
            if trim and i and x[0] == K.BOS_ID:
                x, y = x[1:], y[1:]
            tid = key.split("__")[0]
            if not merge or tid != prev:
                cur, pos = cur + 1, 0
            prev = tid
            ids += x
            labs += y
            ex += [cur] * len(x)
            ps += list(range(pos, pos + len(x)))
            pos += len(x)
        for at in range(0, len(ids) if tail == "keep" else 1, max_len):
            out.append((b // size, at // max_len, *[x[at:at + max_len] for x in (ids, labs, ex, ps)]))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(130):
        n = rng.randint(1, 30)
        key = f"t{rng.randint(0, 2)}__{i:04d}"
        ids = [K.BOS_ID] + [rng.randint(0, 255) for _ in range(n)]
        cut = rng.randint(1, n)
        out.append((i, key, ids, [K.IGNORE] * cut + ids[cut:]))
    return out


@pytest.fixture(scope="module")
def toks(spark, rows):
    return spark.createDataFrame(rows, "i int, key string, input_ids array<int>, labels array<int>").repartition(5)


@pytest.mark.parametrize("merge", [True, False])
@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("max_len", [60, 7, 10_000])
@pytest.mark.parametrize("tail", ["keep", "drop"])
def test_pack_matches_plain_python(spark, toks, rows, merge, trim, max_len, tail):
    got = packing.pack(toks, [], ["i"], "key", max_len, 9, merge, trim, tail=tail).orderBy("batch", "part").collect()
    want = brute_pack([r[1:] for r in rows], max_len, 9, merge, trim, tail)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g["batch"], g["part"], g["input_ids"], g["labels"], g["example_ids"], g["position_ids"]) == tuple(w)
        flat = [s["example_id"] for s in g["spans"] for _ in range(s["len"])]
        assert flat == w[4] and [s["example_id"] for s in g["spans"]] == sorted({*w[4]})


def test_attention_blocks(spark):
    ids = [0] * 7 + [1] * 9 + [2] * 3 + [3] * 5
    df = spark.range(1).select(packing.spans_of(F.array(*[F.lit(x) for x in ids])).alias("s"))
    pairs = df.select("s", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("i")).select("s", "i", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("j"))
    for r in pairs.select("i", "j", packing.may_attend(F.col("s"), F.col("i"), F.col("j")).alias("m")).collect():
        assert r["m"] == (ids[r["i"]] == ids[r["j"]] and r["j"] <= r["i"])


@pytest.mark.parametrize("limit", ["2000000", "0"])
def test_few_shot(spark, toks, rows, limit):
    spark.conf.set("spark.tabloom.maxGroupRows", limit)
    try:
        got = packing.few_shot(toks, [], ["i"], ["key"], 4, 10_000).collect()
    finally:
        spark.conf.unset("spark.tabloom.maxGroupRows")
    assert len(got) == len(rows)
    by = {r[1]: r for r in rows}
    order = [r[1] for r in rows]
    firsts = set()
    for g in got:
        at = order.index(g["key"])
        run = order[at // 5 * 5: at // 5 * 5 + 5]
        _, _, ids, labs = by[g["key"]]
        body = ids[1:] if len(run) > 1 else ids
        assert g["input_ids"][-len(body):] == body
        assert g["labels"][-len(body):] == (labs[1:] if len(run) > 1 else labs)
        assert set(g["labels"][: -len(body)]) <= {K.IGNORE}
        assert g["input_ids"].count(K.BOS_ID) == 1
        assert len(g["input_ids"]) == 1 + sum(len(by[k][2]) - 1 for k in run)
        firsts.add(tuple(g["input_ids"][:3]))
    assert len(firsts) > len(rows) // 5


def test_byte_tokenizer(spark):
    t = tokenize.ByteTokenizer()
    sep, eoc, ch = (K.FIRST_SPECIAL_ID + i for i in (1, 0, 2))
    text = "é||a<|endinput|>b<|endcompletion|>"
    want = [K.BOS_ID, *"é".encode(), ch, 97, sep, 98, eoc]
    assert t.encode([text, "", "|"])[0].tolist() == want
    # Markers that would only form across two texts stay bytes.
    assert [x.tolist() for x in t.encode(["a|", "|b"])] == [[K.BOS_ID, 97, 124], [K.BOS_ID, 124, 98]]
    df = spark.createDataFrame([(text,), (None,), ("x" * 5000,)], "t string")
    got = [r[0] for r in df.select(tokenize.token_column(F.col("t"))).collect()]
    assert got[0] == want and got[1] == [K.BOS_ID] and len(got[2]) == 5001


class WordTokenizer:
    def encode(self, texts):
        return [[len(w) for w in t.split()] for t in texts]


def test_any_tokenizer_and_masks(spark):
    df = spark.createDataFrame([("how much is it ", " five euros")], "input_text string, target_text string")
    r = tokenize.tokenize_samples(df, WordTokenizer()).first()
    assert r["input_ids"] == [3, 4, 2, 2, 4, 5] and r["labels"] == [-100] * 4 + [4, 5]
    q = spark.createDataFrame([("Is it?", "Yes")], "text string, class_label_as_text string")
    r = tokenize.tokenize_samples(tokenize.with_markers(q)).withColumn("p", tokenize.prompt_only(F.col("input_ids"), F.col("labels"))).first()
    assert bytes(x for x in r["p"] if x < 256).decode() == "Is it?" and r["p"][-1] == K.FIRST_SPECIAL_ID + 1


def test_length_rules(spark, toks):
    assert tokenize.filter_length(toks, 12, "at_most").count() == tokenize.filter_length(toks, 12, too_long="warn").where("not too_long").count()
    assert tokenize.filter_length(toks, 12, "exact").where(F.size("input_ids") != 12).count() == 0
    assert tokenize.filter_length(toks, 12, "eval").count() < tokenize.filter_length(toks, 12, "at_most").count()


def test_interleave_repeats_short_sources(spark):
    a = spark.createDataFrame([(f"a{i}",) for i in range(3)], "n string")
    b = spark.createDataFrame([(f"b{i}",) for i in range(5)], "n string")
    got = [r["n"] for r in sampling.interleave([a, b], [["n"], ["n"]]).orderBy("turn", "source").collect()]
    assert got == "a0 b0 a1 b1 a2 b2 a0 b3 a1 b4".split()


def test_splits(spark):
    t = spark.range(1000).select(F.concat(F.lit("t"), "id").alias("table_id"))
    assert sampling.split_tables(t).where("split = 'test'").count() == 25
    df = spark.range(3030).select("id", F.when(F.col("id") < 3000, "big").otherwise(F.concat(F.lit("s"), "id")).alias("t"))
    out = sampling.split_rows(df, "t", ["id"], F.lit("c"), "1")
    assert out.where("split = 'traineval' and t <> 'big'").count() == 0 and out.count() == 3030
    iid = sampling.split_iid(df, ["id"], 1).groupBy("split").count().collect()
    share = {r["split"]: r["count"] / 3030 for r in iid}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03


def test_shards_respect_size(spark):
    df = spark.range(1000).select("id", (F.col("id") % 90 + 10).alias("size"))
    for limit in ("2000000", "0"):
        spark.conf.set("spark.tabloom.maxGroupRows", limit)
        got = shards.shard_by_size(df, ["id"], "size", 500).groupBy("shard").agg(F.sum("size").alias("s")).orderBy("shard").collect()
        spark.conf.unset("spark.tabloom.maxGroupRows")
        assert [r["shard"] for r in got] == list(range(len(got))) and all(r["s"] < 500 + 100 for r in got)


def test_names_and_patterns_meet_without_pairing(spark, tmp_path):
    import re

    rnd = __import__("random").Random(5)
    make = lambda n: "".join(rnd.choice("ab_%.\\/") for _ in range(n))
    names = [make(rnd.randrange(0, 7)) for _ in range(400)] + ["ab", None, "ab"]
    patterns = [make(rnd.randrange(0, 3)) + "*" + make(rnd.randrange(0, 2)) + rnd.choice(["", "*"]) for _ in range(40)] + ["ab", "a_", None, "*zz"]
    gone = rnd.sample([n for n in names if n], 20)
    want = {n for n in names if n is not None and n not in gone and any(
        re.match(re.escape(p).replace("\\*", ".*") + ("" if "*" in p else "$"), n, re.DOTALL) for p in patterns if p is not None)}
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = sampling.resolve_names_by_table(frame(names, "n"), "n", frame(patterns, "pattern"), frame(gone, "name"))
    rows = [r["n"] for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 20
    many = frame([f"x{i}*" for i in range(10_000)], "pattern")
    plan = sampling.resolve_names_by_table(frame(names, "n"), "n", many, frame([], "name"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    (tmp_path / "list.txt").write_text("ab\n\n a* \n")
    assert {r[0] for r in sampling.read_names(spark, f"'{tmp_path}/list.txt'").collect()} == {"ab", "a*"}
    assert {r[0] for r in sampling.read_names(spark, "'ab, b*,,c'").collect()} == {"ab", "b*", "c"}


def test_tokens_are_made_piece_by_piece(spark):
    import pyarrow as pa

    texts = ["é" * 40, None, "", "x" * 300, "ab<|endinput|>c"] * 20
    cut = list(tokenize.pieces(iter([pa.array(texts, pa.string())]), 100))
    assert [t for p in cut for t in p.to_pylist()] == texts and all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= 100 for p in cut)
    class Told(tokenize.ByteTokenizer):
        def encode_arrow(self, arr):
            assert arr.nbytes < 2 * tokenize.PIECE_BYTES, "the whole batch at once"
            return super().encode_arrow(arr)

    df = spark.range(4000, numPartitions=1).select("id", F.repeat(F.lit("word "), 200).alias("input_text"), F.col("id").cast("string").alias("target_text"))
    rows = tokenize.tokenize_samples(df, Told()).select("id", F.size("input_ids").alias("n"), F.size(tokenize.unmasked(F.col("labels"))).alias("k")).collect()
    assert len(rows) == 4000 and all(r.n == 1001 + len(str(r.id)) and r.k == len(str(r.id)) for r in rows)
