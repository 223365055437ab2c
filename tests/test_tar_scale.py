"""Shards of any number and size: tasks follow the bytes, not the shards or the splits."""

import json
import os

from pyspark.sql import functions as F

from tabloom.config import PipelineConfig
from tabloom.operators import shards
from tabloom.plans import tables_to_samples
from tabloom.registered import scans
from tabloom.session import cut_lineage
from tabloom.sources import tar


def samples(spark, n, chars=300):
    return spark.range(n).select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("key"), F.to_json(F.struct(F.repeat(F.lit("x"), chars).alias("t"))).alias("json"))


def test_splits_and_small_shards_share_tasks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = samples(spark, 2000).withColumn("shard", F.floor(F.col("key").cast("int") / 20))
    tar.write_numbered(df, path, 20_000, 99, "a")
    assert sorted(os.listdir(path)) == [f"a-{i:06d}.tar" for i in range(100)]
    for split in (5_000, 1 << 20):
        back = tar.read_tar(spark, path, split_bytes=split)
        assert back.rdd.getNumPartitions() <= 102
        assert back.where("problem is null").select("key", "json").exceptAll(df.select("key", "json")).count() == 0 and back.count() == 2000
    assert tar.read_tar(spark, path).rdd.getNumPartitions() == 1


def test_no_split_walks_the_headers_before_it(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tar.write_tar(samples(spark, 500).coalesce(1), path)
    (shard, size, name), = tar.commits.shard_files(path)
    cuts = tar._cuts(spark, path, [(shard, name, size, 0)], 10_000).orderBy("start").collect()
    assert len(cuts) > 20 and [c.start for c in cuts[1:]] == [c.end for c in cuts[:-1]] and cuts[-1].end == size
    reader = tar.TarReader({"path": path})
    got = []
    for c in cuts:
        with tar.open_shard(tar.filesystem(path)[0], shard, name) as raw, tar.opened_at(raw, c.start) as t:
            assert t.firstmember is None or t.firstmember.offset == c.start
        got += [r[0] for r in reader.read(tar.TarSplit(shard, c.start, c.end, name, at=c.start))]
    assert got == [f"{i:06d}" for i in range(500)]


def test_a_shard_that_ends_early_is_told_once(spark, tmp_path):
    path = str(tmp_path / "t")
    tar.write_tar(samples(spark, 100, 2000).coalesce(1), path)
    (shard, size, _), = tar.commits.shard_files(path)
    os.truncate(shard, size // 2 // 512 * 512 + 700)
    for split in (20_000, 1 << 30):
        rows = tar.read_tar(spark, path, split_bytes=split).collect()
        assert sum(r.problem is not None for r in rows) == 1 and 30 < len(rows) < 60


def test_shards_of_large_tables_grow_in_number(spark):
    assert scans._shard_count(spark.range(10).select(F.lit("x").alias("text"))) == 4
    assert scans._shard_count(spark.range(600).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))) == 10


def test_joins_do_not_take_shards_for_small(spark, tmp_path):
    path = str(tmp_path / "t")
    df = samples(spark, 2000)
    tar.write_tar(df.repartition(2), path)
    keys = df.select("key", F.lit(1).alias("one")).repartition(3)

    def joined(other, rows):
        out = rows.select("key").join(other, "key")
        assert len(out.collect()) == 2000
        return out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    for rows in (tar.read_tar(spark, path), tar.read_tar(spark, path).where("problem is null"), tar.read_index(spark, path)):
        assert "Broadcast" not in joined(keys, rows)
        assert "BroadcastHashJoin" in joined(F.broadcast(keys), rows)  # a hint of one's own decides


def test_a_long_name_costs_no_more_than_a_short_one(spark, tmp_path):
    folder = "file:/" + "lake-0123456789/" * 8 + "a.parquet"
    keys = [f"{folder}__{i}" for i in range(50)]
    odd = ["k", "ä" * 90, "x" * 300, folder + "/" + "y" * 120, "/" + "z" * 95, "/abs/" + "z/" * 60 + "é", "q/" * 140 + "r", "/" + "w/" * 60 + "v", "//s"]
    for name, some in (("plain", keys), ("odd", odd)):
        df = spark.createDataFrame([(k, "{}") for k in some], "key string, json string")
        tar.write_tar(df.coalesce(1), str(tmp_path / name))
        back = tar.read_tar(spark, str(tmp_path / name), strict=True).collect()
        assert sorted(r["key"] for r in back) == sorted(some) and {r["json"] for r in back} == {"{}"}
    # A header and a block of content for each, two empty blocks, filled up to a record.
    (_, size, _), = tar.commits.shard_files(str(tmp_path / "plain"))
    assert size == -(-(50 * 1024 + 1024) // 10240) * 10240


def held(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    return sum(os.path.getsize(f"{at}/{n}") for at, _, names in os.walk(root) for n in names)


def test_samples_are_stored_once_on_their_way_to_shards(spark, tmp_path):
    noise = F.concat_ws("", *[F.md5(F.concat_ws(":", "id", F.lit(i))) for i in range(40)])
    # One key comes 500 times and one is missing.
    key = F.when(F.col("id") < 500, "twice").when(F.col("id") > 500, F.concat(F.lit("t__"), F.col("id").cast("string")))
    df = cut_lineage(spark.range(3000).select(
        key.alias("key"), noise.alias("text"), F.lit("a").alias("class_label_as_text"), F.concat(F.lit("f"), F.pmod("id", F.lit(3)).cast("string")).alias("filename"),
        F.col("id").alias("row_id"), F.when(F.pmod("id", F.lit(4)) == 0, "test").otherwise("train").alias("split")))
    before = held(spark)
    once = cut_lineage(df)
    size = held(spark) - before
    spark.conf.set("spark.tabloom.maxGroupRows", "100")
    try:
        made = tables_to_samples.to_shards(df, str(tmp_path), PipelineConfig(target_shard_mb=1)).collect()
    finally:
        spark.conf.unset("spark.tabloom.maxGroupRows")
    assert held(spark) - before - size < 1.3 * size
    assert all(os.path.getsize(r["path"]) < 1.1 * (1 << 20) for r in made) and len(made) == 8
    texts, keys = [], {}
    for r in made:
        for b in tar.read_tar(spark, r["path"], strict=True).collect():
            texts.append(json.loads(b["json"])["text"])
            keys.setdefault(r["split"], []).append("" if b["key"] == "None" else b["key"])
    assert sorted(texts) == sorted(r["text"] for r in once.collect())
    assert sorted(keys) == ["test", "train"] and all(k == sorted(k) for k in keys.values())


def test_shards_are_found_by_their_first_rows(spark):
    rows = [(g, k, i, 40 + i % 90) for i, (g, k) in enumerate([("a", None)] * 5 + [("a", "k")] * 30 + [("a", f"ä{i}") for i in range(50)] + [("b", f"{i}") for i in range(50)])]
    df = spark.createDataFrame(rows, "g string, key string, row long, bytes long")
    placed = shards.shard_by_size(df, ["key", "row"], "bytes", 200, ["g"])
    shard, last = shards.shard_lookup(placed, ["key", "row"], "g")
    want = {r["row"]: r["shard"] for r in placed.collect()}
    assert {r["row"]: r["found"] for r in df.withColumn("found", shard).collect()} == want
    assert last == {g: max(want[r[2]] for r in rows if r[0] == g) for g in "ab"} and last["a"] > 20
