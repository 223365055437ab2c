import os
import tarfile

import pytest
from pyspark.sql import functions as F

from tabloom.config import PipelineConfig, SerializerConfig
from tabloom.operators import labels
from tabloom.plans import tables_to_samples, training
from tabloom.sources import arff, synthetic, tables, tar, taskconfig
from tabloom.streaming import streams


def test_tar_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(300).select(F.concat(F.lit("k__"), "id").alias("key"), F.concat(F.lit("é"), F.repeat(F.lit("x"), (F.col("id") % 7 * 300).cast("int"))).alias("text"))
    tar.write_tar(df.repartition(3), path, "train")
    names = sorted(os.listdir(path))
    assert names == [f"train-{i:06d}.tar" for i in range(3)]
    with tarfile.open(f"{path}/{names[0]}") as t:
        assert "é" in t.extractfile(t.next()).read().decode()
    for split in (60_000, 10**9):
        back = tar.read_tar(spark, path, split_bytes=split).select("key", F.from_json("json", "text string")["text"].alias("text"))
        assert back.exceptAll(df).count() == 0 and back.count() == 300
    with pytest.raises(Exception, match="already holds"):
        tar.write_tar(df, path)
    assert sorted(os.listdir(path)) == names
    tar.write_tar(df.coalesce(1), path, overwrite=True)
    assert os.listdir(path) == ["000000.tar"]


def test_broken_shard_is_reported(spark, tmp_path):
    path = str(tmp_path / "t")
    tar.write_tar(spark.range(5).select(F.col("id").cast("string").alias("key"), F.lit("{}").alias("json")).coalesce(1), path)
    (tmp_path / "t" / "bad.tar").write_bytes(b"not a tar file" * 100)
    rows = tar.read_tar(spark, path)
    assert rows.where("problem is null").count() == 5 and streams.problem_counts(rows).first()["shards"] == 1
    with pytest.raises(Exception):
        tar.read_tar(spark, path, strict=True).count()


def test_arff(spark, tmp_path):
    p = tmp_path / "x.arff"
    p.write_text("% c\n@relation r\n@attribute a numeric\n@attribute 'b c' {x,'y z'}\n@ATTRIBUTE d string\n@data\n1.5,'y z',q\n?,x,?\n")
    df = arff.read_arff(spark, str(p))
    assert df.columns == ["a", "b c", "d"] and [tuple(r) for r in df.collect()] == [(1.5, "y z", "q"), (None, "x", None)]


def test_yaml_without_library(monkeypatch):
    import builtins

    c = labels.TaskConfig("Predict: it", "What is 'it'?", None, {"1": "Yes", "0": "No"}, [3.0, 2.0])
    real = builtins.__import__

    def no_yaml(name, *a, **k):
        if name == "yaml":
            raise ImportError
        return real(name, *a, **k)

    sample = "label_values:\n- 3.0\n- 2.0\nlabels_mapping: null\nprefix: Predict the value of target\n  over two lines\nsuffix: What?\ntask_context: null\n"
    for patched in (False, True):
        if patched:
            monkeypatch.setattr(builtins, "__import__", no_yaml)
        assert taskconfig.from_yaml(taskconfig.to_yaml(c)) == (c, [])
        got, missing = taskconfig.from_yaml(sample)
        assert got.prefix == "Predict the value of target over two lines" and got.labels_mapping is None and not missing
        assert got.label_list() == ["3.0", "2.0"]
        assert taskconfig.from_yaml("prefix: a\nsuffix: b\n")[1] == ["labels_mapping"]
    with pytest.raises(KeyError):
        taskconfig.get_config("none", taskconfig.registry())
    assert taskconfig.get_config("blobs", taskconfig.registry()).label_list()[:2] == ["0", "1"]


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,day,ok\n1,2024-01-01,True\n2.5,2024-01-02 10:00:00,False\n")
    df = tables.read_table(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"x": "double", "day": "string", "ok": "boolean"}
    with pytest.raises(tables.UnknownFormat):
        tables.read_table(spark, "x.xls")
    with pytest.raises(FileNotFoundError):
        tables.read_task_folder(spark, str(tmp_path))


@pytest.mark.parametrize("name", list(synthetic.GENERATORS))
def test_toy_tables(spark, name):
    df = synthetic.table(spark, name, 3000)
    assert df.columns == ["x_0", "x_1", "y"]
    counts = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    assert len(counts) in (2, 3) and min(counts.values()) > 900
    if name == "noisy_circles":
        r = df.select("y", F.sqrt(F.col("x_0") ** 2 + F.col("x_1") ** 2).alias("r")).groupBy("y").avg("r").collect()
        assert {x["y"]: round(x["avg(r)"], 1) for x in r} == {0: 1.0, 1: 0.5}


@pytest.mark.parametrize(("style", "precision"), [("basic_v2", None), ("structured", None), ("basic_v2", 2), ("structured", 3)])
def test_records_give_the_same_samples_as_columns(spark, tmp_path, style, precision):
    """Every kind of column, missing values, two schemas, several row groups."""
    from tabloom.sources import records

    base = spark.range(500).select(
        "id", F.when(F.col("id") % 9 > 0, F.col("id") * 1e-5).alias("f"), (F.col("id") % 2 == 0).alias("b"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit(" s"), (F.col("id") % 5).cast("string"), F.lit(". "))).alias("s"),
        (F.col("id") % 3).cast("int").alias("k"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,id % 2 * 0.5)").alias("t"),
        F.expr("cast(date'2024-01-01' + cast(id % 4 as int) as date)").alias("d"), F.array(F.col("id").cast("double"), F.lit(None)).alias("a"),
        F.encode(F.lit("é"), "ISO-8859-1").alias("raw"), F.expr("cast(id % 4 * 0.25 as decimal(5,2))").alias("dec"),
        F.expr("named_struct('p', if(id % 3 = 0, null, id), 'q', 'é')").alias("st"), F.expr("map('k', id, 'l', cast(null as bigint))").alias("m"))
    src = str(tmp_path / "in")
    base.coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{src}/a")
    base.select("f", "k", "s").coalesce(1).write.parquet(f"{src}/b")
    cfg = SerializerConfig(style=style, shuffle_features=True, feature_dropout=0.2, max_precision=precision)
    got = {}
    for name, size in (("columns", "0"), ("records", str(2**40))):
        spark.conf.set("spark.tabloom.schemaGroupBytes", size)
        try:
            out = tables_to_samples.run(spark, src, str(tmp_path / name), serializer=cfg, seed=5)
        finally:
            spark.conf.unset("spark.tabloom.schemaGroupBytes")
        got[name] = sorted((r["key"], r["text"], r["class_label_as_text"], r["split"]) for r in out.collect())
    assert len(got["columns"]) == 1000 and got["columns"] == got["records"]
    assert records.read_records(tables.list_tables(spark, src)).count() == 1000


def test_tables_to_samples(spark, tmp_path, table):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = {}
    for t in ("customer", "part", "supplier"):
        df = table(t)
        rows[t] = df.count()
        df.coalesce(1).write.parquet(f"{src}/{t}")
    samples = tables_to_samples.run(spark, src, out, pipeline=PipelineConfig(train_frac="0.5"), seed=2)
    got = samples.withColumn("t", F.element_at(F.split("filename", "/"), -2)).groupBy("t").agg(F.count("*").alias("n"), F.count_distinct("key").alias("k"), F.count_distinct("split").alias("s")).collect()
    assert {r["t"]: r["n"] for r in got} == rows and all(r["n"] == r["k"] and r["s"] == 1 for r in got)
    for r in samples.collect():
        target = r["text"].split(":")[0].removeprefix("Predict the ")
        assert f"The {target} is " not in r["text"] and r["text"].endswith("||")
        assert f"||{r['class_label_as_text']}||" in r["text"]
    files = tables_to_samples.to_shards(samples, f"{out}/tar", PipelineConfig(traineval_frac="0.3", target_shard_mb=1))
    back = sum(tar.read_tar(spark, f"{out}/tar/{r['split']}").count() for r in files.select("split").distinct().collect())
    assert back == sum(rows.values())


@pytest.mark.parametrize("limit", ["2000000", "0"])
def test_shards_have_the_wanted_size(spark, tmp_path, limit):
    """One table holds most rows; shards still come out near the target."""
    s = spark.range(3000).select(
        F.lpad(F.col("id").cast("string"), 6, "0").alias("row_id"), F.repeat(F.lit("x"), 1500).alias("text"), F.lit("y").alias("class_label_as_text"),
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 70).cast("string"))).alias("filename"), F.lit("train").alias("split"))
    s = s.withColumn("key", F.concat_ws("__", "filename", "row_id"))
    spark.conf.set("spark.tabloom.maxGroupRows", limit)
    try:
        files = tables_to_samples.to_shards(s, str(tmp_path), PipelineConfig(target_shard_mb=1, traineval_frac="0.5", chunk_size=1)).collect()
    finally:
        spark.conf.unset("spark.tabloom.maxGroupRows")
    sizes = [os.path.getsize(r["path"]) for r in files]
    assert len(files) >= 8 and max(sizes) < 1.5 * 1024 * 1024
    back = sum(tar.read_tar(spark, os.path.dirname(p)).count() for p in {os.path.dirname(r["path"]) + "/" for r in files})
    assert back == 3000
    for r in files:
        with tarfile.open(r["path"]) as t:
            names = t.getnames()
        assert names == sorted(names)


def test_stream_equals_batch(spark, table, tmp_path):
    df = table("events")
    folder = str(tmp_path / "ev")
    df.repartition(3).write.parquet(folder)

    def step(x):
        return labels.to_samples(x, "event_type", SerializerConfig(shuffle_features=True), choices=["a"], keep=["event_id"], row_key=F.col("event_id"))

    got = streams.write_available(step(streams.read_stream(spark, folder, df.schema, files_per_batch=1)))
    want = step(df)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_count_off_across_batches(spark, tmp_path):
    folder = str(tmp_path / "n")
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("s"))
    df.repartition(4).write.parquet(folder)
    got = streams.write_available(streams.count_off(streams.read_stream(spark, folder, df.schema, files_per_batch=1), "s", "id", 50, lanes=3))
    groups = got.groupBy("s", "lane", "batch").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d")).collect()
    assert got.count() == 1000 and all(r["n"] == r["d"] <= 50 for r in groups)
    for key in {(r["s"], r["lane"]) for r in groups}:
        sizes = [r["n"] for r in sorted((r for r in groups if (r["s"], r["lane"]) == key), key=lambda r: r["batch"])]
        assert all(n == 50 for n in sizes[:-1])
