"""Nothing is left out unsaid."""

import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabloom.config import PipelineConfig
from tabloom.operators import infer, rejects
from tabloom.plans import tables_to_samples
from tabloom.sources import checked
from tabloom.streaming import streams


def test_first_rule_names_the_reason_and_payload_goes(spark, tmp_path):
    df = spark.createDataFrame([(1, "short"), (2, "much too long"), (3, None), (4, "")], "id int, text string")
    marked = rejects.mark(df, [(F.col("text").isNull(), "no text"), (F.length("text") > 5, "too long"), (F.col("id") == 2, "never")], ["text"])
    seen = Observation()
    rejects.counted(marked, seen).write.partitionBy("outcome").parquet(str(tmp_path / "t"))
    assert seen.get == {"kept": 2, "rejected": 2}
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {tuple(r) for r in rejects.kept(back).collect()} == {(1, "short"), (4, "")}
    assert {tuple(r) for r in rejects.letters(back, F.lit("s"), F.col("id")).collect()} == {("s", "2", "too long", 1), ("s", "3", "no text", 1)}
    again = rejects.mark(marked.drop("outcome"), [(F.lit(True), "late")])
    assert {r["id"]: r["reason"] for r in again.collect()} == {1: "late", 2: "too long", 3: "no text", 4: "late"}


@pytest.mark.parametrize("group_bytes", [0, 1 << 30])
def test_tables_to_samples(spark, table, tmp_path, group_bytes):
    src = tmp_path / "in"
    table("customer").write.parquet(str(src / "a"))
    table("supplier").select("s_suppkey").coalesce(1).write.parquet(str(src / "b"))
    (src / "c").mkdir()
    (src / "c" / "x.parquet").write_bytes(b"no table")
    spark.conf.set("spark.tabloom.schemaGroupBytes", str(group_bytes))
    try:
        with pytest.raises(OSError, match="unreadable"):
            tables_to_samples.run(spark, str(src), str(tmp_path / "no"))
        counts = {}
        samples = tables_to_samples.run(spark, str(src), str(tmp_path / "out"), pipeline=PipelineConfig(max_chars=260), seed=1, skip_unreadable=True, counts=counts)
    finally:
        spark.conf.unset("spark.tabloom.schemaGroupBytes")
    refused = tables_to_samples.rejected(spark, str(tmp_path / "out")).collect()
    assert samples.where(F.length("text") > 260).count() == 0 and samples.columns[:3] == ["key", "text", "class_label_as_text"]
    assert counts["kept"] == samples.count() and counts["kept"] + counts["rejected"] == table("customer").count()
    by = {r["reason"].partition(" ")[0]: r for r in refused}
    assert by["no"]["rows"] == table("supplier").count() and "/b/" in by["no"]["source"]
    assert any("/c/" in r["source"] and r["rows"] is None for r in refused)
    assert sum(r["reason"] == "too long" for r in refused) == counts["rejected"]


def test_prompts_without_room_skip_the_model(spark):
    seen = spark.createDataFrame([(i, "x" * i) for i in range(20)], "id int, prompt string")

    def make():
        def run(texts, budget):
            assert all(b >= 2 for b in budget)
            return ["y" * b for b in budget]

        return run

    out = infer.generate(seen, make, 5, max_len=12, no_room="mark").collect()
    assert len(out) == 20
    for r in out:
        assert (r["reason"], r["completion"]) == (("no room", None) if r["id"] > 10 else (None, "y" * min(5, 12 - r["id"])))
    assert infer.generate(seen, make, 5, max_len=12).count() == 11


@pytest.mark.parametrize("stream", [False, True])
def test_damaged_files_are_rows(spark, table, tmp_path, stream):
    df = table("events")
    path = str(tmp_path / "in")
    df.repartition(3).write.parquet(path)
    (tmp_path / "in" / "bad.parquet").write_bytes(b"PAR1 nothing")
    whole = sorted(p for p in os.listdir(path) if p.startswith("part"))
    cut = tmp_path / "in" / "cut.parquet"
    cut.write_bytes((tmp_path / "in" / whole[0]).read_bytes()[:-100])
    rows = checked.read_checked(spark, path, df.schema, stream=stream, files_per_batch=1 if stream else None)
    if stream:
        out, counts = streams.write_marked(rejects.mark(rows, []), str(tmp_path / "out"))
        assert counts == {"kept": df.count(), "rejected": 2}
        assert out.where("outcome = 'rejected'").count() == 2
        rows = out.drop("outcome")
    good = rows.where("reason is null").select(*df.columns)
    assert sorted(map(str, good.collect())) == sorted(map(str, df.collect()))
    bad = rows.where("reason is not null").collect()
    assert {os.path.basename(r["source"]) for r in bad} == {"bad.parquet", "cut.parquet"} and all("unreadable after" in r["reason"] for r in bad)
    with pytest.raises(ValueError):
        checked.read_checked(spark, path, df.withColumn("source", F.lit(1)).schema)
