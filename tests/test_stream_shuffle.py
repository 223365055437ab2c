"""Bounded shuffle across micro-batches."""

import pytest
from pyspark.sql import functions as F

from tabloom.streaming import streams


def test_rows_move_past_their_batch_and_none_is_lost(spark, tmp_path):
    df = spark.range(600).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), "id")).alias("text"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("n"))
    for i in range(3):
        df.where(F.floor(F.col("id") / 200) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    out = streams.write_drained(streams.shuffle_rows(stream, "id", 25, 1, lanes=2, flush_ms=3000), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = out.collect()
    assert sorted((r["id"], r["text"], r["n"]) for r in rows) == sorted(tuple(r) for r in df.collect())
    for lane in (0, 1):
        own = sorted((r for r in rows if r["lane"] == lane), key=lambda r: r["arrival"])
        assert [r["arrival"] for r in own] == list(range(len(own))) and sorted(r["place"] for r in own) == list(range(len(own)))
        assert all(r["place"] >= r["arrival"] - 25 for r in own)
        assert any(r["place"] > r["arrival"] for r in own) and [r["place"] for r in own] != list(range(len(own)))
        # A row of one file left among those of another: with 25 held, in front of at most 25 of its own.
        file_of = lambda r: r["id"] // 200
        left = sorted(own, key=lambda r: r["place"])
        assert [file_of(r) for r in left] != sorted(file_of(r) for r in left)


def test_a_restarted_stream_goes_on(spark, tmp_path):
    df = spark.range(100).select("id")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        stream = streams.read_stream(spark, str(tmp_path / "in"), df.schema)
        return streams.write_drained(streams.shuffle_rows(stream, "id", 10, 7, lanes=1, flush_ms=100), str(tmp_path / "out"), str(tmp_path / "state"))

    assert run().count() == 100
    spark.range(100, 150).select("id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = run().collect()
    assert sorted(r["id"] for r in rows) == list(range(150))
    assert sorted(r["place"] for r in rows) == list(range(150))


def test_columns_of_the_result_are_refused(spark, tmp_path):
    df = spark.range(3).withColumn("place", F.lit(1))
    df.write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        streams.shuffle_rows(streams.read_stream(spark, str(tmp_path / "in"), df.schema), "id", lanes=1)
