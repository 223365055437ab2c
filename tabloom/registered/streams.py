"""The sample steps as streams over the given files."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from tabloom.config import SerializerConfig
from tabloom.functions import hashing
from tabloom.operators import labels, rejects
from tabloom.registered.common import load, q, sentences, uniform
from tabloom.session import scratch_path
from tabloom.sources import checked
from tabloom.streaming import streams

QUERIES, SQL = {}, {}


def _stream(spark, folder, name):
    return streams.read_stream(spark, folder, load(spark, folder, name).schema, f"{name}.parquet")


def _serialize(spark, folder):
    s = _stream(spark, folder, "events")
    out = labels.to_samples(s, "event_type", SerializerConfig(), choices=["click", "view"], keep=["event_id"])
    return streams.write_available(out)


QUERIES["stream_serialize"] = _serialize
SQL["stream_serialize"] = (
    f"SELECT event_id, 'Predict the event_type: ||click||view|| ' || {sentences('events', 'event_type')} || ' What is the value of event_type? ||click||view||' AS text, "
    "event_type AS class_label_as_text FROM events"
)


def _accuracy(spark, folder):
    s = _stream(spark, folder, "orders")
    guess = F.when(hashing.uniform(5, F.col("o_orderkey")) < 0.5, F.col("o_orderstatus")).otherwise(F.lit("F"))
    s = s.select(F.col("o_orderpriority").alias("task"), guess.alias("prediction"), F.col("o_orderstatus").alias("label"))
    return streams.latest_totals(streams.running_accuracy(s, ["task"], "prediction", "label"), ["task"])


QUERIES["stream_accuracy"] = _accuracy
SQL["stream_accuracy"] = (
    f"SELECT o_orderpriority AS task, count(*) FILTER (g = o_orderstatus) AS hits, count(*) AS samples, avg((g = o_orderstatus)::INT::DOUBLE) AS accuracy FROM (SELECT *, CASE WHEN "
    f"{uniform(5, 'o_orderkey::VARCHAR')} < 0.5 THEN o_orderstatus ELSE 'F' END AS g FROM orders) GROUP BY 1"
)


def _shuffle(spark, folder):
    s = _stream(spark, folder, "customer").select("c_custkey", "c_name")
    return streams.shuffle_batches(s, ["c_custkey"], scratch_path(spark, "shuffled"), 2).select("c_custkey", "c_name")


QUERIES["stream_shuffle"] = _shuffle
SQL["stream_shuffle"] = "SELECT c_custkey, c_name FROM customer"


@contextmanager
def _rocksdb(spark):
    """The state store that the stateful steps need."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before)


_BUFFER, _LANES = 40, 3


def _shuffle_rows(spark, folder):
    """Places of a shuffle that goes on across micro-batches. Which row arrives when is chance; who leaves for whom is not."""
    path = scratch_path(spark, "customers")
    rows = load(spark, folder, "customer").select("c_custkey", "c_name")
    rows.repartition(5).write.parquet(path)
    with _rocksdb(spark):
        s = streams.read_stream(spark, path, rows.schema, files_per_batch=1)
        out = streams.write_drained(streams.shuffle_rows(s, "c_custkey", _BUFFER, 5, lanes=_LANES, flush_ms=3000))
    whole = out.join(rows.withColumnRenamed("c_name", "name"), "c_custkey", "left")
    return whole.select("lane", "arrival", "place", (F.col("c_name") == F.col("name")).alias("same_row"))


QUERIES["stream_shuffle_rows"] = _shuffle_rows
_held = f"least(n, {_BUFFER})"
SQL["stream_shuffle_rows"] = (
    f"WITH lanes AS (SELECT floor({uniform('lane', 'c_custkey::VARCHAR')} * {_LANES})::INT AS lane, count(*) AS n FROM customer GROUP BY 1), "
    "a AS (SELECT lane, n, unnest(range(n)) AS arrival FROM lanes), "
    f"s AS (SELECT *, CASE WHEN arrival < {_BUFFER} THEN arrival ELSE floor({uniform(5, 'lane::VARCHAR', 'arrival::VARCHAR')} * {_BUFFER})::BIGINT END AS slot FROM a), "
    f"o AS (SELECT *, lead(arrival) OVER (PARTITION BY lane, slot ORDER BY arrival) AS successor, {uniform(5, 'lane::VARCHAR', q('rest'), 'arrival::VARCHAR')} AS draw FROM s) "
    f"SELECT lane, arrival, CASE WHEN successor IS NOT NULL THEN successor - {_BUFFER} ELSE n - {_held} + row_number() OVER (PARTITION BY lane, successor IS NULL ORDER BY draw, arrival) - 1 END AS place, "
    "true AS same_row FROM o"
)


def _count_off(spark, folder):
    """Runs per lane and batch: their sizes do not depend on the order of arrival."""
    with _rocksdb(spark):
        s = _stream(spark, folder, "events").select("event_id", "event_type")
        out = streams.write_available(streams.count_off(s, "event_type", "event_id", 150, lanes=2))
    return out.groupBy("event_type", "lane", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last_slot"))


QUERIES["stream_count_off"] = _count_off
SQL["stream_count_off"] = (
    "SELECT event_type, lane, b AS batch, least(150, n - b * 150)::BIGINT AS n, (least(150, n - b * 150) - 1)::INT AS last_slot FROM (SELECT event_type, "
    f"floor({uniform('lane', 'event_id::VARCHAR')} * 2)::INT AS lane, count(*) AS n FROM events GROUP BY ALL), generate_series(0, 1000000) AS g(b) WHERE b * 150 < n"
)


def _rejects(spark, folder):
    """Events as a stream of files of which one is no table: kept and refused rows from one pass, counted on the way."""
    path = scratch_path(spark, "events")
    rows = load(spark, folder, "events")
    rows.repartition(4).write.parquet(path)
    spark.range(1).select(F.lit("no table").alias("value")).coalesce(1).write.mode("append").text(path)
    s = checked.read_checked(spark, path, rows.schema, "*.{parquet,txt}", stream=True, files_per_batch=2)
    samples = labels.to_samples(s, "event_type", SerializerConfig(), choices=["click", "view"], keep=["event_id", "source", "reason"], columns=rows.columns)
    out, counts = streams.write_marked(rejects.mark(samples, [(F.length("text") > _LONG, "too long")], payload=["text"]))
    told = F.when(F.col("reason").startswith("unreadable"), "unreadable").otherwise(F.col("reason"))
    whole = out.count() == counts["kept"] + counts["rejected"] and counts["rejected"] == out.where("outcome = 'rejected'").count()
    return out.select("event_id", "outcome", told.alias("reason"), F.md5("text").alias("text_md5"), F.lit(whole).alias("counted"))


_LONG = 210  # characters; about half of the samples are longer
QUERIES["stream_rejects"] = _rejects
SQL["stream_rejects"] = (
    "SELECT event_id, CASE WHEN bad THEN 'rejected' ELSE 'kept' END AS outcome, CASE WHEN bad THEN 'too long' END AS reason, CASE WHEN NOT bad THEN md5(t) END AS text_md5, true AS counted FROM "
    f"(SELECT *, length(t) > {_LONG} AS bad FROM (SELECT event_id, 'Predict the event_type: ||click||view|| ' || {sentences('events', 'event_type')} || ' What is the value of event_type? ||click||view||' AS t FROM events)) "
    "UNION ALL SELECT NULL, 'rejected', 'unreadable', NULL, true"
)
