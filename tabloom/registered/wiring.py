"""Smaller operators: formats that are read back, files that are written and listed, rows of settings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.config import SerializerConfig
from tabloom.operators import baselines, columns, evaluate, labels, sampling, serialize, shards
from tabloom.registered.common import digest, load
from tabloom.session import scratch_path
from tabloom.sources import metadata
from tabloom.sources.files import filesystem

QUERIES, SQL = {}, {}


def _read_json_style(spark, folder):
    df = load(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    t = serialize.serialize(serialize.features_of(df, ["c_name", "c_nationkey", "c_mktsegment"]), SerializerConfig(style="json"))
    back = df.select("c_custkey", serialize.deserialize_json(t).alias("m"))
    return back.select("c_custkey", *[F.col("m")[c]["value"].alias(c) for c in ("c_name", "c_nationkey", "c_mktsegment")])


QUERIES["deserialize_json"] = _read_json_style
SQL["deserialize_json"] = "SELECT c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer"


def _own_style(spark, folder):
    """A grammar of one's own, registered by name."""
    serialize.register_style("pairs", lambda features, **kw: F.concat_ws("; ", *[F.concat(F.lit(f.name + "="), f.value.cast("string")) for f in features]))
    df = load(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return df.select("s_suppkey", serialize.serialize_with("pairs", serialize.features_of(df, ["s_name", "s_nationkey"])).alias("text"))


QUERIES["serialize_own_style"] = _own_style
SQL["serialize_own_style"] = "SELECT s_suppkey, 's_name=' || s_name || '; s_nationkey=' || s_nationkey AS text FROM supplier"

QUERIES["row_info"] = lambda spark, folder: load(spark, folder, "orders").select(
    "o_orderkey", columns.row_info(F.col("o_orderstatus"), F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.lit("orders")).alias("info"))
SQL["row_info"] = (
    "SELECT o_orderkey, '{\"target\":\"' || o_orderstatus || '\",\"target_choices\":[\"F\",\"O\",\"P\"],\"task\":\"orders\"}' AS info FROM orders"
)

QUERIES["bools_to_int"] = lambda spark, folder: columns.bools_to_int(
    load(spark, folder, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("finished"), "o_orderstatus"))
SQL["bools_to_int"] = "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS finished, o_orderstatus FROM orders"


def _drop_columns(spark, folder):
    status = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    df = load(spark, folder, "orders").select("o_orderkey", "o_totalprice", status.alias("status"), F.lit(float("nan")).alias("gap"))
    return columns.drop_missing(df, "columns")


QUERIES["drop_missing_columns"] = _drop_columns
SQL["drop_missing_columns"] = "SELECT o_orderkey, o_totalprice FROM orders"


def _subset_features(spark, folder):
    listed = [{"name": n, "description": ""} for n in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")]
    chosen = columns.subset_features(listed, ["c_mktsegment", "c_custkey", "c_nationkey"])
    chosen = columns.describe_features(chosen, {"c_custkey": "number of the customer"})
    df = columns.apply_feature_list(load(spark, folder, "customer"), chosen)
    return df.withColumn("order", F.lit(" ".join(df.columns))).withColumn("described", F.lit(chosen[0]["description"]))


QUERIES["feature_list_subset"] = _subset_features
SQL["feature_list_subset"] = (
    "SELECT c_custkey, c_mktsegment, c_nationkey, 'c_custkey c_mktsegment c_nationkey' AS \"order\", 'number of the customer' AS described FROM customer"
)


def _target_values(spark, folder):
    entry = F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.col("n_name"))))
    features = load(spark, folder, "nation").agg(entry.alias("value_mapping")).select(
        F.lit("c_nationkey").alias("name"), F.lit(True).alias("is_target"), "value_mapping")
    return labels.target_feature_values(features).select("name", F.explode("values").alias("value"))


QUERIES["target_feature_values"] = _target_values
SQL["target_feature_values"] = "SELECT 'c_nationkey' AS name, n_name AS value FROM nation"


def _class_shares(spark, folder):
    shares = baselines.class_shares(load(spark, folder, "orders"), "o_orderpriority")
    return spark.createDataFrame(list(shares.items()), "label string, share double").withColumn("share", F.round("share", 9))


QUERIES["class_shares"] = _class_shares
SQL["class_shares"] = "SELECT o_orderpriority AS label, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM orders GROUP BY 1"


def _split_files(spark, folder):
    """Samples as parquet by split, the manifest of their files, and the manifest read back."""
    path = scratch_path(spark, "splits")
    df = load(spark, folder, "documents").select("doc_id", F.col("lang").alias("split"))
    shards.write_split_parquet(df, f"{path}/samples", 4)
    stored = spark.read.parquet(f"{path}/samples")
    listed = shards.manifest(stored)
    shards.write_manifests(listed, f"{path}/manifests")
    back = spark.read.text(f"{path}/manifests").withColumnRenamed("value", "path")
    files = stored.select("doc_id", "split", F.col("_metadata.file_path").alias("path"))
    return files.join(back, ["split", "path"]).groupBy("split").agg(F.count(F.lit(1)).alias("samples"), F.sum("doc_id").alias("ids"))


QUERIES["split_manifests"] = _split_files
SQL["split_manifests"] = "SELECT lang AS split, count(*) AS samples, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1"


def _metrics_file(spark, folder):
    path = scratch_path(spark, "metrics")
    df = load(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    evaluate.write_metrics(df, path)
    return spark.read.schema("metric string, value bigint").option("header", True).csv(path)


QUERIES["metrics_file"] = _metrics_file
SQL["metrics_file"] = "SELECT o_orderstatus AS metric, count(*) AS value FROM orders GROUP BY 1"


def _metadata_files(spark, folder):
    """A folder per region with a description and one unrelated file."""
    path = scratch_path(spark, "metadata")
    nations = load(spark, folder, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "\n").alias("body"))
    fs, root = filesystem(path)
    for r in nations.toLocalIterator():
        fs.create_dir(f"{root}/r{r['n_regionkey']}", recursive=True)
        for name, body in (("description.txt", r["body"]), ("features.json", "[]"), ("other.md", "no")):
            with fs.open_output_stream(f"{root}/r{r['n_regionkey']}/{name}") as out:
                out.write(body.encode())
    return metadata.read_metadata(spark, path)


QUERIES["metadata_files"] = _metadata_files
SQL["metadata_files"] = (
    "SELECT 'r' || n_regionkey AS task, 0 AS ord, 'description' AS key, 'Description of the dataset' AS description, string_agg(n_name, chr(10) ORDER BY n_name) AS body "
    "FROM nation GROUP BY n_regionkey UNION ALL SELECT DISTINCT 'r' || n_regionkey, 5, 'features', 'Features listed by the dataset''s site', '[]' FROM nation"
)


def _shuffled(spark, folder):
    """Place of every row after the shuffle."""
    out = sampling.shuffle_rows(load(spark, folder, "supplier").select("s_suppkey"), ["s_suppkey"], 3).withColumn("id", F.monotonically_increasing_id())
    return out.select("s_suppkey", (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("place"))


QUERIES["shuffle_rows_place"] = _shuffled
SQL["shuffle_rows_place"] = f"SELECT s_suppkey, row_number() OVER (ORDER BY {digest(3, 's_suppkey::VARCHAR')}, s_suppkey) - 1 AS place FROM supplier"
