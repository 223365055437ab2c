"""Metadata files of datasets (variables, JSON, descriptions) as metadata elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File name pattern -> (order, key, description).
KINDS = (
    (r"^variables.*\.csv$", 3, "features", "Variables of the dataset"),
    (r"^metadata_.*\.json$", 4, "metadata", "Metadata of the dataset's site"),
    (r"^description\.txt$", 0, "description", "Description of the dataset"),
    (r"^features\.json$", 5, "features", "Features listed by the dataset's site"),
)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(task, ord, key, description, body); the task is the folder a file lies in."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    task = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    ord_, key, desc = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, o, k, d in KINDS:
        hit = F.regexp_like(name, F.lit(pattern))
        ord_, key, desc = F.when(hit, o).otherwise(ord_), F.when(hit, k).otherwise(key), F.when(hit, d).otherwise(desc)
    out = files.select(task.alias("task"), ord_.alias("ord"), key.alias("key"), desc.alias("description"), F.col("value").alias("body"))
    return out.where("key is not null")
