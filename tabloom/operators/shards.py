"""Output shards: size-bounded binning, chunks of input files, keys, manifests."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ordering import position


def sample_key(table: Column, row: Column) -> Column:
    """``<table>__<row>``: samples of one table share the part before the last double underscore."""
    return F.concat(table, F.lit("__"), row.cast("string"))


def table_of_key(key: Column) -> Column:
    row = F.length(F.substring_index(key, "__", -1))
    return F.when(F.contains(key, F.lit("__")), F.substring(key, F.lit(1), F.length(key) - row - 2)).otherwise(key)


def shard_by_size(df: DataFrame, order: list, size: str, target_bytes: int, group: list[str] | None = None) -> DataFrame:
    """Adds ``shard``: rows in order, a new shard for every ``target_bytes`` of running size."""
    placed = position(df, group or [], order, out="__cum", weight=size)
    end = F.col("__cum") + F.col(size)
    shard = F.floor((F.greatest(end, F.lit(1)) - 1) / F.lit(target_bytes)).cast("long")
    return placed.withColumn("shard", shard).drop("__cum")


def shard_lookup(placed: DataFrame, order: list[str], group: str) -> tuple[Column, dict[str, int]]:
    """(``shard`` of a row by its ``group`` and ``order``, last shard of each group) for rows that were placed without their contents.

    ``order`` must be total, and lists no floats. One row a shard comes to the driver, its first one.
    """
    firsts: dict[str, tuple[list, list]] = {}
    for r in sorted(placed.groupBy(group, "shard").agg(F.min(F.struct(*order)).alias("first")).collect(), key=lambda r: r["shard"]):
        keys, numbers = firsts.setdefault(r[group], ([], []))
        keys.append(tuple(map(_rank, r["first"])))
        numbers.append(r["shard"])
    shared = placed.sparkSession.sparkContext.broadcast(firsts)

    @F.arrow_udf("long")
    def find(groups: pa.Array, *columns: pa.Array) -> pa.Array:
        found = []
        for g, *row in zip(groups.to_pylist(), *(c.to_pylist() for c in columns), strict=True):
            keys, numbers = shared.value[g]
            found.append(numbers[bisect_right(keys, tuple(map(_rank, row))) - 1])
        return pa.array(found, pa.int64())

    return find(group, *order), {g: numbers[-1] for g, (_, numbers) in firsts.items()}


def _rank(value) -> tuple:
    """Nulls come first, as in Spark."""
    return value is not None, value


def file_chunks(files: DataFrame, path: str = "path", chunk_size: int = 64) -> DataFrame:
    """Adds ``chunk``: consecutive runs of ``chunk_size`` files in path order."""
    placed = position(files, [], [path], out="__pos")
    return placed.withColumn("chunk", F.floor(F.col("__pos") / F.lit(chunk_size)).cast("long")).drop("__pos")


def shard_name(shard: Column, prefix: str = "", extension: str = ".tar") -> Column:
    name = F.concat(F.lpad(shard.cast("string"), 6, "0"), F.lit(extension))
    return F.concat(F.lit(prefix + "-"), name) if prefix else name


def write_split_parquet(df: DataFrame, path: str, partitions: int | None = None, max_records: int = 0) -> None:
    """Samples as parquet, one folder per split. Rows are dealt evenly, not by split: a split that
    holds most rows is written by many tasks."""
    out = df.repartition(partitions) if partitions else df
    w = out.write.mode("errorifexists").partitionBy("split")
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    w.parquet(path)


def write_manifests(files: DataFrame, path: str) -> None:
    """``<path>/<split>-files.txt``-style manifests: one folder per split with one path per line."""
    files.select("split", F.col("path").alias("value")).distinct().repartitionByRange("split", "value").sortWithinPartitions(
        "split", "value"
    ).write.mode("overwrite").partitionBy("split").text(path)


def manifest(df: DataFrame) -> DataFrame:
    """(split, path) of the files a stored sample table was read from."""
    return df.select("split", F.col("_metadata.file_path").alias("path")).distinct()
