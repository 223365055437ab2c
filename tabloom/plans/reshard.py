"""Shards of another size from the shards of a folder.

Samples are never decoded: a scan of the member headers makes a narrow table of byte ranges, running
totals say which new shard a range belongs to, and the tasks that write the new shards copy the ranges.
The totals need no sorting: a sample knows what lies before it in its shard, and the shards are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.ordering import broadcast_if_small, position
from tabloom.session import scratch_path
from tabloom.sources import tar
from tabloom.sources.commit import shard_files
from tabloom.sources.files import filesystem


def plan_shards(index: DataFrame, target_bytes: int) -> DataFrame:
    """Adds ``shard``: samples in the order of shard names and places, a new shard for every ``target_bytes``."""
    totals = index.groupBy("name").agg(F.max(F.col("before") + F.col("length")).alias("held"))
    n = totals.count()
    starts = position(totals, [], ["name"], out="start", weight="held", bound=n).drop("held")
    ends = F.col("start") + F.col("before") + F.col("length")
    shard = F.floor((F.greatest(ends, F.lit(1)) - 1) / F.lit(target_bytes)).cast("int")
    return index.join(broadcast_if_small(starts, n), "name").withColumn("shard", shard).drop("start")


def reshard(spark: SparkSession, source: str, target_bytes: int, prefix: str = "", output: str | None = None, layout: str = "rename") -> DataFrame:
    """Writes the samples of all shards below ``source`` as shards of about ``target_bytes``; returns (path, bytes).

    Without ``output`` the new shards take the place of the old ones, all at once. Every member comes out
    byte for byte, samples in the order of shard names and of their places; a sample whose files have one
    key stays together. A shard ends with the last sample that ends inside its share of the bytes; one
    sample that is larger than that makes a shard of its own. A damaged shard is an error, and nothing changes.
    """
    path = scratch_path(spark, "tar-index")
    tar.read_index(spark, source).write.parquet(path)
    planned = plan_shards(spark.read.parquet(path), target_bytes)
    # Numbers without samples (a sample larger than a shard skips some) would make empty partitions.
    used = planned.select("shard").distinct()
    n = used.count()
    dense = position(used, [], ["shard"], out="number", bound=n)
    ranges = planned.join(broadcast_if_small(dense, n), "shard")
    laid = ranges.repartitionById(max(1, n), F.col("number").cast("int")).sortWithinPartitions("name", "offset")
    tar.write_ranges(laid.select("key", "path", "name", "offset", "length"), source, output or source, prefix, overwrite=True, layout=layout)
    return spark.createDataFrame([(name, size) for _, size, name in shard_files(output or source)], "path string, bytes long")


def reshard_folders(spark: SparkSession, root: str, target_bytes: int, prefix: str = "", layout: str = "rename") -> list[str]:
    """Reshards every folder directly below ``root`` that holds shards (one per split); returns their names."""
    fs, inner = filesystem(root)
    inner = inner.rstrip("/")
    splits = sorted({name[len(inner) + 1 :].partition("/")[0] for _, _, name in shard_files(root) if "/" in name[len(inner) + 1 :]})
    for split in splits:
        reshard(spark, f"{root.rstrip('/')}/{split}", target_bytes, "-".join(x for x in (prefix, split) if x), layout=layout)
    return splits
