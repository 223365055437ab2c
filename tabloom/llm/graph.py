"""Connected components of graphs that need not fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (columns a, b): the smallest node reachable.

    Alternates two steps until every node hangs directly below the smallest of its component. The
    large step hangs each node's larger neighbours below its smallest neighbour, the small step its
    smaller ones. Each is one aggregation and one join on a list that never gets longer than the
    edges plus the nodes; rounds grow with the logarithm of the longest chain. Every round is
    written to the shared folder. Loops and rows with nulls are ignored.
    """
    e = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    before = None
    while True:
        least = e.groupBy("hi").agg(F.min("lo").alias("least"))
        large = e.join(least.withColumnRenamed("hi", "lo"), "lo", "left").select("hi", F.coalesce("least", "lo").alias("lo"))
        large = large.distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        below = large.join(least, "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        e = cut_lineage(below.unionByName(least.withColumnRenamed("least", "lo")).distinct())
        n, total = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            break
        before = (n, total)
    roots = e.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
