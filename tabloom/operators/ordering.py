"""Positions and running totals inside groups of any size.

``row_number() over (partition by g)`` puts a whole group into one task. A group may hold a third
of all rows here, so positions are computed in two parts: an offset per chunk of the group and a
position inside the chunk. Both functions are exact; only the way the group is cut differs.

* :func:`hash_position` orders a group by a hash. The leading hash digits cut it into even
  chunks, known without looking at the data.
* :func:`position` orders a group by its own columns. Where the largest group is small (counted,
  not guessed) a plain window does it; otherwise the rows are range-partitioned once, written to
  the shared checkpoint folder, and numbered there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import hashing
from tabloom.session import conf_int, cut_lineage

# Rows of one group that one task may sort; beyond that a group is cut into chunks.
MAX_GROUP_ROWS = 100_000
# Rows of a lookup that may be broadcast, after counting it.
MAX_BROADCAST_ROWS = 500_000


def max_group_rows(df: DataFrame) -> int:
    return conf_int(df.sparkSession, "maxGroupRows", MAX_GROUP_ROWS)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint behind a counted size; otherwise the join is left to shuffle."""
    return F.broadcast(df) if rows <= conf_int(df.sparkSession, "maxBroadcastRows", MAX_BROADCAST_ROWS) else df


def largest_group(df: DataFrame, group: list[str]) -> int:
    """Rows in the largest group. Reads only the group columns, combines map-side."""
    counted = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _rename_group(df: DataFrame, group: list[str], tag: str) -> DataFrame:
    for g in group:
        df = df.withColumnRenamed(g, f"{tag}{g}")
    return df


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; the right keys are dropped."""
    r = _rename_group(right, keys, "__r_")
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(r[f"__r_{k}"])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def hash_position(
    df: DataFrame,
    group: list[str],
    seed,
    keys: list[str],
    out: str = "pos",
    total: str | None = None,
    chunk_digits: int = 3,
) -> DataFrame:
    """Position (from 0) of each row in its group under a seeded pseudo-random order.

    ``keys`` identify a row inside its group. The rows shuffle once, by (group, chunk).
    """
    h, chunk = "__h", "__chunk"
    keyed = df.withColumn(h, hashing.digest(seed, *[F.col(k) for k in keys]))
    keyed = keyed.withColumn(chunk, F.substring(h, 1, chunk_digits))
    counts = keyed.groupBy(*group, chunk).agg(F.count(F.lit(1)).alias("__n"))
    by_group = Window.partitionBy(*group)
    before = by_group.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group,
        chunk,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        F.sum("__n").over(by_group).alias("__total"),
    )
    w = Window.partitionBy(*group, chunk).orderBy(h, *keys)
    placed = join_null_safe(keyed, offsets, [*group, chunk])
    placed = placed.withColumn(out, F.col("__off") + F.row_number().over(w) - 1)
    if total:
        placed = placed.withColumn(total, F.col("__total"))
    return placed.drop(h, chunk, "__off", "__total")


def position(
    df: DataFrame,
    group: list[str],
    order: list,
    out: str = "pos",
    total: str | None = None,
    weight: str | None = None,
    limit: int | None = None,
    bound: int | None = None,
) -> DataFrame:
    """Running total of ``weight`` (1 if not given) over the rows *before* each row of its group.

    ``order`` must be total inside a group for repeatable results. ``total`` names a column for
    the group's whole weight. ``limit`` overrides the largest group a single task may sort;
    ``bound`` is a known upper bound of the largest group, which saves counting when it is small.
    """
    limit = max_group_rows(df) if limit is None else limit
    if (bound is not None and bound <= limit) or largest_group(df, group) <= limit:
        return _window_position(df, group, order, out, total, weight)
    return _range_position(df, group, order, out, total, weight)


def _weight(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1).cast("long")


def _window_position(df, group, order, out, total, weight):
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    w = by.orderBy(*order)
    if weight:
        cum = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        cum = F.row_number().over(w) - F.lit(1)
    res = df.withColumn(out, cum.cast("long") if not weight else cum)
    if total:
        res = res.withColumn(total, F.sum(_weight(weight)).over(by))
    return res


def _range_position(df, group, order, out, total, weight):
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    laid = (
        df.repartitionByRange(parts, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("__row", F.monotonically_increasing_id())
    )
    # The range bounds come from a sample, so they are frozen before the rows are read twice.
    laid = cut_lineage(laid).withColumn("__part", F.shiftright("__row", 33))
    chunks = laid.groupBy(*group, "__part").agg(
        F.min("__row").alias("__first"), F.sum(_weight(weight)).alias("__w")
    )
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(
        chunks.select(
            *group,
            "__part",
            "__first",
            F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__off"),
            F.sum("__w").over(by).alias("__total"),
        )
    )
    offsets = broadcast_if_small(offsets, offsets.count())
    placed = join_null_safe(laid, offsets, [*group, "__part"])
    if weight:
        w = Window.partitionBy(*group, "__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(weight).over(w), F.lit(0))
    else:
        inside = F.col("__row") - F.col("__first")
    placed = placed.withColumn(out, F.col("__off") + inside)
    if total:
        placed = placed.withColumn(total, F.col("__total"))
    return placed.drop("__row", "__part", "__first", "__off", "__total")
