"""Quantile and standardized value of numeric columns, shown next to the raw value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import text
from tabloom.operators.ordering import broadcast_if_small, join_null_safe
from tabloom.session import cut_lineage
from tabloom.operators.quantiles import even_quantiles, value_ranks

GRID_POINTS = 1000


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if text.is_number(f.dataType)]


def round_like_numpy(c: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def scaled(df: DataFrame, columns: list[str], digits: int = 2, group: list[str] | None = None) -> DataFrame:
    """Adds ``<column>__scale`` = (x - mean) / population deviation; a zero deviation counts as 1."""
    group = group or []
    aggs = []
    for c in columns:
        x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        aggs += [F.avg(x).alias(f"__mean_{c}"), F.stddev_pop(x).alias(f"__std_{c}")]
    if not group:
        row = df.agg(*aggs).first()
        mean = {c: F.lit(row[f"__mean_{c}"]) for c in columns}
        std = {c: F.lit(row[f"__std_{c}"] or 1.0) for c in columns}
    else:
        stats = cut_lineage(df.groupBy(*group).agg(*aggs))  # counted here and joined below
        df = join_null_safe(df, broadcast_if_small(stats, stats.count()), group)
        mean = {c: F.col(f"__mean_{c}") for c in columns}
        std = {c: F.when(F.col(f"__std_{c}") == 0, 1.0).otherwise(F.col(f"__std_{c}")) for c in columns}
    for c in columns:
        z = (F.col(c).cast("double") - mean[c]) / std[c]
        df = df.withColumn(f"{c}__scale", round_like_numpy(z, digits))
    return df.drop(*[f"__mean_{c}" for c in columns], *[f"__std_{c}" for c in columns])


def cumulative_steps(df: DataFrame, columns: list[str], digits: int = 2, group: list[str] | None = None) -> DataFrame:
    """The empirical distribution of many columns, one row (group, column, tops, quantiles) each.

    All columns are ranked together: their distinct values are numbered once, within (group, column).
    A quantile of ``digits`` digits has 10^digits + 1 values at most and never falls from one value to the
    next, so a column is as many steps: the largest value of each (``tops``) and its quantile. Missing
    values take no part.
    """
    group = group or []
    cells = [x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("double"))]
    long = df.select(*group, F.stack(F.lit(len(columns)), *cells).alias("__column", "__value"))
    r = value_ranks(long, [*group, "__column"], "__value")
    last = F.greatest(F.col("n") - 1, F.lit(1)).cast("double")
    mid = (F.lit(2) * F.col("before") + F.col("cnt") - 1) / (F.lit(2.0) * last)
    q = F.when(F.col("before") == 0, 0.0).when(F.col("before") + F.col("cnt") == F.col("n"), 1.0).otherwise(mid)
    steps = r.select(*group, "__column", "__value", round_like_numpy(q, digits).alias("__q"))
    steps = steps.groupBy(*group, "__column", "__q").agg(F.max("__value").alias("__top"))
    listed = steps.groupBy(*group, "__column").agg(F.sort_array(F.collect_list(F.struct("__top", "__q"))).alias("__steps"))
    return listed.select(
        *group, F.col("__column").alias("column"), F.col("__steps")["__top"].alias("tops"), F.col("__steps")["__q"].alias("quantiles")
    )


def step_of(value: Column, tops: Column, quantiles: Column, most: int) -> Column:
    """The quantile of the first step whose top is not below the value; ``most`` steps at most are searched, by halves."""
    halves = F.array(*[F.lit(1 << b) for b in range(max(1, most).bit_length() - 1, -1, -1)])

    def search(at: Column, half: Column) -> Column:
        return at + F.when(F.coalesce(F.get(tops, at + half - 1) < value, F.lit(False)), half).otherwise(0)

    return F.when(value.isNotNull() & ~F.isnan(value), F.get(quantiles, F.aggregate(halves, F.lit(0), search)))


def quantile_by_rank(df: DataFrame, columns: list[str], digits: int = 2, group: list[str] | None = None) -> DataFrame:
    """Adds ``<column>__quantile`` from exact ranks (ties share their mean rank).

    The rows themselves do not move where the steps of :func:`cumulative_steps` are small enough to be
    broadcast: each looks its values up in the steps of its group, so a value that a third of them
    share is no hot key.
    """
    group = group or []
    if not columns:
        return df
    steps = cumulative_steps(df, columns, digits, group)
    most = 10**digits + 1
    if not group:
        found = {r["column"]: r for r in steps.collect()}  # as many numbers as the digits say
        constant = lambda xs: F.split(F.lit(",".join(map(repr, xs))), ",").cast("array<double>")
        made = {
            f"{c}__quantile": step_of(F.col(f"`{c}`").cast("double"), constant(found[c]["tops"]), constant(found[c]["quantiles"]), len(found[c]["tops"]))
            if c in found else F.lit(None).cast("double") for c in columns
        }
        return df.withColumns(made)
    own = lambda c: F.any_value(F.when(F.col("column") == c, F.struct("tops", "quantiles")), ignoreNulls=True)
    names = {c: f"__steps_{i}" for i, c in enumerate(columns)}
    wide = cut_lineage(steps.groupBy(*group).agg(*[own(c).alias(n) for c, n in names.items()]))  # counted here and joined below
    df = join_null_safe(df, broadcast_if_small(wide, wide.count() * most * len(columns)), group, "left")
    made = {f"{c}__quantile": step_of(F.col(f"`{c}`").cast("double"), F.col(n)["tops"], F.col(n)["quantiles"], most) for c, n in names.items()}
    return df.withColumns(made).drop(*names.values())


def quantile_grid(df: DataFrame, columns: list[str], points: int = GRID_POINTS) -> dict[str, list[float]]:
    """At most ``points`` reference quantiles per column: a fixed-size result, kept on the driver."""
    if not columns:
        return {}
    long = df.select(
        F.stack(F.lit(len(columns)), *[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))]).alias("column", "v")
    )
    sizes = long.where("v is not null and not isnan(v)").groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    long = long.join(F.broadcast(sizes), "column")  # one row per column
    long = long.withColumn("parts", F.greatest(F.least(F.col("n"), F.lit(points)) - 1, F.lit(1)))
    rows = even_quantiles(long, ["column"], "v", "parts", whole_ranks=True).collect()
    grids: dict[str, dict[int, float]] = {c: {} for c in columns}
    for r in rows:
        grids[r["column"]][r["i"]] = r["quantile"]
    return {c: [g[i] for i in sorted(g)] for c, g in grids.items()}


def interpolate(c: Column, grid: list[float], digits: int = 2) -> Column:
    """Position of a value on its grid, in [0, 1]. Binary search over 1000 points is the one thing
    built-in functions lack, so it is a vectorized Arrow function."""
    xs = np.asarray(grid, dtype="float64")
    ys = np.linspace(0.0, 1.0, len(xs)) if len(xs) > 1 else np.zeros(len(xs))

    @F.pandas_udf(T.DoubleType())
    def locate(v: pd.Series) -> pd.Series:
        x = v.to_numpy(dtype="float64", na_value=np.nan)
        if not len(xs):
            return pd.Series(np.full(len(x), np.nan))
        up = np.interp(x, xs, ys)
        down = np.interp(-x, -xs[::-1], -ys[::-1])
        y = 0.5 * (up - down)
        y[x == xs[-1]] = 1.0
        y[x == xs[0]] = 0.0
        y[np.isnan(x)] = np.nan
        return pd.Series(np.round(y, digits))

    return locate(c.cast("double"))


def quantile_by_grid(df: DataFrame, columns: list[str], digits: int = 2, points: int = GRID_POINTS) -> DataFrame:
    """Adds ``<column>__quantile`` by interpolation on reference quantiles: two scans, no join."""
    grids = quantile_grid(df, columns, points)
    return df.withColumns({f"{c}__quantile": interpolate(F.col(c), grids[c], digits) for c in columns})
