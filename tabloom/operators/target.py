"""Drawing a target column, binning numeric targets, choice lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.config import TargetConfig
from tabloom.functions import hashing, text
from tabloom.operators.ordering import broadcast_if_small, join_null_safe, position
from tabloom.operators.quantiles import even_quantiles

# Bytes of choice lists that may be broadcast, after summing them.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Distinct labels of a table that are carried as one array.
INLINE_LABELS = 1000


# --- target column ---------------------------------------------------------------------------

def weighted_draw(df: DataFrame, group: str, weight: str, order: list[str], seed) -> DataFrame:
    """One row per group, drawn in proportion to ``weight`` (inverse CDF over ``order``).

    Groups are the columns of one table, so a window per group is small by nature.
    """
    by = Window.partitionBy(group)
    run = by.orderBy(*order)
    cum = F.sum(weight).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = hashing.uniform(seed, "target", F.col(group)) * F.sum(weight).over(by)
    marked = df.withColumn("__rest", cum > u).withColumn("__rn", F.row_number().over(run))
    last = F.max("__rn").over(by)
    pick = F.coalesce(F.min(F.when(F.col("__rest"), F.col("__rn"))).over(by), last)
    return marked.withColumn("__pick", pick).where("__rn = __pick").drop("__rest", "__rn", "__pick")


def draw_target(candidates: DataFrame, config: TargetConfig = TargetConfig(), seed=0) -> DataFrame:
    """(table_id, target, all_numeric): numeric columns share ``p_numeric`` of the probability."""
    ok = candidates.where("is_candidate")
    by = Window.partitionBy("table_id")
    n_num = F.sum(F.col("all_numeric").cast("int")).over(by)
    n_all = F.count(F.lit(1)).over(by)
    p = F.lit(float(config.p_numeric))
    w = (
        F.when((n_num == 0) | (n_num == n_all), 1.0 / n_all)
        .when(F.col("all_numeric"), p / n_num)
        .otherwise((F.lit(1.0) - p) / (n_all - n_num))
    )
    drawn = weighted_draw(ok.withColumn("p", w), "table_id", "p", ["ordinal"], seed)
    return drawn.select("table_id", F.col("column").alias("target"), "all_numeric", "p")


def select_by_score(scores: DataFrame, config: TargetConfig, seed=0) -> DataFrame:
    """Target from a score per (table_id, column): best, drawn among the best k, or tempered draw."""
    if config.selection == "max":
        best = scores.groupBy("table_id").agg(F.min(F.struct(-F.col("score"), F.col("column"))).alias("b"))
        return best.select("table_id", F.col("b.column").alias("target"))
    if config.selection == "topk":
        rank = F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("score"), "column"))
        pool = scores.withColumn("__k", rank).where(F.col("__k") <= config.k).drop("__k")
        pool = pool.withColumn("w", F.col("score"))
    elif config.selection == "temperature":
        pool = scores.withColumn("w", F.pow(F.col("score"), F.lit(1.0 / config.temperature)))
    else:
        raise ValueError(f"unknown selection: {config.selection}")
    drawn = weighted_draw(pool, "table_id", "w", ["column"], seed)
    return drawn.select("table_id", F.col("column").alias("target"))


# --- binning ---------------------------------------------------------------------------------

def num_buckets(table: Column, config: TargetConfig, seed=0) -> Column:
    n = config.max_buckets - config.min_buckets + 1
    return (F.lit(config.min_buckets) + hashing.below(F.lit(n), seed, "buckets", table)).cast("int")


def fit_thresholds(df: DataFrame, group: list[str], value: str, buckets) -> DataFrame:
    """(group, thresholds): the inner quantiles i/buckets of each group, at least one."""
    q = even_quantiles(df, group, value, buckets)
    if isinstance(buckets, int) and buckets < 2:
        raise ValueError("at least two buckets are needed")
    q = q.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("i", "quantile"))).alias("q"))
    inner = F.expr("slice(q.quantile, 2, size(q) - 2)")
    return q.select(*group, inner.alias("thresholds"))


def bucket_label(value: Column, thresholds: Column) -> Column:
    """Text of the bucket a value falls in; missing values land in the last one."""
    v = value.cast("double")
    shown = F.transform(thresholds, text.py_float)
    above = F.size(F.filter(thresholds, lambda t: ~F.coalesce((v < t) & ~F.isnan(v), F.lit(False))))
    n = F.size(thresholds)
    # Thresholds ascend, so counting those not above the value finds the first one above it.
    return (
        F.when(above >= n, F.concat(F.lit("greater than "), F.element_at(shown, -1)))
        .when(above == 0, F.concat(F.lit("less than "), F.get(shown, F.lit(0))))
        .otherwise(
            F.concat(F.lit("between "), F.get(shown, above - 1), F.lit(" and "), F.get(shown, above))
        )
    )


def bucket_label_fixed(value: Column, thresholds: list[float]) -> Column:
    """Same as :func:`bucket_label` for thresholds known on the driver: a plain CASE, no arrays."""
    v = value.cast("double")
    ok = ~F.isnan(v)
    shown = [repr(float(t)) for t in thresholds]
    label = F.lit(f"greater than {shown[-1]}")
    for i in reversed(range(len(thresholds))):
        name = f"less than {shown[0]}" if i == 0 else f"between {shown[i - 1]} and {shown[i]}"
        label = F.when(ok & (v < float(thresholds[i])), F.lit(name)).otherwise(label)
    return label


def discretize(df: DataFrame, value: str, buckets: int = 4, out: str | None = None) -> DataFrame:
    """Replaces a numeric column by its bucket label. The few thresholds travel as literals."""
    row = fit_thresholds(df, [], value, buckets).first()
    if row is None:
        return df.withColumn(out or value, F.lit(None).cast("string"))
    return df.withColumn(out or value, bucket_label_fixed(F.col(value), list(row["thresholds"])))


# --- choices ---------------------------------------------------------------------------------

def distinct_draws(n: Column, k: int, seed, *keys) -> Column:
    """``k`` (or n, if that is less) different whole numbers in [0, n) in random order.

    Draw j is taken among the n - j numbers still free and moved up past the taken ones.
    """

    def step(taken, j):
        r = F.floor(hashing.uniform(seed, *keys, j) * (n - j)).cast("long")
        free = F.aggregate(F.array_sort(taken), r, lambda p, c: F.when(c <= p, p + 1).otherwise(p))
        return F.concat(taken, F.array(free))

    last = (F.least(F.lit(k).cast("long"), n) - 1).cast("int")
    return F.aggregate(F.sequence(F.lit(0), last), F.expr("cast(array() as array<bigint>)"), step)


def label_domain(df: DataFrame, group: list[str], label: str, bound: int | None = None) -> DataFrame:
    """Distinct labels of each group with their index and the domain size."""
    return position(df.select(*group, label).distinct(), group, [label], out="idx", total="m", bound=bound)


def with_choices(
    df: DataFrame,
    group: list[str],
    label: str,
    row_keys: list[str],
    seed=0,
    max_choices: int = 8,
    inline: int = INLINE_LABELS,
    labels_from: DataFrame | None = None,
) -> DataFrame:
    """Adds ``choices``: all labels of the group, or the true label and random others.

    ``max_choices`` different positions are drawn; the true label is struck out if it came up.
    Rows therefore never need the index of their own label, and a label that fills a third of a
    table causes no skewed join. Domains of up to ``inline`` labels travel as one array per group;
    larger ones are looked up by (group, position), which spreads evenly. ``labels_from`` may give
    the labels of the same rows from a cheaper scan.
    """
    source = df if labels_from is None else labels_from
    distinct = source.select(*group, label).distinct()
    sizes = distinct.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__m"), F.sum(F.length(label) + 16).alias("__bytes")
    )
    # One pass over the label column decides how the domains travel.
    is_small = F.col("__m") <= inline
    stat = sizes.agg(
        F.coalesce(F.max("__m"), F.lit(0)).alias("m"),
        F.coalesce(F.sum(F.when(is_small, F.col("__bytes"))), F.lit(0)).alias("b"),
        F.count_if(is_small).alias("small"),
        F.count_if(~is_small).alias("big"),
    ).first()
    if not group and stat["b"] > MAX_BROADCAST_BYTES and inline > 0:
        # Few but huge labels: looked up by position instead of carried along.
        return with_choices(df, group, label, row_keys, seed, max_choices, 0, labels_from)
    draws = distinct_draws(F.col("__m"), max_choices, seed, "choices", *[F.col(k) for k in row_keys])

    def finish(values: Column) -> Column:
        others = F.slice(F.filter(values, lambda x: x != F.col(label)), 1, max_choices - 1)
        return F.concat(F.array(F.col(label)), others)

    def join(left, right):
        if group:
            return join_null_safe(left, right, group)
        # A single group has a single row of settings, which travels as literals.
        row = right.first()
        return left.withColumns({c: F.lit(row[c]) for c in right.columns})

    parts = []
    if stat["small"]:
        values = distinct
        if stat["big"]:
            keep = broadcast_if_small(sizes.where(is_small).select(*group), stat["small"])
            values = join(distinct, keep) if group else distinct
        small = values.groupBy(*group).agg(F.sort_array(F.collect_list(label)).alias("__values"))
        if stat["b"] <= MAX_BROADCAST_BYTES:
            small = F.broadcast(small)
        if stat["m"] <= max_choices:
            chosen = F.col("__values")
        else:
            picked = F.transform(draws, lambda i: F.get(F.col("__values"), i.cast("int")))
            chosen = F.when(F.col("__m") <= max_choices, F.col("__values")).otherwise(finish(picked))
        rows = join(df, small).withColumn("__m", F.size("__values").cast("long"))
        parts.append(rows.withColumn("choices", chosen).drop("__values", "__m"))
    if stat["big"]:
        domain = label_domain(source, group, label, bound=stat["m"])
        big = broadcast_if_small(sizes.where(~is_small).select(*group, "__m"), stat["big"])
        rows = join(df, big)
        wanted = rows.select(*group, *row_keys, F.posexplode(draws).alias("__j", "idx"))
        found = join_null_safe(wanted, domain.select(*group, "idx", F.col(label).alias("__v")), [*group, "idx"])
        lists = found.groupBy(*group, *row_keys).agg(
            F.sort_array(F.collect_list(F.struct("__j", "__v"))).alias("__l")
        )
        parts.append(
            join_null_safe(rows, lists, [*group, *row_keys])
            .withColumn("choices", F.when(F.col("__m") <= max_choices, F.array_sort("__l.__v")).otherwise(finish(F.col("__l.__v"))))
            .drop("__l", "__m")
        )
    out = parts[0] if parts else df.withColumn("choices", F.array(F.col(label)))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
