"""Splits, shuffles, limits, interleaving."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import hashing
from tabloom.operators.ordering import join_null_safe, broadcast_if_small, hash_position, position


def share_count(n: Column, share: str) -> Column:
    """ceil(share * n) in whole-number arithmetic; ``share`` is decimal text such as "0.025"."""
    f = Fraction(share)
    return F.floor((n * F.lit(f.numerator) + F.lit(f.denominator - 1)) / F.lit(f.denominator)).cast("long")


def _complement(share: str) -> str:
    return str(1 - Fraction(share))


def split_by_rank(
    df: DataFrame, keys: list[str], share: str, seed, group: list[str] | None = None,
    first: str = "test", rest: str = "train", out: str = "split",
) -> DataFrame:
    """Exact split: the ceil(share * n) rows of each group that come first in hashed order.

    A group with a single row stays whole.
    """
    placed = hash_position(df, group or [], seed, keys, out="__pos", total="__n")
    cut = F.when(F.col("__n") > 1, share_count(F.col("__n"), share)).otherwise(F.lit(0))
    return placed.withColumn(out, F.when(F.col("__pos") < cut, F.lit(first)).otherwise(F.lit(rest))).drop("__pos", "__n")


def split_tables(tables: DataFrame, table: str = "table_id", train_frac: str = "0.975", seed=42) -> DataFrame:
    """Whole tables to train or test."""
    return split_by_rank(tables, [table], _complement(train_frac), seed)


def split_rows(
    df: DataFrame, table: str, row_keys: list[str], chunk: Column, frac: str = "0.01", seed=42, exact: bool = True
) -> DataFrame:
    """``train`` / ``traineval``: a chunk of files takes part with probability ``frac``; of its
    tables, ``frac`` of the rows move (exact count per table, or by threshold for streams)."""
    chosen = hashing.chance(float(Fraction(frac)), seed, "chunk", chunk)
    if exact:
        # Rows of the other chunks are read once more instead of being ranked and shuffled.
        moved = split_by_rank(df.where(chosen), row_keys, frac, seed, [table], "traineval", "train")
        return df.where(~chosen).withColumn("split", F.lit("train")).unionByName(moved)
    low = hashing.chance(float(Fraction(frac)), seed, *[F.col(k) for k in [table, *row_keys]])
    return df.withColumn("split", F.when(chosen & low, F.lit("traineval")).otherwise(F.lit("train")))


def split_iid(
    df: DataFrame, row_keys: list[str], seed=0, shares=(("train", 0.8), ("validation", 0.1), ("test", 0.1))
) -> DataFrame:
    """Independent random split by threshold: needs no shuffle and runs on streams."""
    edge, label = 0.0, None
    for name, share in shares[:-1]:
        edge += share
        cond = hashing.chance(edge, seed, "split", *[F.col(k) for k in row_keys])
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    last = F.lit(shares[-1][0])
    return df.withColumn("split", label.otherwise(last) if label is not None else last)


def shuffle_rows(df: DataFrame, keys: list[str], seed=0) -> DataFrame:
    """Full shuffle in a repeatable order (a range-partitioned sort by hash)."""
    return df.orderBy(hashing.digest(seed, *[F.col(k) for k in keys]), *keys)


def shuffle_buffered(df: DataFrame, keys: list[str], seed=0, partitions: int | None = None) -> DataFrame:
    """Cheap shuffle: rows are dealt to partitions by hash and sorted by hash inside each."""
    h = hashing.digest(seed, *[F.col(k) for k in keys])
    spread = df.withColumn("__h", h)
    spread = spread.repartition(partitions, "__h") if partitions else spread.repartition("__h")
    return spread.sortWithinPartitions("__h", *keys).drop("__h")


def first_rows(df: DataFrame, n: int, order: list, group: list[str] | None = None, num_shots: int = 0) -> DataFrame:
    """First ``n`` rows (times shots + 1) of each group in ``order``."""
    n = n * (num_shots + 1) if num_shots else n
    if not group:
        return df.orderBy(*order).limit(n)
    return position(df, group, order, out="__pos").where(F.col("__pos") < n).drop("__pos")


def interleave(sources: list[DataFrame], order: list[list]) -> DataFrame:
    """Round-robin over the sources until the longest is used up; shorter ones start again.

    Adds ``turn`` and ``source``; sort by them for the sequence. The sources share a schema. A
    source shorter than the longest is repeated by position: turn t takes row t modulo its
    length. Turns are made in parallel, so no task emits all repeats of a short source, and a
    short source is broadcast while a long one meets each turn a bounded number of times.
    """
    placed, sizes = [], []
    for df, o in zip(sources, order):
        p = position(df, [], o, out="__pos")
        placed.append(p)
        sizes.append(df.count())
    longest = max(sizes)
    out = None
    for i, (p, n) in enumerate(zip(placed, sizes)):
        if n == 0:
            continue
        if n == longest:
            part = p.withColumn("turn", F.col("__pos")).drop("__pos")
        else:
            turns = p.sparkSession.range(longest).select(
                F.col("id").alias("turn"), F.pmod(F.col("id"), F.lit(n)).alias("__pos")
            )
            part = turns.join(broadcast_if_small(p, n), "__pos").drop("__pos")
        part = part.withColumn("source", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def concat_splits(splits: dict[str, DataFrame], column: str = "split") -> DataFrame:
    """All splits in one table with the split's name."""
    out = None
    for name, df in splits.items():
        df = df.withColumn(column, F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def resolve_names(catalog: DataFrame, name: str, patterns: list[str], exclude: list[str] | None = None) -> DataFrame:
    """Catalog entries matched by any pattern (``*`` matches anything, anchored at the start), minus
    exclusions, without duplicates. Plain names must match in full."""
    cond = F.lit(False)
    for p in patterns:
        if "*" in p:
            cond = cond | F.regexp_like(F.col(name), F.lit("^" + p.replace("*", ".*")))
        else:
            cond = cond | (F.col(name) == p)
    out = catalog.where(cond).select(name).distinct()
    return out.where(~F.col(name).isin(list(exclude))) if exclude else out


def resolve_names_by_table(catalog: DataFrame, name: str, patterns: DataFrame, exclude: DataFrame) -> DataFrame:
    """Same with any number of patterns and exclusions as tables (columns ``pattern`` / ``name``).

    Plain names are looked up. A pattern is found by what stands before its first ``*``: every name is
    cut at the lengths that such beginnings have, and its pieces are looked up, so that it meets only
    patterns that begin like it. All characters but ``*`` stand for themselves. Nulls match nothing.
    """
    names = catalog.select(name).where(F.col(name).isNotNull()).distinct()
    listed = patterns.select("pattern").where(F.col("pattern").isNotNull()).distinct()
    star = F.contains("pattern", F.lit("*"))
    plain = listed.where(~star).select(F.col("pattern").alias(name))
    like = F.col("pattern")
    for old, new in (("\\", "\\\\"), ("%", "\\%"), ("_", "\\_"), ("*", "%")):
        like = F.replace(like, F.lit(old), F.lit(new))
    wild = listed.where(star).select(F.substring_index("pattern", "*", 1).alias("__begin"), F.concat(like, F.lit("%")).alias("__like"))
    # As many numbers as the longest pattern has characters.
    lengths = [r[0] for r in wild.select(F.length("__begin")).distinct().collect()]
    found = names.join(broadcast_if_small(plain, plain.count()), name, "left_semi")
    if lengths:
        cuts = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length(name))
        pieces = names.select(name, F.explode(cuts).alias("__n")).select(name, F.expr(f"substring(`{name}`, 1, __n)").alias("__begin"))
        met = pieces.join(broadcast_if_small(wild, wild.count()), "__begin").where(F.like(F.col(name), F.col("__like")))
        found = found.unionByName(met.select(name)).distinct()
    return found.join(exclude.select(F.col("name").alias(name)), name, "left_anti")


def read_names(spark: SparkSession, names: str) -> DataFrame:
    """(pattern) of a list as it is given to a run: names and patterns with commas between them, or a .txt file with one per line.

    Quotes around a list, blanks around names and empty names do not count.
    """
    if names.strip("'\" ").endswith(".txt"):
        lines = spark.read.text(names.strip("'\" "))
    else:
        lines = spark.createDataFrame([(n,) for n in names.replace("'", "").replace('"', "").split(",")], "value string")
    return lines.select(F.btrim("value").alias("pattern")).where("pattern <> ''")
