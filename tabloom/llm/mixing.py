"""Mixing sources to target weights: whole documents that fill each source's budget to the word.

A source gets its share of the whole budget, at most twice what it holds; whole passes over the source
come first. For the rest the documents are counted by their exact length. A proportional part of every
length is taken, and what then remains of the budget (RESERVE words at least) is a bounded knapsack over the lengths that are
left, solved by dynamic programming over the sums that can be reached. The result is a number of
documents per length; a seeded order says which.

Lengths and counts are all that is gathered: one row per source and length, fitted source by source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import fresh, words
from tabloom.operators.ordering import position
from tabloom.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SUMS = 1 << 16  # words of a budget that the knapsack decides; beyond that, the largest documents that fit go in first
RESERVE = 1 << 13  # words of a budget that are left to the knapsack at least
CHUNK_BITS = 8
SEED = "mix"


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (doc_id, source, size, digest): words of each text, and a hash of it; a null text has none."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _size(text).alias("size"), _digest(text).alias("digest"))


def _size(text: str) -> Column:
    return F.when(F.col(text).isNull(), 0).otherwise(F.size(words(F.col(text).cast("string")))).cast("long")


def _digest(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (source, source_size, target): ``weights`` repeat over the sources in order, null last.

    All targets add up to ``share`` of all sizes. None exceeds ``most`` times its source; what is
    over goes to the others by weight until none is above, so a target is the smaller of the
    source's limit and its weight times one common rate.
    """
    held = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = position(held, [], [F.asc_nulls_last("source")], out="rank")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(listed, (F.col("rank") % len(weights)).cast("int")))
    ranked = cut_lineage(ranked.withColumn("limit", F.col("source_size") * float(most)))
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    rate = budget / weight if weight else 0.0
    while True:
        full = F.col("weight") * rate > F.col("limit")
        spent, left = ranked.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not left:
            break
        new = (budget - (spent or 0.0)) / left
        if new <= rate:
            break
        rate = new
    return ranked.select("source", "source_size", F.least(F.col("limit"), F.col("weight") * F.lit(rate)).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each size to take so that their sizes add up to about ``budget``."""
    picks = np.zeros(len(sizes), dtype=np.int64)
    whole = int((sizes * counts).sum())
    if whole <= 0 or budget <= 0:
        return picks
    picks = np.minimum(np.floor(counts * (max(0.0, budget - RESERVE) / whole)).astype(np.int64), counts)
    left = budget - float((picks * sizes).sum())
    for k in np.argsort(-sizes, kind="stable"):
        if left <= SUMS:
            break
        more = min(int(counts[k] - picks[k]), int(left // sizes[k]))
        picks[k] += more
        left -= more * float(sizes[k])
    free = counts - picks
    able = np.flatnonzero(free > 0)
    if not len(able) or left < 0.5:
        return picks
    smallest = int(sizes[able].min())
    # A sum above the budget by the largest document or more is never the nearest.
    most = min(int(left) + int(sizes[able].max()), 4 * SUMS)
    if int(left) + smallest > most:
        # Only documents of more than the window are left: the smallest one, or none.
        if smallest - left < left:
            picks[able[np.argmin(sizes[able])]] += 1
        return picks
    # via[s]: the item with which the sum s was first reached; its other items are all earlier ones.
    via = np.full(most + 1, -1, dtype=np.int64)
    reached = np.zeros(most + 1, dtype=bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    goal = round(left)
    for k in able[np.argsort(-sizes[able], kind="stable")]:
        size, n, some = int(sizes[k]), int(free[k]), 1
        n = min(n, most // size)
        while n > 0 and not reached[goal]:  # n documents as groups of 1, 2, 4, ... of them
            some = min(some, n)
            step = size * some
            if step <= most:
                new = reached[:-step] & ~reached[step:] if step else reached[:0]
                at = np.flatnonzero(new) + step
                via[at] = len(items)
                reached[at] = True
                items.append((int(k), some))
            n -= some
            some *= 2
        if reached[goal]:
            break
    sums = np.flatnonzero(reached)
    s = int(sums[np.argmin(np.abs(sums - left))])
    while s:
        k, some = items[via[s]]
        picks[k] += some
        s -= some * int(sizes[k])
    return picks


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, times, taken (= times * size), digest.

    Null and empty texts have size 0, and a source without words takes none of its documents. A null
    source is a source of its own. Rows that repeat a doc_id are separate documents, told apart by the
    hash of their texts (``digest``); rows with all of that in common are taken in any order. An empty table
    gives an empty one. The same rows and seed give the same result, however they are partitioned.
    """
    sizes = cut_lineage(sized(docs, doc_id, text, source))
    per_source = targets(sizes, weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    plan = per_source.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = cut_lineage(plan.withColumn("key", _key("source")))

    counted = sizes.where("size > 0").groupBy(_key("source").alias("key"), "size").agg(F.count(F.lit(1)).alias("n"))
    budgets = plan.where("rest >= 0.5").select("key", "rest")

    def per_key(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        picks = fit(group["size"].to_numpy(), group["n"].to_numpy(), float(group["rest"].iloc[0]))
        return pd.DataFrame({"key": group["key"], "size": group["size"], "picks": picks})

    picks = counted.join(budgets, "key").groupBy("key").applyInPandas(per_key, "key string, size long, picks long")
    picks = cut_lineage(picks)

    # The first documents of each length in the order of a seeded hash are the ones. Lengths are cut
    # into chunks by the hash, so that thousands of copies of one length are ranked in many tasks.
    h = F.xxhash64(F.lit(seed), "doc_id", "digest")
    rows = sizes.select("*", _key("source").alias("key"), h.alias("h"), F.shiftrightunsigned(h, 64 - CHUNK_BITS).alias("chunk"))
    chunks = rows.groupBy("key", "size", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key", "size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    quota = F.coalesce("picks", F.lit(0)) - F.col("first")  # how many of the chunk are taken
    chunks = chunks.join(picks, ["key", "size"], "left").join(plan.drop("source", "rest"), "key")
    chunks = chunks.select("key", "size", "chunk", quota.alias("quota"), "passes", "source_size", "target")
    place = F.row_number().over(Window.partitionBy("key", "size", "chunk").orderBy("h", "doc_id", "digest"))
    placed = rows.join(chunks, ["key", "size", "chunk"])
    times = F.col("passes") + F.when(place <= F.col("quota"), 1).otherwise(0)
    return placed.withColumn("times", times).select(
        "doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), "digest"
    )


def _key(source: str):
    """The source as text that is never null."""
    return F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def take(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix as a table: every row of ``docs`` as often as :func:`mix` takes it, columns as they were.

    Rows that agree in doc_id, source and text are numbered where only some of them are taken; nothing
    else tells them apart but their further columns, by which the first are not chosen.
    """
    row, often, nth, copy = (fresh(docs, c) for c in ("__row", "__often", "__nth", "__copy"))
    name = lambda *of: F.to_json(F.struct(*of), {"ignoreNullFields": "false"})
    mixed = mix(docs, doc_id, text, source, **settings).select(name("doc_id", "source", "size", "digest").alias(row), "times")
    # Documents of one size are taken as often or once more, so equal rows have two numbers at most.
    some = mixed.groupBy(row).agg(F.min("times").alias("low"), F.max("times").alias("high"), F.sum("times").alias("sum"), F.count(F.lit(1)).alias("n"))
    more = F.col("sum") - F.col("low") * F.col("n")
    plan = cut_lineage(some.where("high > 0").select(row, F.struct("low", "high", more.alias("more")).alias(often)))
    keyed = docs.withColumn(
        row, name(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _size(text).alias("size"), _digest(text).alias("digest"))
    )
    joined = keyed.join(plan, row)
    alike = F.col(often)["low"] == F.col(often)["high"]
    counted = position(joined.where(~alike), [row], [row], out=nth)
    times = F.when(F.col(nth) < F.col(often)["more"], F.col(often)["high"]).otherwise(F.col(often)["low"])
    every = joined.where(alike).withColumn(nth, F.lit(-1).cast("long")).unionByName(counted)
    copies = F.explode(F.array_repeat(F.lit(1), times.cast("int")))
    return every.select(*docs.columns, copies.alias(copy)).drop(copy)
