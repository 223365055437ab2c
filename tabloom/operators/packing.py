"""Several samples in one sequence: packing and few-shot prompts.

Both work on runs of a fixed number of consecutive samples. The run number comes from an exact
distributed position, so a source with a third of all samples is spread over many tasks, and a
group that is collected never exceeds the run length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import hashing
from tabloom.functions import tokens as K
from tabloom.operators.ordering import position
from tabloom.operators.shards import table_of_key


def island_ids(df: DataFrame, batch: list[str], order: list, key: str, merge: bool = True, out: str = "example_id") -> DataFrame:
    """Number (from 0) of the run of consecutive samples with the same table inside a batch.

    The same table met again later starts a new run. Without ``merge`` every sample has its own.
    ``batch`` must be bounded (see :func:`with_batch`).
    """
    w = Window.partitionBy(*batch).orderBy(*order)
    if not merge:
        return df.withColumn(out, F.row_number().over(w) - 1)
    tid = table_of_key(F.col(key))
    new = F.coalesce((tid != F.lag(tid).over(w)).cast("int"), F.lit(0))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(run).cast("int")).drop("__new")


def with_batch(df: DataFrame, shard: list[str], order: list, size: int, out: str = "batch") -> DataFrame:
    """Adds the number of the run of ``size`` consecutive samples of a shard, and ``slot`` in it."""
    placed = position(df, shard, order, out="__pos")
    return placed.withColumn(out, F.floor(F.col("__pos") / F.lit(size)).cast("long")).withColumn(
        "slot", F.pmod(F.col("__pos"), F.lit(size)).cast("int")
    ).drop("__pos")


def _trim_bos(c: Column, ids: Column, first: Column, bos_id: int) -> Column:
    """The sequence without its leading begin marker, unless it is the first one."""
    starts = F.get(ids, F.lit(0)) == bos_id
    return F.when(~first & starts, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c)


def pack(
    df: DataFrame,
    shard: list[str],
    order: list,
    key: str,
    max_len: int,
    batch_size: int = 150,
    merge_by_key: bool = True,
    trim_extra_bos: bool = False,
    bos_id: int = K.BOS_ID,
    tail: str = "keep",
) -> DataFrame:
    """Sequences of at most ``max_len`` tokens from runs of ``batch_size`` samples.

    A run that is longer goes on in further sequences, numbered by ``part``; no token is lost.
    ``tail="drop"`` keeps the first sequence of a run only and says in ``dropped`` how many of its
    tokens are not in it. ``example_ids`` tell the samples (or tables) apart, ``position_ids`` restart with each, and
    ``spans`` give the same blocks compactly: token i may attend to j <= i of its own span.
    """
    df = with_batch(df, shard, order, batch_size)
    keys = [*shard, "batch"]
    if trim_extra_bos:
        first = F.col("slot") == 0
        labels = _trim_bos(F.col("labels"), F.col("input_ids"), first, bos_id)
        ids = _trim_bos(F.col("input_ids"), F.col("input_ids"), first, bos_id)
        df = df.withColumn("labels", labels).withColumn("input_ids", ids)
    df = island_ids(df, keys, ["slot"], key, merge_by_key)
    # Tokens before a sample decide which sequences it is in: it is sliced before any token is
    # collected, and with tail="drop" what is behind the cut never is.
    w = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__start", F.coalesce(F.sum(F.size("input_ids")).over(w), F.lit(0)).cast("int"))
    w_is = Window.partitionBy(*keys, "example_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in_run", F.coalesce(F.sum(F.size("input_ids")).over(w_is), F.lit(0)).cast("int"))
    size, start = F.size("input_ids"), F.col("__start")
    last = F.greatest(F.floor((start + size - 1) / max_len), F.floor(start / max_len)).cast("int")
    more = []
    if tail == "drop":
        total = F.sum(size).over(Window.partitionBy(*keys))
        df = df.withColumn("dropped", F.greatest(total - max_len, F.lit(0)).cast("long")).where(start < max_len)
        df = df.withColumn("part", F.lit(0))
        more = ["dropped"]
    elif tail == "keep":
        df = df.withColumn("part", F.explode(F.sequence(F.floor(start / max_len).cast("int"), last)))
    else:
        raise ValueError(f"unknown tail: {tail}")
    # What of the sample is in this sequence: from token ``skip`` on, ``n`` tokens.
    skip = F.greatest(F.col("part") * max_len - start, F.lit(0))
    n = F.least(size - skip, (F.col("part") + 1) * max_len - start - skip)
    keys = [*keys, "part"]
    df = df.select(
        *keys,
        *more,
        "slot",
        "example_id",
        (start + skip - F.col("part") * max_len).alias("start"),
        n.alias("len"),
        F.slice("input_ids", skip + 1, n).alias("ids"),
        F.slice("labels", skip + 1, n).alias("labels"),
        F.array_repeat(F.col("example_id"), n).alias("ex"),
        F.when(n > 0, F.sequence(F.col("__in_run") + skip, F.col("__in_run") + skip + n - 1))
        .otherwise(F.expr("cast(array() as array<int>)")).alias("ps"),
    )
    got = df.groupBy(*keys, *more).agg(
        F.sort_array(F.collect_list(F.struct("slot", "ids", "labels", "ex", "ps"))).alias("s"),
        F.sort_array(F.collect_list(F.struct("start", "len", "example_id"))).alias("p"),
    )
    return got.select(
        *keys,
        *more,
        F.flatten("s.ids").alias("input_ids"),
        F.flatten("s.labels").alias("labels"),
        F.flatten("s.ex").alias("example_ids"),
        F.flatten("s.ps").alias("position_ids"),
        _merge_spans(F.filter("p", lambda x: x["len"] > 0)).alias("spans"),
    )


def _merge_spans(parts: Column) -> Column:
    """Neighbouring parts with the same id become one span."""
    empty = F.expr("cast(array() as array<struct<example_id:int,start:int,len:int>>)")

    def add(acc, p):
        last = F.element_at(acc, -1)
        span = F.struct(p["example_id"].alias("example_id"), p["start"].alias("start"), p["len"].alias("len"))
        longer = F.struct(last["example_id"].alias("example_id"), last["start"].alias("start"), (last["len"] + p["len"]).alias("len"))
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["example_id"] == p["example_id"])
        return F.when(F.coalesce(same, F.lit(False)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(
            F.concat(acc, F.array(span))
        )

    return F.aggregate(parts, empty, add)


def spans_of(example_ids: Column) -> Column:
    """Blocks of equal neighbouring ids: the compact form of the block-diagonal causal mask."""
    parts = F.transform(example_ids, lambda e, i: F.struct(i.alias("start"), F.lit(1).alias("len"), e.alias("example_id")))
    return _merge_spans(parts)


def may_attend(spans: Column, i: Column, j: Column) -> Column:
    """Whether token i sees token j: same block and not later."""
    return F.exists(
        spans,
        lambda s: (i >= s["start"]) & (i < s["start"] + s["len"]) & (j >= s["start"]) & (j <= i),
    )


def few_shot(
    df: DataFrame,
    shard: list[str],
    order: list,
    keys: list[str],
    num_shots: int,
    max_len: int,
    trim_extra_bos: bool = True,
    seed=0,
) -> DataFrame:
    """Every sample once as the target behind the other samples of its run as shots.

    Runs have ``num_shots + 1`` samples (the last may be shorter). Shots come in a hashed order
    that differs per target and their labels are masked. ``keys`` identify a sample. Where shots
    and target exceed ``max_len``, the shots are cut from their end; of a target that is too long by
    itself its last tokens stay, which hold the label. ``n_cut`` counts the tokens left out.
    """
    df = with_batch(df, shard, order, num_shots + 1)
    group = [*shard, "batch"]
    runs = df.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("slot", *keys, "input_ids", "labels"))).alias("run")
    )
    each = runs.select(*group, "run", F.explode("run").alias("t"))
    ident = [F.col(f"t.{k}") for k in keys]

    def ranked(s):
        return F.struct(
            hashing.digest(seed, "shot", *ident, s["slot"]).alias("k"), s["slot"].alias("slot"), s["input_ids"].alias("ids")
        )

    shots = F.array_sort(F.transform(F.filter("run", lambda s: s["slot"] != F.col("t.slot")), ranked))
    each = each.withColumn("__shots", shots["ids"])

    def body(x):
        return F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))) if trim_extra_bos else x

    parts = F.transform("__shots", lambda x, i: F.when(i > 0, body(x)).otherwise(x))
    have = F.size("__shots") > 0
    last_ids = F.when(have, body(F.col("t.input_ids"))).otherwise(F.col("t.input_ids"))
    last_labels = F.when(have, body(F.col("t.labels"))).otherwise(F.col("t.labels"))
    context = F.flatten(parts)
    each = each.withColumn("__ctx", context).withColumn("__ids", last_ids).withColumn("__labels", last_labels)
    size = F.size("__ids")
    room = F.greatest(F.lit(max_len) - size, F.lit(0))
    before = F.slice("__ctx", F.lit(1), room)

    def tail(c: str) -> Column:
        return F.slice(c, F.greatest(size - max_len, F.lit(0)) + 1, F.lit(max_len))

    return each.select(
        *group,
        F.col("t.slot").alias("slot"),
        *[F.col(f"t.{k}").alias(k) for k in keys],
        F.concat(before, tail("__ids")).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(K.IGNORE), F.least(F.size("__ctx"), room)), tail("__labels")).alias("labels"),
        F.greatest(F.size("__ctx") + size - max_len, F.lit(0)).alias("n_cut"),
    )
