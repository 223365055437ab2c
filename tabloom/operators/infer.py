"""Batch prediction with a user-supplied model: prompts in, parsed completions out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import tokens as K
from tabloom.operators.evaluate import parse_completion
from tabloom.operators.rejects import mark
from tabloom.operators.ordering import broadcast_if_small, join_null_safe, position
from tabloom.operators.target import distinct_draws

# A model factory is called once per task; the model maps a batch of prompts and their token
# budgets to completions.
Model = Callable[[list[str], list[int]], list[str]]


def with_shots(targets: DataFrame, keys: list[str], pool: DataFrame, pool_order: list, k: int | None, seed=0) -> DataFrame:
    """Adds ``shots``: array of (text, label) drawn without replacement for every target.

    ``pool`` has ``text`` and ``class_label_as_text``. ``k`` has to be given: with none or not below the pool size
    every labelled row is a shot, in a hashed order per target. Positions are drawn and looked up
    by equality, never by pairing targets with the pool.
    """
    placed = position(pool.select("text", "class_label_as_text", *pool_order), [], pool_order, out="__pos")
    n = pool.count()
    k = n if k is None else min(k, n)
    if k == 0:
        return targets.withColumn("shots", F.expr("cast(array() as array<struct<text:string,label:string>>)"))
    draws = distinct_draws(F.lit(n), k, seed, "shots", *[F.col(c) for c in keys])
    wanted = targets.select(*keys, F.posexplode(draws).alias("__j", "__pos"))
    lookup = placed.select("__pos", F.struct(F.col("text"), F.col("class_label_as_text").alias("label")).alias("__s"))
    found = wanted.join(broadcast_if_small(lookup, n), "__pos")
    lists = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__j", "__s"))).alias("__l"))
    return join_null_safe(targets, lists, keys).withColumn("shots", F.col("__l.__s")).drop("__l")


def prompts(df: DataFrame) -> DataFrame:
    """``prompt``: finished shots, then the target's text and the separator."""
    shot = F.transform("shots", lambda s: F.concat(s["text"], F.lit(K.QA_SEP), s["label"], F.lit(K.END_COMPLETION)))
    return df.withColumn("prompt", F.concat(F.array_join(shot, ""), F.col("text"), F.lit(K.QA_SEP)))


def generate(df: DataFrame, make_model: Callable[[], Model], max_new_tokens: int, max_len: int | None = None,
             prompt: str = "prompt", no_room: str = "drop") -> DataFrame:
    """Adds ``completion``. The model is made once per task and sees Arrow batches of prompts.

    With ``max_len`` the byte length of the prompt bounds the budget. Prompts with no room are left out,
    or with ``no_room="mark"`` stay, without a completion and with a ``reason``, unseen by the model.
    """
    if max_len is not None:
        room = F.lit(max_len) - F.octet_length(prompt)
        if no_room == "mark":
            df = mark(df, [(room < 2, "no room")]).drop("outcome")
        else:
            df = df.where(room >= 2)
        df = df.withColumn("max_new_tokens", F.greatest(F.least(F.lit(max_new_tokens), room), F.lit(0)))
    else:
        df = df.withColumn("max_new_tokens", F.lit(max_new_tokens))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for b in batches:
            b = b.copy()
            able = b["reason"].isna() if "reason" in b.columns else pd.Series(True, index=b.index)
            b["completion"] = None
            if able.any():
                b.loc[able, "completion"] = model(b.loc[able, prompt].tolist(), b.loc[able, "max_new_tokens"].tolist())
            yield b

    return df.mapInPandas(run, schema + ", completion string")


def predict(targets: DataFrame, keys: list[str], pool: DataFrame | None, pool_order: list, make_model, max_new_tokens: int = 32,
            k: int | None = None, max_len: int | None = None, on_invalid: str = "return", seed=0, no_room: str = "drop") -> DataFrame:
    """Few-shot (or zero-shot) prediction of serialized rows; adds ``prediction`` and ``valid``.

    ``on_invalid``: ``raise``, ``null`` or ``return`` the unfinished text. ``no_room``: see :func:`generate`;
    a marked row has neither prediction nor validity.
    """
    if pool is None:
        shots = targets.withColumn("shots", F.expr("cast(array() as array<struct<text:string,label:string>>)"))
    else:
        shots = with_shots(targets, keys, pool, pool_order, k, seed)
    done = generate(prompts(shots), make_model, max_new_tokens, max_len, no_room=no_room)
    parsed = done.withColumn("__p", parse_completion(F.concat("prompt", "completion")))
    value = F.col("__p.text")
    if on_invalid == "raise":
        value = F.when(F.col("completion").isNull() | F.col("__p.valid"), value).otherwise(F.raise_error(F.concat(F.lit("invalid prediction: "), value)))
    elif on_invalid == "null":
        value = F.when(F.col("__p.valid"), value)
    return parsed.withColumn("prediction", value).withColumn("valid", F.col("__p.valid")).drop("__p")


def single_target(df: DataFrame, target: str) -> DataFrame:
    """Interactive form: exactly one target row; a missing target column is added as null."""
    head = df.limit(2).count()
    if head != 1:
        raise ValueError(f"expected one target row, got {'more' if head else 'none'}")
    return df if target in df.columns else df.withColumn(target, F.lit(None).cast("string"))


def constant_model(answer: str, finish: bool = True) -> Callable[[], Model]:
    """Stand-in that always gives the same answer."""
    return lambda: (lambda texts, budget: [answer + (K.END_COMPLETION if finish else "")] * len(texts))


def hashed_model(answers: list[str], seed=0) -> Callable[[], Model]:
    """Stand-in that picks an answer by a hash of the prompt."""
    def make():
        import hashlib

        def run(texts, budget):
            pick = (int(hashlib.md5(f"{seed}:{t}".encode()).hexdigest()[:8], 16) for t in texts)
            return [answers[p % len(answers)] + K.END_COMPLETION for p in pick]

        return run

    return make


