"""Serialized tasks to accuracy tables, all tasks in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import tokens as K
from tabloom.operators import evaluate, infer
from tabloom.operators.packing import with_batch


def eval_prompts(samples: DataFrame, order: list, num_shots: int, seed=0) -> DataFrame:
    """Prompt per sample (``task``, ``key``, ``text``, ``class_label_as_text``): the other samples of
    its run of ``num_shots + 1`` are the shots, in a hashed order."""
    from tabloom.functions import hashing

    if not num_shots:
        return samples.withColumn("prompt", F.concat("text", F.lit(K.QA_SEP)))
    runs = with_batch(samples, ["task"], order, num_shots + 1)
    lists = runs.groupBy("task", "batch").agg(
        F.sort_array(F.collect_list(F.struct("slot", "key", "text", "class_label_as_text"))).alias("run")
    )
    each = lists.select("task", "run", F.explode("run").alias("t"))
    ranked = F.transform(
        F.filter("run", lambda s: s["slot"] != F.col("t.slot")),
        lambda s: F.struct(
            hashing.digest(seed, "shot", F.col("t.key"), s["slot"]).alias("k"),
            F.concat(s["text"], F.lit(K.QA_SEP), s["class_label_as_text"], F.lit(K.END_COMPLETION)).alias("p"),
        ),
    )
    return each.select(
        "task", F.col("t.key").alias("key"), F.col("t.text").alias("text"),
        F.col("t.class_label_as_text").alias("class_label_as_text"),
        F.concat(F.array_join(F.array_sort(ranked)["p"], ""), F.col("t.text"), F.lit(K.QA_SEP)).alias("prompt"),
    )


def run(samples: DataFrame, order: list, make_model, num_shots: int = 0, max_new_tokens: int = 32, max_len: int | None = None,
        model: str = "model", split: str = "test", seed=0) -> tuple[DataFrame, DataFrame]:
    """(predictions, long metrics with confidence bounds)."""
    done = infer.generate(eval_prompts(samples, order, num_shots, seed), make_model, max_new_tokens, max_len)
    parsed = done.withColumn("__p", evaluate.parse_completion(F.concat("prompt", "completion")))
    preds = parsed.select("task", "key", "prompt", F.col("__p.text").alias("prediction"), F.col("__p.valid").alias("valid"),
                          evaluate.label_text(F.col("class_label_as_text")).alias("label"))
    wide = evaluate.open_vocabulary(preds, ["task"], "prediction", "label", "valid")
    wide = evaluate.with_interval(wide, "accuracy_open_vocab", "samples_seen_total_open_vocab")
    return preds, evaluate.long_metrics(wide, ["task"], model, split)
