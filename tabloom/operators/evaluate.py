"""Scoring of completions: parsing, accuracy, log-probability choice, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text
from tabloom.functions.stats import clopper_pearson
from tabloom.functions.tokens import END_COMPLETION, QA_SEP

# Token rows that one task joins, sums up and sorts.
TOKENS_A_TASK = 500_000


def parse_completion(c: Column, on_missing: str = "error") -> Column:
    """struct<text, valid>: what follows the last separator, up to the end marker.

    Without an end marker the rest is returned untrimmed and invalid. A text without separator is
    an error, or null with ``on_missing="null"``.
    """
    tail = F.substring_index(c, QA_SEP, -1)
    ended = F.contains(tail, F.lit(END_COMPLETION))
    body = F.when(ended, text.strip(F.substring_index(tail, END_COMPLETION, 1))).otherwise(tail)
    out = F.struct(body.alias("text"), ended.alias("valid"))
    has = F.contains(c, F.lit(QA_SEP))
    if on_missing == "null":
        return F.when(has, out)
    return F.when(has, out).otherwise(F.raise_error(F.concat(F.lit("no separator in text: "), c)))


def label_text(c: Column) -> Column:
    """Gold label: the part before the end marker, trimmed."""
    return text.strip(F.substring_index(c, END_COMPLETION, 1))


def open_vocabulary(predictions: DataFrame, task: list[str], prediction: str, label: str, valid: str | None = None) -> DataFrame:
    """Exact-match accuracy, samples and invalid rate per task; a missing prediction counts as ''."""
    hit = F.coalesce(F.col(prediction), F.lit("")) == F.col(label)
    n = F.count(F.lit(1))
    aggs = [F.avg(hit.cast("double")).alias("accuracy_open_vocab"), n.alias("samples_seen_total_open_vocab")]
    if valid:
        aggs.append(F.try_divide(F.count_if(~F.col(valid)), n).alias("invalid_prediction_rate_open_vocab"))
    out = predictions.groupBy(*task).agg(*aggs)
    # The whole set has no rows to divide by when it is empty.
    return out if task or not valid else out.withColumn(
        "invalid_prediction_rate_open_vocab", F.coalesce("invalid_prediction_rate_open_vocab", F.lit(float("nan")))
    )


def deal(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """Rows dealt by ``by``, so that a task gets about ``TOKENS_A_TASK`` of ``rows`` at most; adaptive execution merges none of them.

    Tables dealt alike join without another shuffle. A join deals anew what has fewer parts than the session's shuffles,
    so there are as many at least.
    """
    if rows <= TOKENS_A_TASK:
        return df
    return df.repartition(max(rows // TOKENS_A_TASK + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def closed_vocabulary(token_logprobs: DataFrame, task: list[str], example: str, label: str, klass: str = "class", logprob: str = "logprob",
                      normalize: bool = False, tokens: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Best class per example: the sum (or mean) of its token log-probabilities, argmax.

    The smallest class name wins a tie. Two aggregations, both in the task that has the example. With ``tokens`` (their
    number, or a bound) examples are dealt by ``by`` (task, example and label; fewer will do) to tasks of bounded memory,
    and tokens that :func:`deal` has dealt alike stay where they are. Without it they are combined map-side, and the
    session's settings decide how many tasks, thus how much memory each, the groups get.
    """
    if tokens is not None:
        token_logprobs = deal(token_logprobs, by or [*task, example, label], tokens)
    agg = F.avg(logprob) if normalize else F.sum(logprob)
    scored = token_logprobs.groupBy(*task, example, label, klass).agg(agg.alias("score"))
    best = scored.groupBy(*task, example, label).agg(F.min(F.struct(-F.col("score"), F.col(klass).alias("c"))).alias("b"))
    return best.select(*task, example, label, F.col("b.c").alias("prediction"))


def closed_accuracy(best: DataFrame, task: list[str], label: str) -> DataFrame:
    return best.groupBy(*task).agg(
        F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy_closed_vocab"),
        F.count(F.lit(1)).alias("samples"),
    )


def perplexity(steps: DataFrame, group: list[str], loss: str, samples: str) -> DataFrame:
    """exp(sum of losses / sum of samples)."""
    return steps.groupBy(*group).agg(
        F.try_divide(F.sum(loss), F.sum(samples)).alias("loss"),
        F.exp(F.try_divide(F.sum(loss), F.sum(samples))).alias("perplexity"),
    )


def throughput(steps: DataFrame, group: list[str], tokens: str, seconds: str) -> DataFrame:
    return steps.groupBy(*group).agg(F.try_divide(F.sum(tokens), F.sum(seconds)).alias("tokens_per_sec"))


def with_interval(metrics: DataFrame, accuracy: str, n: str, alpha: float = 0.05) -> DataFrame:
    """Adds ``low`` and ``high`` of the exact binomial interval."""
    ci = clopper_pearson(F.col(accuracy), F.col(n), alpha)
    return metrics.withColumn("__ci", ci).withColumn("low", F.col("__ci.low")).withColumn("high", F.col("__ci.high")).drop("__ci")


def long_metrics(metrics: DataFrame, keys: list[str], model: str, split: str, prefix_task: str | None = None) -> DataFrame:
    """(keys, metric, value, model, split); metric names may carry the task as prefix."""
    cols = [c for c in metrics.columns if c not in keys]
    wide = metrics.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    out = wide.unpivot(keys, cols, "metric", "value")
    if prefix_task:
        out = out.withColumn("metric", F.concat_ws("_", F.col(prefix_task), F.col("metric")))
    return out.withColumn("model", F.lit(model)).withColumn("split", F.lit(split))


def write_metrics(metrics: DataFrame, path: str, overwrite: bool = False) -> None:
    metrics.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def prediction_log(predictions: DataFrame, prediction: str, label: str, prompt: str, keys: list[str]) -> DataFrame:
    """(keys, predictions, labels, input_text), ready to be written."""
    return predictions.select(
        *keys, F.col(prediction).alias("predictions"), F.col(label).alias("labels"), F.col(prompt).alias("input_text")
    )


def shot_curve(results: DataFrame, keys: list[str], suite: Column, shot_columns: list[str]) -> DataFrame:
    """Mean accuracy and number of tasks per suite and column of a task-by-shots results table."""
    long = results.withColumn("suite", suite).unpivot([*keys, "suite"], shot_columns, "shots", "accuracy")
    return long.where("accuracy is not null").groupBy("suite", "shots").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.count(F.lit(1)).alias("tasks")
    )
