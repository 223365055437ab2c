"""Supervised baselines: sizes and class shares in SQL, and whether they do no worse than the largest class."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import baselines, sampling
from tabloom.registered.common import load, q, uniform

QUERIES, SQL = {}, {}


def _documents(spark, folder):
    """Text statistics of labelled documents and their quality."""
    d = load(spark, folder, "documents").join(load(spark, folder, "labels"), "doc_id")
    words = F.size(F.split("text", "\\s+"))
    d = d.select(
        "doc_id", F.log1p(F.col("n_chars").cast("double")).alias("chars"), (F.col("n_chars") / words).alias("word_len"),
        (F.length(F.regexp_replace("text", "[^0-9]", "")) / F.col("n_chars")).alias("digits"), F.col("toxic").cast("double").alias("toxic"), "quality",
    )
    d = sampling.split_iid(d, ["doc_id"], 0, (("train", 0.75), ("test", 0.25)))
    return d.where("split = 'train'"), d.where("split = 'test'")


def _score(model, n_trials):
    def run(spark, folder):
        train, test = _documents(spark, folder)
        _, metrics = baselines.train_and_score(
            train, test, ["chars", "word_len", "digits", "toxic"], "quality", model, n_trials, seed=1, max_iter=50)
        out = baselines.metrics_frame(spark, metrics)
        # Within two standard errors of the largest class's share.
        error = F.sqrt(F.col("majority_acc") * (1 - F.col("majority_acc")) / F.col("n_test"))
        fair = (F.col("acc") >= F.col("majority_acc") - 2 * error).alias("fair")
        return out.select("n_train", "n_test", F.round("majority_acc", 9).alias("majority_acc"), fair)

    return run


QUERIES["baseline_logistic_regression"] = _score("logistic_regression", 3)
QUERIES["baseline_boosted_trees"] = _score("boosted_trees", 1)

_SIZES = (
    f"WITH d AS (SELECT quality, {uniform(0, q('split'), 'doc_id::VARCHAR')} < 0.75 AS train FROM documents JOIN labels USING (doc_id)) "
    "SELECT (SELECT count(*) FROM d WHERE train) AS n_train, (SELECT count(*) FROM d WHERE NOT train) AS n_test, "
    "(SELECT round(max(n) / sum(n), 9) FROM (SELECT count(*) AS n FROM d WHERE NOT train GROUP BY quality)) AS majority_acc, true AS fair"
)
SQL["baseline_logistic_regression"] = SQL["baseline_boosted_trees"] = _SIZES
