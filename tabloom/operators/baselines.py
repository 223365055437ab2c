"""Supervised baselines on Spark ML, and the label encodings they need."""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text
from tabloom.operators.ordering import broadcast_if_small, position
from tabloom.session import cut_lineage


def label_codes(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """(value, code): text values of both sides, numbered in sorted order."""
    def shown(df):
        return df.select(text.py_str(F.col(column), df.schema[column].dataType).alias("value"))

    values = shown(train).unionByName(shown(test)).distinct()
    return position(values, [], ["value"], out="code")


def label_encode(train: DataFrame, test: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with the non-numeric columns replaced by codes over the union of their values."""
    if columns is None:
        columns = [f.name for f in train.schema.fields if not text.is_number(f.dataType)]
    for c in columns:
        codes = label_codes(train, test, c)
        codes = broadcast_if_small(codes.select(F.col("value").alias("__v"), F.col("code").alias("__c")), codes.count())

        def encode(df):
            key = text.py_str(F.col(c), df.schema[c].dataType)
            return df.join(codes, key == F.col("__v"), "left").withColumn(c, F.col("__c")).drop("__v", "__c")

        train, test = encode(train), encode(test)
    return train, test


def shared_categories(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Union of the values of a column in two tables."""
    return a.select(column).union(b.select(column)).where(F.col(column).isNotNull()).distinct()


def recode_classes(test: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """(label, code): classes of the sample count from 0 in order, those only in test follow."""
    seen = sample.select(label).distinct().withColumn("__late", F.lit(0))
    late = test.select(label).distinct().join(seen.select(label), label, "left_anti").withColumn("__late", F.lit(1))
    return position(seen.unionByName(late), [], ["__late", label], out="code").drop("__late")


def prepare(train: DataFrame, test: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Booleans to numbers, other non-numeric columns and a non-numeric label to codes."""
    from tabloom.operators.columns import bools_to_int

    return label_encode(bools_to_int(train), bools_to_int(test))


def class_shares(df: DataFrame, label: str) -> dict[str, float]:
    """Share of each class; classes are few."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in rows)
    return {str(r[label]): r["n"] / total for r in sorted(rows, key=lambda r: (-r["n"], str(r[label])))}


def regularization_grid(n_trials: int, n_rows: int) -> list[float]:
    """Inverse strengths 1e-4 .. 1e4 on a log scale and 1e10, as Spark's penalty 1 / (C n)."""
    k = n_trials - 1
    cs = [10 ** (-4 + 8 * i / (k - 1)) if k > 1 else 1e-4 for i in range(k)] + [1e10]
    return [1.0 / (c * n_rows) for c in cs]


def tree_grid(n_trials: int, seed: int = 0) -> list[dict]:
    """Random settings from the usual ranges of boosted trees."""
    rng = random.Random(seed)
    return [
        {
            "stepSize": 10 ** rng.uniform(-5, 0),
            "maxDepth": rng.randrange(3, 10),
            "subsamplingRate": rng.uniform(0.5, 1.0),
            "featureSubsetStrategy": str(round(rng.uniform(0.5, 1.0), 3)),
            "maxBins": rng.choice([128, 256, 512]),
            "minInfoGain": 10 ** rng.uniform(-8, -1),
        }
        for _ in range(n_trials)
    ]


def train_and_score(train: DataFrame, test: DataFrame, features: list[str], label: str, model: str = "logistic_regression",
                    n_trials: int = 10, seed: int = 0, max_iter: int = 1000, parallelism: int = 1):
    """Fits with cross-validated settings and returns (model, metrics).

    Tuning is skipped for a single trial or when a class has no more rows than there are folds;
    ``tuned`` in the metrics says so. Trees are boosted one class against the rest where there are
    more than two.

    Both sides are read once: vectors and labels are stored, and folds and iterations read those.
    Trials run one at a time by default. Spark keeps every core busy with one, and threads that fit on
    the cached folds share a plan, whose serialization may then fail.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator

    assembler = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep")
    train, test = (
        cut_lineage(assembler.transform(df.withColumn(label, F.col(label).cast("double"))).select("__features", label)) for df in (train, test)
    )
    tr = {float(r[0]): r[1] for r in train.groupBy(label).count().collect()}
    te = {float(r[0]): r[1] for r in test.groupBy(label).count().collect()}
    n_train, n_test = sum(tr.values()), sum(te.values())
    classes = len(set(tr) | set(te))
    folds = min(n_train, 3)
    can_tune = n_train > 1 and n_trials > 1 and all(c > folds for c in tr.values())
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    args = {"featuresCol": "__features", "labelCol": label}
    if model == "logistic_regression":
        est = LogisticRegression(maxIter=max_iter, standardization=False, **args)
        settings = [{est.regParam: r} for r in regularization_grid(n_trials, n_train)] if can_tune else []
    elif model == "boosted_trees":
        est = GBTClassifier(seed=seed, **args)
        grid = tree_grid(n_trials, seed) if can_tune else []
        settings = [{est.getParam(k): v for k, v in s.items()} for s in grid]
        if classes > 2:
            one = est
            est = OneVsRest(classifier=one, **args)
            settings = [{est.classifier: one.copy(s)} for s in settings]
    else:
        raise ValueError(f"unknown model: {model}")
    stage = est
    if settings:
        stage = CrossValidator(estimator=est, estimatorParamMaps=settings, evaluator=judge, numFolds=folds,
                               seed=seed, parallelism=parallelism)
    fitted = stage.fit(train)
    acc = judge.evaluate(fitted.transform(test))
    return PipelineModel([assembler, fitted]), {
        "acc": acc,
        "majority_acc": max(te.values()) / n_test,
        "n_test": n_test,
        "n_train": n_train,
        "n_trials": n_trials,
        "y_test_frac": json.dumps({str(k): v / n_test for k, v in sorted(te.items())}),
        "y_train_frac": json.dumps({str(k): v / n_train for k, v in sorted(tr.items())}),
    }


METRICS_SCHEMA = (
    "acc double, majority_acc double, n_test bigint, n_train bigint, n_trials int, y_test_frac string, y_train_frac string"
)


def metrics_frame(spark, metrics: dict) -> DataFrame:
    names = [f.split()[0] for f in METRICS_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(metrics[n] for n in names)], METRICS_SCHEMA)
