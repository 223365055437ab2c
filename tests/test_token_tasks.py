"""Choice by log-probability: how many token rows a task gets, with the same rows whatever that is."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabloom.operators import evaluate
from tabloom.registered import scoring

FLAGS = "ANR"


def best(tokens, normalize):
    scores = defaultdict(list)
    for task, example, label, klass, logprob in tokens:
        scores[task, example, label, klass].append(logprob)
    out = {}
    for (*key, klass), x in scores.items():
        out.setdefault(tuple(key), []).append((-sum(x) / (len(x) if normalize else 1), klass))
    return {k: min(v)[1] for k, v in out.items()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders 0 to 299 (7 comes twice, one has no key) and 4 lines each, some with keys without an order."""
    path = tmp_path_factory.mktemp("tokens")
    orders = [(i, "FOP"[i % 3], f"{i % 5}-X") for i in [*range(300), 7]] + [(None, "F", "0-X")]
    lines = [(i % 310, FLAGS[i * i % 7 % 3], float(i * 31 % 50)) for i in range(1200)] + [(None, "A", 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderpriority string").coalesce(1).write.parquet(str(path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, l_quantity double").coalesce(1).write.parquet(str(path / "lineitem.parquet"))
    tokens = [(p, k, s, flag, -q) for k, s, p in orders for key, flag, q in lines if key == k is not None]
    return str(path), tokens


def planned(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_closed_accuracy_is_dealt_by_rows(spark, folder, monkeypatch, capsys):
    path, tokens = folder
    monkeypatch.setattr(evaluate, "TOKENS_A_TASK", 50, raising=False)
    plan = planned(scoring.QUERIES["closed_accuracy_normalized"](spark, path), capsys)
    assert plan.count(f", {1201 // 50 + 1}), REPARTITION_BY_NUM") == 2
    assert plan.count("Exchange hashpartitioning") == 3  # one for each table, one for the accuracy of tasks
    hits = defaultdict(list)
    for (task, _, label), c in best(tokens, True).items():
        hits[task].append(c == label)
    got = {r["task"]: (round(r["accuracy_closed_vocab"], 9), r["samples"]) for r in scoring.QUERIES["closed_accuracy_normalized"](spark, path).collect()}
    assert got == {t: (round(sum(x) / len(x), 9), len(x)) for t, x in hits.items()}


def test_the_join_itself_is_dealt_by_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(evaluate, "TOKENS_A_TASK", 50, raising=False)
    monkeypatch.setitem(scoring.__dict__, "load", lambda s, f, name: spark.read.parquet(f"{f}/{name}.parquet").hint("merge"))
    tokens, rows = scoring._logprobs(spark, folder[0])
    each = tokens.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert rows == 1201 and len(each) == 25 and max(r["count"] for r in each) < 200


@pytest.mark.parametrize("normalize", [False, True])
def test_operator_deals_any_tokens(spark, folder, monkeypatch, normalize):
    tokens = folder[1]
    df = spark.createDataFrame(tokens, "task string, example long, label string, class string, logprob double")
    monkeypatch.setattr(evaluate, "TOKENS_A_TASK", 100, raising=False)
    args = (["task"], "example", "label")
    out = evaluate.closed_vocabulary(df, *args, normalize=normalize, tokens=len(tokens))
    assert out.rdd.getNumPartitions() == len(tokens) // 100 + 1
    assert sorted(out.collect()) == sorted(evaluate.closed_vocabulary(df, *args, normalize=normalize).collect())
    assert {tuple(r)[:3]: r["prediction"] for r in out.collect()} == best(tokens, normalize)


def test_closed_vocabulary_tasks_follow_the_rows(spark, folder, monkeypatch, capsys):
    path, tokens = folder
    plain = scoring.QUERIES["closed_vocabulary"](spark, path)
    monkeypatch.setattr(evaluate, "TOKENS_A_TASK", 50, raising=False)
    out = scoring.QUERIES["closed_vocabulary"](spark, path)
    assert planned(out, capsys).count("Exchange hashpartitioning") == 2  # one for each table, none after the join
    assert out.rdd.getNumPartitions() == 1201 // 50 + 1
    for df in (plain, out):
        assert {tuple(r)[:3]: r["prediction"] for r in df.collect()} == best(tokens, False) and df.count() == len(best(tokens, False))
