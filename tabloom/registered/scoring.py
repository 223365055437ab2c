"""Completions, accuracy, log-probability choice, reports, batch prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.config import SerializerConfig
from tabloom.functions import hashing
from tabloom.operators import evaluate, infer, serialize
from tabloom.plans import evaluation
from tabloom.registered.common import digest, draws, load, q, sentences, uniform

QUERIES, SQL = {}, {}

_CLASSES = ("F", "O", "P")


def _completions(spark, folder):
    """Orders with a made-up completion of their status: right or wrong, some unfinished."""
    df = load(spark, folder, "orders")
    guess = F.element_at(F.array(*[F.lit(c) for c in _CLASSES]), (hashing.below(F.lit(3), 1, "guess", F.col("o_orderkey")) + 1).cast("int"))
    done = hashing.uniform(1, "done", F.col("o_orderkey")) < 0.9
    text = F.concat(F.lit("shot<|endinput|>X<|endcompletion|>row<|endinput|> "), guess, F.when(done, F.lit(" <|endcompletion|> tail")).otherwise(F.lit("")))
    return df.select("o_orderkey", F.col("o_orderpriority").alias("task"), text.alias("completion"), F.concat("o_orderstatus", F.lit("<|endcompletion|>")).alias("gold"))


_GUESS = f"(['F', 'O', 'P'])[floor({uniform(1, q('guess'), 'o_orderkey::VARCHAR')} * 3)::INT + 1]"
_DONE = f"{uniform(1, q('done'), 'o_orderkey::VARCHAR')} < 0.9"
_PARSED = (
    f"SELECT o_orderkey, o_orderpriority AS task, CASE WHEN {_DONE} THEN {_GUESS} ELSE ' ' || {_GUESS} END AS prediction, {_DONE} AS valid, "
    "o_orderstatus AS label FROM orders"
)


def _parse(spark, folder):
    df = _completions(spark, folder).withColumn("p", evaluate.parse_completion(F.col("completion")))
    return df.select("o_orderkey", "task", F.col("p.text").alias("prediction"), F.col("p.valid").alias("valid"), evaluate.label_text(F.col("gold")).alias("label"))


QUERIES["parse_completion"] = _parse
SQL["parse_completion"] = _PARSED

QUERIES["accuracy"] = lambda spark, folder: evaluate.open_vocabulary(_parse(spark, folder), ["task"], "prediction", "label", "valid")
_ACC = (
    "SELECT task, avg((prediction = label)::INT::DOUBLE) AS accuracy_open_vocab, count(*) AS samples_seen_total_open_vocab, "
    f"count(*) FILTER (NOT valid)::DOUBLE / count(*) AS invalid_prediction_rate_open_vocab FROM ({_PARSED}) GROUP BY task"
)
SQL["accuracy"] = _ACC


def _metrics(spark, folder):
    m = evaluate.long_metrics(QUERIES["accuracy"](spark, folder), ["task"], "guess", "test", "task")
    return m.select("task", "metric", "value", "model", "split")


QUERIES["metrics_long"] = _metrics
SQL["metrics_long"] = (
    f"SELECT task, task || '_' || name AS metric, value, 'guess' AS model, 'test' AS split FROM (UNPIVOT (SELECT task, accuracy_open_vocab, "
    f"samples_seen_total_open_vocab::DOUBLE AS samples_seen_total_open_vocab, invalid_prediction_rate_open_vocab FROM ({_ACC})) "
    "ON accuracy_open_vocab, samples_seen_total_open_vocab, invalid_prediction_rate_open_vocab INTO NAME name VALUE value)"
)


def _interval(spark, folder):
    m = evaluate.with_interval(QUERIES["accuracy"](spark, folder), "accuracy_open_vocab", "samples_seen_total_open_vocab")
    return m.select("task", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


# The bounds are where a binomial tail reaches alpha / 2: 50 halvings with plain tail sums.
_term = "exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(({m})) + (n - k) * ln(1 - ({m})))"
_upper_tail = "list_sum(list_transform(range(x, n + 1), lambda k: " + _term.format(m="(lo0 + lo1) / 2") + "))"
_lower_tail = "list_sum(list_transform(range(0, x + 1), lambda k: " + _term.format(m="(hi0 + hi1) / 2") + "))"
QUERIES["accuracy_interval"] = _interval
SQL["accuracy_interval"] = (
    "WITH RECURSIVE b AS (SELECT task, n, x, 0 AS step, 0.0::DOUBLE AS lo0, 1.0::DOUBLE AS lo1, 0.0::DOUBLE AS hi0, 1.0::DOUBLE AS hi1 FROM (SELECT task, "
    "samples_seen_total_open_vocab AS n, floor(accuracy_open_vocab * samples_seen_total_open_vocab)::BIGINT AS x FROM (" + _ACC + ")) UNION ALL "
    "SELECT task, n, x, step + 1, CASE WHEN up < 0.025 THEN (lo0 + lo1) / 2 ELSE lo0 END, CASE WHEN up < 0.025 THEN lo1 ELSE (lo0 + lo1) / 2 END, "
    "CASE WHEN dn < 0.025 THEN hi0 ELSE (hi0 + hi1) / 2 END, CASE WHEN dn < 0.025 THEN (hi0 + hi1) / 2 ELSE hi1 END FROM (SELECT *, "
    + _upper_tail + " AS up, " + _lower_tail + " AS dn FROM b WHERE step < 50)) "
    "SELECT task, round((lo0 + lo1) / 2, 6) AS low, round((hi0 + hi1) / 2, 6) AS high FROM b WHERE step = 50"
)


# --- log-probabilities -----------------------------------------------------------------------

def _logprobs(spark, folder):
    """Line items as token log-probabilities: order = example, return flag = class; and how many rows decide on the tasks.

    Both tables are dealt by order, so that the sort of the join is as bounded as what follows in the same task.
    """
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    orders = load(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderstatus")
    rows = max(lines.count(), orders.count())
    df = evaluate.deal(lines, ["l_orderkey"], rows).join(evaluate.deal(orders, ["l_orderkey"], rows), "l_orderkey")
    return df.select(F.col("o_orderpriority").alias("task"), F.col("l_orderkey").alias("example"), F.col("o_orderstatus").alias("label"),
                     F.col("l_returnflag").alias("class"), (-F.col("l_quantity")).alias("logprob")), rows


def _closed(spark, folder, normalize=False):
    tokens, rows = _logprobs(spark, folder)
    return evaluate.closed_vocabulary(tokens, ["task"], "example", "label", normalize=normalize, tokens=rows, by=["example"])


def _closed_sql(agg):
    return (
        "SELECT task, example, label, first(class ORDER BY score DESC, class) AS prediction FROM (SELECT o_orderpriority AS task, l_orderkey AS example, "
        f"o_orderstatus AS label, l_returnflag AS class, {agg}(-l_quantity) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY ALL"
    )


QUERIES["closed_vocabulary"] = _closed
SQL["closed_vocabulary"] = _closed_sql("sum")
QUERIES["closed_accuracy_normalized"] = lambda spark, folder: evaluate.closed_accuracy(_closed(spark, folder, normalize=True), ["task"], "label")
SQL["closed_accuracy_normalized"] = (
    f"SELECT task, avg((prediction = label)::INT::DOUBLE) AS accuracy_closed_vocab, count(*) AS samples FROM ({_closed_sql('avg')}) GROUP BY task"
)


# --- steps and reports -----------------------------------------------------------------------

QUERIES["perplexity"] = lambda spark, folder: evaluate.perplexity(
    load(spark, folder, "events").withColumn("loss", F.col("value") / 100), ["event_type"], "loss", "user_id").select(
        "event_type", F.round("loss", 9).alias("loss"), F.round("perplexity", 9).alias("perplexity"))
SQL["perplexity"] = (
    "SELECT event_type, round(sum(value / 100) / sum(user_id), 9) AS loss, round(exp(sum(value / 100) / sum(user_id)), 9) AS perplexity FROM events GROUP BY event_type"
)
QUERIES["throughput"] = lambda spark, folder: evaluate.throughput(
    load(spark, folder, "lineitem"), ["l_linestatus"], "l_quantity", "l_linenumber").select("l_linestatus", F.round("tokens_per_sec", 9).alias("tokens_per_sec"))
SQL["throughput"] = "SELECT l_linestatus, round(sum(l_quantity) / sum(l_linenumber), 9) AS tokens_per_sec FROM lineitem GROUP BY l_linestatus"


def _results(spark, folder):
    """Line items as a results table: supplier = task, line number = shots, blank where none."""
    df = load(spark, folder, "lineitem").withColumn("hit", (F.col("l_discount") > 0.05).cast("double"))
    return df.groupBy("l_suppkey").pivot("l_linenumber", [1, 2, 3, 4, 5, 6, 7]).agg(F.avg("hit"))


QUERIES["shot_curve"] = lambda spark, folder: evaluate.shot_curve(
    _results(spark, folder), ["l_suppkey"], F.concat(F.lit("suite"), F.pmod("l_suppkey", F.lit(3))), [str(i) for i in range(1, 8)]).select(
        "suite", "shots", F.round("mean_accuracy", 9).alias("mean_accuracy"), "tasks")
SQL["shot_curve"] = (
    "SELECT 'suite' || (l_suppkey % 3) AS suite, l_linenumber::VARCHAR AS shots, round(avg(a), 9) AS mean_accuracy, count(*) AS tasks FROM (SELECT l_suppkey, "
    "l_linenumber, avg((l_discount > 0.05)::INT::DOUBLE) AS a FROM lineitem GROUP BY ALL) GROUP BY 1, 2"
)

QUERIES["prediction_log"] = lambda spark, folder: evaluate.prediction_log(
    _parse(spark, folder).withColumn("prompt", F.concat(F.lit("row "), F.col("o_orderkey").cast("string"))), "prediction", "label", "prompt", ["o_orderkey"])
SQL["prediction_log"] = f"SELECT o_orderkey, prediction AS predictions, label AS labels, 'row ' || o_orderkey AS input_text FROM ({_PARSED})"


# --- prediction ------------------------------------------------------------------------------

def _rows_as_text(spark, folder, table, key, tgt):
    df = load(spark, folder, table)
    feats = [f for f in serialize.features_of(df) if f.name != tgt]
    return df.select(key, serialize.serialize(feats, SerializerConfig(style="basic")).alias("text"), F.col(tgt).cast("string").alias("class_label_as_text"))


def _predict(spark, folder):
    targets = _rows_as_text(spark, folder, "customer", "c_custkey", "c_nationkey")
    pool = _rows_as_text(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    out = infer.predict(targets, ["c_custkey"], pool, ["s_suppkey"], infer.hashed_model(["1", "2", "3"], 6), k=3, seed=6)
    return out.select("c_custkey", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), "prediction", "valid", "class_label_as_text")


_d = draws("(SELECT count(*) FROM supplier)", 3, 6, "'shots'", "c_custkey::VARCHAR")
_shot = f"SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS r, {sentences('supplier', 's_nationkey')} || '<|endinput|>' || s_nationkey || '<|endcompletion|>' AS t FROM supplier"
_prompt = (
    f"SELECT c_custkey, c_nationkey, string_agg(s.t, '' ORDER BY j) || any_value(text) || '<|endinput|>' AS prompt FROM (SELECT c_custkey, c_nationkey, text, unnest(d) AS r, "
    f"generate_subscripts(d, 1) AS j FROM (SELECT c_custkey, c_nationkey, {sentences('customer', 'c_nationkey')} AS text, {_d} AS d FROM customer)) x JOIN ({_shot}) s USING (r) "
    "GROUP BY c_custkey, c_nationkey"
)
QUERIES["batch_predict"] = _predict
SQL["batch_predict"] = (
    f"SELECT c_custkey, md5(prompt) AS prompt_md5, (['1', '2', '3'])[(('0x' || substr(md5('6:' || prompt), 1, 8))::UBIGINT % 3)::INT + 1] AS prediction, true AS valid, "
    f"c_nationkey::VARCHAR AS class_label_as_text FROM ({_prompt})"
)


_ROOM = 457  # bytes; about half of the prompts leave two or more


def _predict_rejects(spark, folder):
    """Every target comes back: with a prediction, or with the reason why the model never saw it."""
    targets = _rows_as_text(spark, folder, "customer", "c_custkey", "c_nationkey")
    pool = _rows_as_text(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    out = infer.predict(targets, ["c_custkey"], pool, ["s_suppkey"], infer.hashed_model(["1", "2", "3"], 6), k=3, seed=6, max_len=_ROOM, no_room="mark")
    return out.select("c_custkey", F.octet_length("prompt").alias("prompt_bytes"), "reason", F.when(F.col("reason").isNull(), F.col("prediction")).alias("prediction"))


QUERIES["batch_predict_rejects"] = _predict_rejects
SQL["batch_predict_rejects"] = (
    f"SELECT c_custkey, strlen(prompt)::INT AS prompt_bytes, CASE WHEN strlen(prompt) > {_ROOM - 2} THEN 'no room' END AS reason, CASE WHEN strlen(prompt) <= {_ROOM - 2} THEN "
    f"(['1', '2', '3'])[(('0x' || substr(md5('6:' || prompt), 1, 8))::UBIGINT % 3)::INT + 1] END AS prediction FROM ({_prompt})"
)


def _evaluate(spark, folder):
    s = _rows_as_text(spark, folder, "orders", "o_orderkey", "o_orderstatus").join(
        load(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("task")), "o_orderkey")
    s = s.withColumn("key", F.col("o_orderkey").cast("string"))
    preds, metrics = evaluation.run(s, ["o_orderkey"], infer.constant_model("F"), num_shots=2, model="constant")
    return metrics.where("metric not in ('low', 'high')").select("task", "metric", "value", "model", "split")


QUERIES["evaluation_run"] = _evaluate
SQL["evaluation_run"] = (
    "SELECT task, name AS metric, value, 'constant' AS model, 'test' AS split FROM (UNPIVOT (SELECT o_orderpriority AS task, avg((o_orderstatus = 'F')::INT::DOUBLE) AS "
    "accuracy_open_vocab, count(*)::DOUBLE AS samples_seen_total_open_vocab, 0.0::DOUBLE AS invalid_prediction_rate_open_vocab FROM orders GROUP BY 1) "
    "ON accuracy_open_vocab, samples_seen_total_open_vocab, invalid_prediction_rate_open_vocab INTO NAME name VALUE value)"
)


def _prompts(spark, folder):
    s = _rows_as_text(spark, folder, "part", "p_partkey", "p_type").join(load(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("task")), "p_partkey")
    s = s.withColumn("key", F.col("p_partkey").cast("string"))
    return evaluation.eval_prompts(s, ["p_partkey"], 2, 3).select("task", "key", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


_pt = (
    f"SELECT p_brand AS task, p_partkey::VARCHAR AS key, {sentences('part', 'p_type')} AS text, p_type AS y, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 3 AS b, "
    "((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 3)::INT AS slot FROM part"
)
QUERIES["few_shot_prompts"] = _prompts
SQL["few_shot_prompts"] = (
    f"WITH r AS ({_pt}) SELECT t.task, t.key, md5(coalesce(string_agg(s.text || '<|endinput|>' || s.y || '<|endcompletion|>', '' ORDER BY "
    f"{digest(3, q('shot'), 't.key', 's.slot::VARCHAR')}), '') || any_value(t.text) || '<|endinput|>') AS prompt_md5 FROM r t LEFT JOIN r s ON t.task = s.task AND t.b = s.b "
    "AND t.slot <> s.slot GROUP BY t.task, t.key"
)
