import pytest
from pyspark.sql import functions as F

from tabloom.functions.stats import interval
from tabloom.operators import columns, evaluate, infer, labels, pages, prompting


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_parse_completion(spark):
    def parse(t):
        r = one(spark, evaluate.parse_completion(F.lit(t)))
        return r["text"], r["valid"]

    assert parse("q?<|endinput|> Some completion. <|endcompletion|>x") == ("Some completion.", True)
    assert parse("a<|endinput|>1<|endcompletion|>b<|endinput|> two ") == (" two ", False)
    assert parse("a<|endinput|>1<|endcompletion|>b<|endinput|>2<|endcompletion|>") == ("2", True)
    assert parse("a<|endinput|><|endcompletion|>") == ("", True)
    with pytest.raises(Exception, match="no separator"):
        parse("nothing here")
    assert one(spark, evaluate.parse_completion(F.lit("nothing"), "null")) is None


def test_interval():
    lo, hi = interval([0.5, 0.0, 1.0, 0.9], [100, 10, 10, 1000])
    assert abs(lo[0] - 0.398321) < 1e-6 and abs(hi[0] - 0.601679) < 1e-6
    assert lo[1] == 0.0 and abs(hi[1] - 0.308497) < 1e-6
    assert abs(lo[2] - 0.691503) < 1e-6 and hi[2] == 1.0
    assert abs(lo[3] - 0.879727) < 2e-5


def test_empty_predictions(spark):
    df = spark.createDataFrame([], "p string, y string, ok boolean")
    r = evaluate.open_vocabulary(df, [], "p", "y", "ok").first()
    assert r["samples_seen_total_open_vocab"] == 0 and r["invalid_prediction_rate_open_vocab"] != r["invalid_prediction_rate_open_vocab"]


def test_labels(spark):
    assert labels.TaskConfig("p ", "x? ").full_suffix() == "x??" and labels.TaskConfig(" p:", "x").full_prefix() == "p:"
    assert labels.TaskConfig("p", "s").label_list() == ["Yes", "No"]
    assert labels.TaskConfig("p", "s", label_values=[3.0, 2.0, 3.0]).label_list() == ["3.0", "2.0"]
    with pytest.raises(Exception, match="no such label"):
        one(spark, labels.map_label(F.lit("7"), labels.BINARY_LABELS))
    with pytest.raises(Exception, match="no such label"):
        one(spark, labels.map_label(F.lit("7"), None, ["1"]))
    assert one(spark, labels.reverse_label(F.lit("Yes"), labels.BINARY_LABELS)) == "1"


def test_names(spark):
    assert columns.clean_name("a.b__c____d") == "a_b_c__d"
    assert one(spark, columns.file_safe(F.lit("a<b>c:d/e\\f|g?h*i"))) == "a_b_c_d_e_f_g_h_i"
    assert one(spark, columns.slug(F.lit("owner-data-set"))) == "owner/data-set"
    f = [{"name": n} for n in "abc"]
    assert [x["name"] for x in columns.describe_features(f, {"c": "d"})] == ["c", "a", "b"]
    assert [x["name"] for x in columns.subset_features(f, ["c", "a"])] == ["c", "a"]
    with pytest.raises(ValueError):
        columns.drop_features(f, ["z"])


@pytest.fixture(scope="module")
def sets(spark):
    pool = spark.createDataFrame([(i, f"row {i}", str(i % 2)) for i in range(20)], "i int, text string, class_label_as_text string")
    targets = spark.createDataFrame([(i, f"target {i}") for i in range(30)], "k int, text string")
    return targets, pool


def test_predict(sets):
    targets, pool = sets
    out = infer.predict(targets, ["k"], pool, ["i"], infer.constant_model("1"), k=3).collect()
    assert len(out) == 30 and all(r["prediction"] == "1" and r["valid"] for r in out)
    for r in out:
        parts = r["prompt"].split("<|endcompletion|>")
        assert len(parts) == 4 and len(set(parts[:3])) == 3 and parts[3] == r["text"] + "<|endinput|>"
    zero = infer.predict(targets, ["k"], None, [], infer.constant_model("1", finish=False))
    assert zero.where("valid").count() == 0
    assert infer.predict(targets, ["k"], None, [], infer.constant_model("x", False), on_invalid="null").where("prediction is null").count() == 30
    with pytest.raises(Exception, match="invalid prediction"):
        infer.predict(targets, ["k"], None, [], infer.constant_model("x", False), on_invalid="raise").collect()
    with pytest.raises(ValueError):
        infer.single_target(targets, "y")
    assert "y" in infer.single_target(targets.limit(1), "y").columns


def test_constant_answer_scores_a_quarter(spark):
    """A constant answer on four even classes, ten shots."""
    from tabloom.plans import evaluation

    s = spark.range(512).select(F.lit("dummy").alias("task"), F.col("id").cast("string").alias("key"), F.concat(F.lit("x "), "id").alias("text"),
                                (F.col("id") % 4).cast("string").alias("class_label_as_text"))
    preds, metrics = evaluation.run(s, ["key"], infer.constant_model("2"), num_shots=10)
    m = {r["metric"]: r["value"] for r in metrics.collect()}
    assert m["accuracy_open_vocab"] == 0.25 and m["samples_seen_total_open_vocab"] == 512 and m["low"] < 0.25 < m["high"]


def test_urls_and_json(spark):
    t = 'see https://a.b/c?x=1, (http://d.org/e). and https://f.com/g;"'
    assert one(spark, prompting.extract_urls(F.lit(t))) == ["https://a.b/c?x=1", "http://d.org/e)", "https://f.com/g"]
    a = 'text {"a": 1, "long": "yes"} {bad} {"b":\n 2} {"c": '
    assert one(spark, prompting.parse_json_answer(F.lit(a))) == '{"b":\n 2}'
    assert one(spark, prompting.parse_json_answer(F.lit(a), "longest")) == '{"a": 1, "long": "yes"}'
    assert one(spark, prompting.parse_json_answer(F.lit("{x}"))) is None
    with pytest.raises(Exception, match="no JSON"):
        one(spark, prompting.parse_json_answer(F.lit("plain")))


def test_context_needs_a_summary(spark):
    m = spark.createDataFrame([("t", "<metadata>nothing</metadata>")], "task string, metadata string")
    with pytest.raises(Exception, match="no task summary"):
        prompting.make_prompt(m, "task_context").collect()
    assert "{" not in prompting.make_prompt(m, "context_variants", EXAMPLE="e").first()["prompt"]


PAGE = """<html><head><style>p{}</style></head><body><!-- c --><div><h1>Subject Area</h1><span>s</span><p>Life &amp; more</p></div>
<div><h1>Feature Type</h1></div><p>not a sibling</p><h1>Dataset Information</h1><div><p>no</p>
<p class="whitespace-pre-wrap svelte-17wf9gp">About <b>it</b></p></div>
<table class="w-full x"><tr><th>h</th></tr><tr><td> a </td><td>b<br>c</td></tr><tr><td>d</td></tr></table><script>x</script></body></html>"""


def test_pages():
    f = pages.page_fields(PAGE)
    assert f == {"Subject Area": "Life & more", "Dataset Information": "About it"}
    assert pages.page_variables(PAGE) == [["a", "bc"], ["d"]]
    assert pages.page_text("<p> a </p>b<br> c<script>no</script> d<!-- x --> e &lt;") == "abcde <"
    assert pages.page_text("<p> a </p>b &amp;<i> c </i>") == "ab &c"
