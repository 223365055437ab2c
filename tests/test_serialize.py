import json

import pytest
from pyspark.sql import functions as F

from tabloom.config import SerializerConfig
from tabloom.operators import serialize as S

CTX, PRE, SUF = "Houses of a small town.", "One house follows.", "Is it heated with gas?"


def row(spark, schema, *vals):
    return spark.createDataFrame([vals], schema)


def one(df, **kw):
    style = kw.pop("style", "basic")
    cfg = SerializerConfig(style=style, choices_position=kw.pop("pos", "both"), **kw.pop("cfg", {}))
    feats = kw.pop("features", None) or S.features_of(df, kw.pop("columns", None), meta=kw.pop("meta", False))
    return df.select(S.serialize(feats, cfg, **kw)).first()[0]


@pytest.fixture(scope="module")
def plain(spark):
    return row(spark, "height double, floors int, roof string", 9.125, 3, "red tiles")


def test_basic(plain):
    kv = "The height is 9.125. The floors is 3. The roof is red tiles."
    assert one(plain) == kv
    args = dict(prefix=PRE, suffix=SUF, choices=["yes", "no"], context=CTX)
    assert one(plain, **args) == f"{CTX} {PRE} yes or no {kv} {SUF} yes or no"
    assert one(plain, style="basic_v2", **args) == f"{CTX} {PRE} ||yes||no|| {kv} {SUF} ||yes||no||"
    assert one(plain, style="basic_v2", pos="front", **args) == f"{CTX} {PRE} ||yes||no|| {kv} {SUF}"
    assert one(plain, style="basic_v2", pos="back", **args) == f"{CTX} {PRE} {kv} {SUF} ||yes||no||"


def test_strict(spark, plain):
    with pytest.raises(ValueError):
        one(plain, suffix="Bad. suffix", cfg={"strict": True})
    df = row(spark, "f double, f_2 double", 1.0, 2.0)
    with pytest.raises(ValueError):
        one(df, cfg={"strict": True})


def test_values_are_trimmed(spark):
    df = row(spark, "a string, b string, c boolean, d double, e array<string>", " x. ", "y..", True, None, ["p", None])
    assert one(df) == "The a is x. The b is y.. The c is True. The d is nan. The e is ['p', 'None']."


META_SCHEMA = ("height double, floors int, roof string, lift boolean, height__quantile double, floors__quantile double, "
               "height__scale double, floors__scale double")


def test_basic_meta(spark):
    df = row(spark, META_SCHEMA, 9.125, 3, "red tiles", True, 0.75, 0.5, 1.5, -0.125)
    assert one(df, meta=True) == (
        "The height is 9.125 (quantile:0.75, scale:1.5). The floors is 3 (quantile:0.5, scale:-0.125). "
        "The roof is red tiles. The lift is True."
    )


def test_structured(spark):
    df = row(spark, "height double, floors int, roof string", 7.5, 2, "slate")
    got = one(df, style="structured", prefix=PRE, suffix=SUF, choices=["yes", "no"], context=CTX)
    body = "".join(f"<|KEY|>{k}<|/KEY|><|VALUE|>{v}<|/VALUE|>" for k, v in
                   (("height", "7.5"), ("floors", "2"), ("roof", "slate")))
    ch = "<|CHOICES|>yes||no<|/CHOICES|>"
    assert got == f"{CTX}<|PREFIX|>{PRE}<|/PREFIX|>{ch}<|EXAMPLE|>{body}<|/EXAMPLE|><|SUFFIX|>{SUF}<|/SUFFIX|>{ch}"


DICT_SCHEMA = "slope double, lift boolean, built int, roof string"


def test_json(spark):
    df = row(spark, DICT_SCHEMA, 0.0625, True, 1911, "slate")
    got = one(df, style="json", prefix=PRE, suffix=SUF, choices=["gas", "oil", "wood"], context=CTX)
    want = {"task_context": CTX, "prefix": PRE,
            "features": {k: {"value": v} for k, v in df.first().asDict().items()},
            "suffix": SUF, "choices": ["gas", "oil", "wood"]}
    assert got == json.dumps(want)
    odd = row(spark, "s string, d double", 'q"\\é\n\U0001f600\x7f', 1e-6)
    assert one(odd, style="json") == json.dumps({"features": {"s": {"value": odd.first()[0]}, "d": {"value": 1e-6}}})
    back = df.select(S.deserialize_json(F.lit(got)).alias("m")).first()["m"]
    assert back["built"]["value"] == "1911" and back["lift"]["value"] == "true"


def test_pandas_style(spark):
    df = row(spark, DICT_SCHEMA, 0.0625, True, 1911, "owner's")
    want = {"task_context": CTX, "features": {k: {"value": v} for k, v in df.first().asDict().items()}, "choices": "gas or oil"}
    assert one(df, style="pandas", choices=["gas", "oil"], context=CTX) == f"pd.Series({want})"


def test_html(spark):
    import pandas as pd

    df = row(spark, DICT_SCHEMA, 2e-7, False, 1911, "tiles <new> & 'old'")
    want = {"task_context": CTX, "prefix": PRE, "features": {k: {"value": v} for k, v in df.first().asDict().items()},
            "suffix": SUF, "choices": "gas or oil or wood"}
    html = pd.Series(want).to_frame().to_html()
    args = dict(prefix=PRE, suffix=SUF, choices=["gas", "oil", "wood"], context=CTX)
    assert one(df, style="html", **args) == html
    import re

    assert one(df, style="html_compact", **args) == re.sub(r">\s+<", "><", html)
    wide = row(spark, ", ".join(f"c{i} int" for i in range(120)), *range(120))
    with pd.option_context("display.max_seq_items", None):
        want = pd.Series({"features": {f"c{i}": {"value": i} for i in range(120)}}).to_frame().to_html()
    assert one(wide, style="html") == want


def test_round_trip(spark):
    df = row(spark, "height double, floors int, roof string", 11.25, 4, "thatch")
    names = df.columns
    want = {"height": "11.25", "floors": "4", "roof": "thatch"}
    t = one(df)
    assert df.select(S.deserialize_basic(F.lit(t), names)).first()[0] == want
    assert df.select(F.map_keys(S.deserialize_basic(F.lit(t), names[::-1]))).first()[0] == names
    t = one(df, style="structured")
    assert df.select(S.deserialize_structured(F.lit(t))).first()[0] == want
    with pytest.raises(Exception, match="bad example"):
        df.select(S.deserialize_structured(F.lit(t.replace("<|/KEY|>", "", 1)))).collect()
    with pytest.raises(Exception, match="expected key"):
        df.select(S.deserialize_basic(F.lit("The a is 1."), ["a", "b"])).collect()
    assert df.select(S.deserialize_basic(F.lit("The a is 1."), ["a", "b"], True)).first()[0] == {"a": "1"}


def test_shuffle_and_dropout(spark):
    n = 100_000
    df = spark.range(n).select("id", *[F.lit(i).alias(f"f{i}") for i in range(5)])
    feats = S.features_of(df, [f"f{i}" for i in range(5)])
    t = S.serialize(feats, SerializerConfig(style="basic", feature_dropout=0.5), row_key=F.col("id"))
    rates = df.select(t.alias("t")).agg(*[F.avg((~F.contains("t", F.lit(f"f{i} "))).cast("int")) for i in range(5)]).first()
    assert all(abs(r - 0.5) < 0.01 for r in rates)
    t = S.serialize(feats, SerializerConfig(style="basic", shuffle_features=True), row_key=F.col("id"))
    assert df.limit(5000).select(t.alias("t")).distinct().count() == 120


def test_default_style_runs_no_python(spark, plain):
    feats = S.features_of(plain)
    df = plain.select(S.serialize(feats, SerializerConfig(feature_dropout=0.1, shuffle_features=True),
                                  prefix=PRE, suffix=SUF, choices=["a", "b"], row_key=F.col("floors")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDF" not in plan


def test_a_table_is_prepared_as_its_settings_say(spark):
    from tabloom.config import DataConfig
    from tabloom.plans.prepare import prepare

    df = spark.createDataFrame([(1, 2.0, "b", "x"), (2, None, "a", "y"), (3, 4.0, "b", None)], "id int, v double, c string, y string")
    assert prepare(df, "y").columns == df.columns
    assert [r["id"] for r in prepare(df, "y", DataConfig(dropna="rows")).collect()] == [1]
    assert prepare(df, "y", DataConfig(dropna="columns")).columns == ["id", "c", "y"]
    coded = {r["id"]: r["c"] for r in prepare(df, "y", DataConfig(categorical="label_encode")).collect()}
    assert coded == {1: 1, 2: 0, 3: 1}
    scaled = {r["y"]: r["v"] for r in prepare(df, "y", DataConfig(numeric="normalize")).collect()}
    assert scaled == {"x": -1.0, "y": None, None: 1.0}
    orders = {tuple(prepare(df, "y", DataConfig(shuffle_table_features=True), table=str(t)).columns) for t in range(20)}
    assert len(orders) > 2 and all(o[-1] == "y" and sorted(o) == sorted(df.columns) for o in orders)
    for bad in (DataConfig(numeric="no"), DataConfig(categorical="no"), DataConfig(feature_values="map")):
        with pytest.raises(ValueError):
            prepare(df, "y", bad)
