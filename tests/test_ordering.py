import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import quantiles, target
from tabloom.operators.ordering import hash_position, position


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group."""
    df = spark.range(6000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))))
    return df.withColumn("v", (F.col("id") * 7919 % 1009).cast("double")).withColumn("w", F.col("id") % 5)


@pytest.mark.parametrize("group", [["g"], []])
@pytest.mark.parametrize("weight", [None, "w"])
def test_both_ways_give_the_same_positions(skewed, group, weight):
    args = dict(group=group, order=["v", "id"], out="p", total="t", weight=weight)
    a = position(skewed, **args).orderBy("id").toPandas()
    b = position(skewed, **args, limit=0).orderBy("id").toPandas()[a.columns]
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id int")
    got = sorted((r["id"], r["p"]) for r in position(df, ["g"], ["id"], out="p", limit=0).collect())
    assert got == [(1, 0), (2, 1), (3, 0)]


def test_hash_position_is_a_permutation_and_repeatable(skewed):
    a = hash_position(skewed, ["g"], 1, ["id"], "p", "n").toPandas()
    for _, part in a.groupby("g"):
        assert sorted(part["p"]) == list(range(len(part))) and set(part["n"]) == {len(part)}
    b = hash_position(skewed.repartition(7), ["g"], 1, ["id"], "p").toPandas()
    assert a.set_index("id")["p"].to_dict() == b.set_index("id")["p"].to_dict()


@pytest.mark.parametrize("limit", ["2000000", "0"])
def test_quantiles_match_numpy(spark, skewed, limit):
    spark.conf.set("spark.tabloom.maxGroupRows", limit)
    try:
        got = quantiles.even_quantiles(skewed, ["g"], "v", 7).toPandas()
    finally:
        spark.conf.unset("spark.tabloom.maxGroupRows")
    raw = skewed.toPandas()
    for g, part in got.groupby("g"):
        want = raw[raw.g == g]["v"].quantile([i / 7 for i in range(8)]).to_numpy()
        np.testing.assert_allclose(part.sort_values("i")["quantile"].to_numpy(), want, rtol=0, atol=1e-9)
        assert len(part) == 8


def test_quantiles_of_few_rows(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (4.0,)], "v double")
    got = [r["quantile"] for r in quantiles.even_quantiles(df, [], "v", 4).orderBy("i").collect()]
    assert got == [1.0, 1.75, 2.5, 3.25, 4.0]


def test_discretize(spark):
    vals = [5.0, 1.0, 3.0, 2.0, 4.0, None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = [r["v"] for r in target.discretize(df, "v", 4).orderBy("i").collect()]
    s = pd.Series(vals).dropna()
    t = [s.quantile(q / 4) for q in (1, 2, 3)]

    def name(x):
        for k, e in enumerate(t):
            if x is not None and x < e:
                return f"less than {e}" if k == 0 else f"between {t[k - 1]} and {e}"
        return f"greater than {t[-1]}"

    assert got == [name(v) for v in vals]
    th = target.fit_thresholds(df, [], "v", 4)
    same = [r["b"] for r in df.crossJoin(th).orderBy("i").select(target.bucket_label(F.col("v"), F.col("thresholds")).alias("b")).collect()]
    assert same == got
    with pytest.raises(ValueError):
        target.fit_thresholds(df, [], "v", 1)
