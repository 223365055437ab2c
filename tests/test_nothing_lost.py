"""Input that used to vanish: null keys, unreadable files, malformed pages."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import baselines, pages, packing, profile, target, tokenize
from tabloom.operators.shards import table_of_key
from tabloom.sources import tables


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "x"), (4, None, "z")], "id int, g string, y string")
    for inline in (100, 0):
        got = {r.id: sorted(r.choices) for r in target.with_choices(df, ["g"], "y", ["id"], inline=inline).collect()}
        assert got == {1: ["x", "y"], 2: ["x", "y"], 3: ["x", "z"], 4: ["x", "z"]}
    counts = profile.value_counts(df, "y", ["g"])
    assert counts.count() == 4 and counts.agg(F.sum("share")).first()[0] == 2


def test_null_batches_are_padded(spark):
    df = spark.createDataFrame([(None, [1, 2], [1, 2]), (None, [3], [3]), (1, [4], [4])], "b int, input_ids array<int>, labels array<int>")
    got = sorted((str(r.b), len(r.input_ids)) for r in tokenize.pad_batches(df, ["b"]).collect())
    assert got == [("1", 1), ("None", 2), ("None", 2)]


def test_packing_loses_no_token(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}__{i}", list(range(i % 7)), list(range(i % 7))) for i in range(100)], "i int, key string, input_ids array<int>, labels array<int>")
    got = packing.pack(df, [], ["i"], "key", 10, 25)
    assert got.agg(F.sum(F.size("input_ids"))).first()[0] == sum(i % 7 for i in range(100))
    cut = packing.pack(df, [], ["i"], "key", 10, 25, tail="drop")
    assert cut.agg(F.sum(F.size("input_ids") + F.col("dropped"))).first()[0] == sum(i % 7 for i in range(100))


def test_long_few_shot_keeps_the_label(spark):
    rows = [(i, f"t__{i}", [256] + [i] * 20 + [99], [-100] * 21 + [99]) for i in range(8)]
    df = spark.createDataFrame(rows, "i int, key string, input_ids array<int>, labels array<int>")
    for limit in (30, 10):
        for r in packing.few_shot(df, [], ["i"], ["key"], 3, limit).collect():
            assert len(r.input_ids) == limit == len(r.labels) and r.labels[-1] == 99 and r.n_cut > 0


def test_malformed_page_keeps_its_text(spark):
    df = spark.createDataFrame([(1, "<p>a<![foo bar]>b</p>"), (2, "<p>c</p>"), (3, None)], "id int, html string")
    assert pages._Text().run("<p>a<![foo bar]>b</p>").parts == ["ab"]
    assert df.count() == 3


def test_unreadable_table_is_an_error(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad.parquet").write_bytes(b"no parquet at all")
    files = tables.list_tables(spark, str(tmp_path))
    with pytest.raises(OSError, match="1 unreadable tables"):
        tables.schema_groups(files)
    groups, _ = tables.schema_groups(files, skip_unreadable=True)
    assert len(groups) == 1


def test_boosting_of_three_classes(spark):
    rows = [(float(i), float(i // 20), i // 20) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    _, m = baselines.train_and_score(df, df, ["a", "b"], "y", "boosted_trees", n_trials=1)
    assert m["acc"] > 0.9 and m["n_train"] == 60


def test_double_underscores_in_a_path_keep_tables_apart(spark):
    df = spark.createDataFrame([("lake__a/x.parquet__0",), ("lake__a/y.parquet__7",), ("plain",)], "key string")
    assert [r[0] for r in df.select(table_of_key(F.col("key"))).collect()] == ["lake__a/x.parquet", "lake__a/y.parquet", "plain"]


def test_baseline_trials_read_the_rows_once_and_in_turn(spark, monkeypatch):
    from pyspark.ml import tuning

    seen, threads = spark.sparkContext.accumulator(0), []
    real = tuning.ThreadPool
    monkeypatch.setattr(tuning, "ThreadPool", lambda processes: threads.append(processes) or real(processes=processes))

    @F.udf("double")
    def told(i):
        seen.add(1)
        return float(i % 5)

    df = spark.range(60).select(told("id").alias("a"), (F.col("id") % 2).alias("y"))
    _, m = baselines.train_and_score(df, df, ["a"], "y", n_trials=3, max_iter=3)
    assert m["n_train"] == 60 and seen.value == 120 and threads == [1]
