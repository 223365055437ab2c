"""Registered queries against their SQL on the small tables. CHECK_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from tests.conftest import SF

SAMPLE = [
    "serialize_basic_v2_both", "serialize_structured", "serialize_json", "serialize_html", "serialize_with_meta", "feature_dropout", "deserialize_basic",
    "column_profile", "target_draw", "discretize_by_table", "choices_large", "interleave", "label_mask", "pack", "few_shot", "accuracy", "closed_vocabulary",
    "page_text", "metadata_text", "json_answer", "arff_scan", "synthetic_moons", "stream_accuracy",
]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = list(entry.oracle_sql()) if os.environ.get("CHECK_ALL") else SAMPLE


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    assert got == canon(cur.fetchall(), [d[0] for d in cur.description])


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["c_custkey", "text", "class_label_as_text"]
