"""The pipeline stage by stage against plain Python, each on the rows that the stage before kept."""

import hashlib
import inspect

import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tabloom.llm import mixing, quality
from tabloom.llm.registered import byte_vocabulary
from tests.conftest import SF
from tests.llm.test_dedup import plain_fingerprint, plain_groups, plain_lines


def test_stages(spark, table):
    docs, seen = table("documents"), []
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        out = stage(spark, docs, SF).persist()
        seen.append((name, docs, out))
        docs = out
    assert all(out.columns == table("documents").columns for _, _, out in seen[:-1])
    (_, raw, good), (_, _, lines), (_, _, single), (_, _, mixed), (_, _, coded) = seen

    judged = quality.judge(raw).where(F.col("quality.kept"))
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in judged.collect())
    before = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted((str(r.doc_id), r.text) for r in lines.collect()) == sorted((d, t) for d, _, _, t in plain_lines(before))
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in lines.collect()]
    assert sorted(str(r.doc_id) for r in single.collect()) == sorted(d for d, _, c in plain_groups(prints) if d == c)
    plan = {r.doc_id: r.times for r in mixing.mix(single).collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in plan.items() if n}
    v = byte_vocabulary()
    library = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={})
    want = sorted((r.doc_id, library.encode_ordinary(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r.doc_id, r.ids, r.decoded_sha256) for r in coded.collect()) == want


def test_run_is_the_stages_in_order(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "ids_sha256" in out.columns
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_odd_rows_pass_all_stages(spark, nasty, empty):
    for given in (nasty, empty):
        docs = given.drop("size", "h1", "component_id")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_clashing_columns_pass_all_stages(spark, nasty):
    docs = nasty.withColumns({c: F.lit(3) for c in ("_gone", "_again", "__key", "key", "row", "times", "n", "places", "digest", "quality")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, SF)
        assert docs.columns == before
    corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
