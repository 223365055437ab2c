"""Target-distribution importance resampling: a sample of documents that looks like a target.

Every document and every target text is a bag of hashed features. A bucket that the target holds more
often than the documents do adds to a document's weight, one that it holds less often takes away. A
seeded Gumbel number per document turns the weights into scores, so that the highest scores are a draw
without replacement in proportion to the weights.

The scores are ranked by parallel sorting by regular sampling: every run (a bounded share of the rows,
dealt evenly) is sorted where it lies and names splitters at regular places; the splitters of all runs
cut the order into segments; each run counts its rows per segment, and the running total of the counts
says which ranks a segment holds. Only the segments that reach into the draw are exchanged, and each is
merged by one task. No task sees more than a run or a segment.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import LOWER, UPPER, arrow_schema, type_of
from tabloom.session import scratch_path

BUCKETS = 10_000
RUN_ROWS = 1 << 18  # rows a run is meant for
SPLITTERS = 1 << 18  # regular places named by all runs together, at most
BLOCK_BYTES = 1 << 20  # bytes of a text whose words are held at a time

# The bytes that are no part of a word. All others are, those of longer characters included.
_BREAKS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_KEYS = ("score", "doc_id", "n_features", "row")  # what the ranks go by


def _word_table() -> bytes:
    table = bytearray(range(256))
    for up, low in zip(UPPER, LOWER, strict=True):
        table[ord(up)] = ord(low)
    for b in _BREAKS:
        if chr(b) not in UPPER:
            table[b] = 0x20
    return bytes(table)


WORD_TABLE = _word_table()


def blocks_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in order, some hundred thousand at a time."""
    plain, at = text.translate(WORD_TABLE), 0
    while at < len(plain):
        stop = plain.find(b" ", at + BLOCK_BYTES)
        stop = len(plain) if stop < 0 else stop
        yield [w for w in plain[at:stop].split(b" ") if w]
        at = stop


def buckets_of(text: bytes, max_run: int = 1, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The bucket of every feature of a text, repeats included, block by block: runs of 1 to ``max_run`` words."""
    before: list[bytes] = []  # words whose runs may go on in this block
    for words in blocks_of(text):
        runs: list[bytes] = words
        if max_run > 1:
            both, lead = before + words, len(before)
            runs = [b" ".join(both[end - n : end]) for n in range(1, max_run + 1) for end in range(max(n, lead + 1), len(both) + 1)]
            before = both[-(max_run - 1) :]
        yield np.fromiter(map(zlib.crc32, runs), dtype=np.int64, count=len(runs)) % buckets


def _raw(text: str):
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def bucket_counts(texts: DataFrame, text: str = "text", max_run: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket.

    Every task adds up its own array; what is collected is one row per bucket, whatever the table.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                for found in buckets_of(t.as_py(), max_run, buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    part = texts.select(_raw(text).alias("t")).mapInArrow(add_up, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in part.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds: a thousand times the log ratio of the smoothed shares, rounded down."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = (target + 1.0) * (s + n) / ((source + 1.0) * (t + n))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], dtype=np.int64)


def gumbel(seed: str, doc_id: int | None) -> int:
    """The seeded number of a document; rows without an id share one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(
    docs: DataFrame, gains: np.ndarray, seed: str, doc_id: str = "doc_id", text: str = "text", max_run: int = 1, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, n_words) and the columns ``keep``: one per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # a number per bucket
    kept = "".join(f", `{c}` {type_of(docs, c)}" for c in keep)
    schema = f"doc_id long, n_features long, weight long, score long, n_words long{kept}"
    target = arrow_schema(docs.sparkSession, schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py()
                weight = n = 0
                for found in buckets_of(raw, max_run, len(gain)):
                    weight, n = weight + int(gain[found].sum()), n + len(found)
                n_words = n if max_run == 1 else sum(map(len, blocks_of(raw)))
                rows.append((key, n, weight, weight + gumbel(seed, key), n_words))
            made = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), target, strict=False)]
            yield pa.RecordBatch.from_arrays([*made, *(batch.column(2 + i).cast(target.field(5 + i).type) for i in range(len(keep)))], schema=target)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), _raw(text).alias("t"), *keep).mapInArrow(score, schema)


# --- ranks by regular sampling -----------------------------------------------------------------


def _key(score: int, doc_id: int | None, features: int, row: int) -> tuple:
    """Sorts as the ranks do: high scores first, then small ids, then rows without one."""
    return -score, doc_id is None, doc_id or 0, features, row


def segments_of(batch: pa.RecordBatch, splitters: list[tuple]) -> np.ndarray:
    """The segment of each row: how many splitters lie before it. Most are settled by the score alone."""
    score = batch.column("score").to_numpy()
    tops = np.array([s[0] for s in splitters], dtype=np.int64)
    low, high = np.searchsorted(tops, -score, "left"), np.searchsorted(tops, -score, "right")
    tied = np.flatnonzero(low < high)
    for k, *key in zip(tied.tolist(), *(batch.column(c).take(pa.array(tied)).to_pylist() for c in _KEYS), strict=True):
        low[k] = bisect_left(splitters, _key(*key), int(low[k]), int(high[k]))
    return low


def ranked(rows: DataFrame, drawn: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """Adds ``rank`` (from 1; null beyond ``drawn``) to a table with score, doc_id and n_features.

    High scores first, then small ids, null ids last, then fewer features; rows equal in all that come
    in any order. Runs and segments are written to the shared folder.
    """
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    runs = max(2, -(-rows.count() // run_rows))
    # The number of a row is its run's and its place in it. It is fixed once the runs are written.
    path = scratch_path(spark, "runs")
    rows.repartition(runs).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    lain = spark.read.parquet(path)
    run, place = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    sizes = lain.groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("n"))  # a row per run
    places = max(1, min(runs, SPLITTERS // runs))
    regular = lain.select(*_KEYS, run.alias("run"), place.alias("place")).join(F.broadcast(sizes), "run").where(
        "place * %d div n > (place - 1) * %d div n" % (places, places)
    )
    named = sorted(_key(*r) for r in regular.select(*_KEYS).collect())
    splitters = [named[len(named) * i // runs] for i in range(1, runs)] if named else []
    shared = spark.sparkContext.broadcast(splitters)  # fewer than there are runs

    def cut(batches):
        for batch in batches:
            segment = pa.array(segments_of(batch, shared.value).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, segment], names=[*batch.schema.names, "segment"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lain.schema) + ", segment int"
    path = scratch_path(spark, "segments")
    lain.mapInArrow(cut, schema).write.parquet(path)
    placed = spark.read.parquet(path)
    held = {r["segment"]: r["n"] for r in placed.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, reach = [], 0
    for s in sorted(held):
        offsets.append((s, reach))
        reach += held[s]
    offsets = [(s, at) for s, at in offsets if at < drawn]
    within = Window.partitionBy("segment").orderBy(*order, "row")
    rank = F.col("offset") + F.row_number().over(within)
    first = F.broadcast(spark.createDataFrame(offsets, "segment int, offset long"))
    last = max((s for s, _ in offsets), default=-1)
    reaching = placed.where(F.col("segment") <= last).repartition(max(1, len(offsets)), "segment").join(first, "segment")
    merged = reaching.withColumn("rank", F.when(rank <= drawn, rank)).select(*rows.columns, "rank")
    beyond = placed.where(F.col("segment") > last).select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return merged.unionByName(beyond)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: str = "2024", doc_id: str = "doc_id", text: str = "text",
    target_text: str = "text", max_run: int = 1, buckets: int = BUCKETS, keep: tuple[str, ...] = (), run_rows: int = RUN_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (all long), then the columns ``keep``.

    ``rank`` counts the drawn documents from 1, highest score first, ties to the smaller doc_id; it is
    null for the others. Drawn are ``percent`` of the documents of at least ``min_words`` words, rounded
    down. A null or empty text has no features and weight 0; an empty target smooths alike everywhere.
    Rows without an id share one seeded number and come last among equal scores. Rows that repeat an id
    are documents of their own. Columns not named in ``keep`` are not read, and those may be called
    anything but the five of the result.
    """
    clash = {c.lower() for c in keep} & {"doc_id", "n_features", "weight", "score", "rank"}
    if clash:
        raise ValueError(f"columns of the result cannot be kept: {sorted(clash)}")
    spark = docs.sparkSession
    gains = gains_of(bucket_counts(docs, text, max_run, buckets), bucket_counts(target, target_text, max_run, buckets))
    # Kept columns travel under names of their own, so that none meets a working column.
    inner = {c: f"__kept_{i}" for i, c in enumerate(keep)}
    base = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), *[F.col(c).alias(k) for c, k in inner.items()])
    path = scratch_path(spark, "scored")
    scored(base, gains, seed, "__id", "__text", max_run, tuple(inner.values())).write.parquet(path)
    stored = spark.read.parquet(path)
    eligible = stored.where(F.col("n_words") >= min_words)
    drawn = percent * eligible.count() // 100
    out = ["doc_id", "n_features", "weight", "score", "rank", *inner.values()]
    short = stored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")).select(*out)
    return ranked(eligible, drawn, run_rows).select(*out).unionByName(short).withColumnsRenamed({k: c for c, k in inner.items()})
