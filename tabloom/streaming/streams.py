"""The sample steps on Structured Streaming.

Serialization, markers, tokenization and length rules hold no state, so the batch functions are
applied to a stream as they are, with settings fitted on a batch. Only counting off fixed-size
groups needs state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tabloom.functions import hashing
from tabloom.session import scratch_path


def read_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_batch: int | None = None,
                recursive: bool = False, skip_corrupt: bool = False) -> DataFrame:
    """Parquet files of a folder as a stream. A broken file ends the stream unless it may be skipped."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("ignoreCorruptFiles", skip_corrupt)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def write_available(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Processes what is there, appends it to a parquet folder and reads that back."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint or path + "-state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def write_marked(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Writes rows that :func:`tabloom.operators.rejects.mark` marked, by outcome; returns them all and how many were kept and rejected.

    The numbers are of this run, from the metrics that each micro-batch reports.
    """
    from tabloom.operators import rejects

    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    q = (
        rejects.counted(stream, "outcomes").writeStream.format("parquet").outputMode("append").partitionBy("outcome").option("path", path)
        .option("checkpointLocation", checkpoint or path + "-state").trigger(availableNow=True).start()
    )
    told: dict[int, dict] = {}
    while True:
        over = q.awaitTermination(0.2)
        told.update({p.batchId: p.observedMetrics["outcomes"].asDict() for p in q.recentProgress if "outcomes" in p.observedMetrics})
        if over:
            break
    counts = {k: sum(t[k] for t in told.values()) for k in (rejects.KEPT, rejects.REFUSED)}
    return spark.read.schema(stream.schema).parquet(path), counts


def write_drained(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Processes what is there and goes on, without arrivals, until all rows have left the state.

    For streams whose state gives back every row by a timer, like :func:`shuffle_rows`. Timers keep a
    query alive for ever, so it is ended here, once as many rows have left as came in.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    q = (
        stream.observe("left", F.count(F.lit(1)).alias("n")).writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint or path + "-state").trigger(availableNow=True).start()
    )
    moved: dict[int, tuple[int, int]] = {}
    while q.isActive:
        for p in q.recentProgress:
            n = p.observedMetrics.get("left")
            moved[p.batchId] = (p.numInputRows, n["n"] if n else 0)
        # One empty micro-batch may be what an earlier run was stopped in; two in a row come only after all files.
        last = [moved[k][0] for k in sorted(moved)[-2:]]
        if last == [0, 0] and sum(a for a, _ in moved.values()) == sum(b for _, b in moved.values()):
            q.stop()
        else:
            q.awaitTermination(0.2)
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(path)


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Runs ``step`` on every micro-batch of what is there."""
    q = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, "state"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


def shuffle_batches(stream: DataFrame, keys: list[str], path: str, seed=0) -> DataFrame:
    """Bounded shuffle: every micro-batch is dealt and sorted by hash on its own, then appended.

    The batch number makes a repeated batch overwrite its own folder.
    """
    from tabloom.operators.sampling import shuffle_buffered

    def step(batch: DataFrame, number: int) -> None:
        shuffle_buffered(batch, keys, f"{seed}:{number}").write.mode("overwrite").parquet(f"{path}/batch={number}")

    each_batch(stream, step)
    return stream.sparkSession.read.parquet(path)


def running_accuracy(stream: DataFrame, task: list[str], prediction: str, label: str) -> DataFrame:
    """Accuracy per task over everything seen so far (update or complete mode)."""
    hit = F.coalesce(F.col(prediction), F.lit("")) == F.col(label)
    return stream.groupBy(*task).agg(
        F.sum(hit.cast("long")).alias("hits"), F.count(F.lit(1)).alias("samples"), F.avg(hit.cast("double")).alias("accuracy")
    )


def latest_totals(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs an aggregating stream to the end of what is there and returns its final rows.

    Every batch appends the updated groups with its number; the last version of a group counts.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, "totals")
    cols = [c for c in stream.columns if c not in keys]

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/n={number}")

    q = (
        stream.writeStream.outputMode("update").foreachBatch(step)
        .option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    last = spark.read.parquet(path).groupBy(*keys).agg(F.max(F.struct("__batch", *cols)).alias("l"))
    return last.select(*keys, *[F.col(f"l.{c}") for c in cols])


class _CountOff(StatefulProcessor):
    """Numbers the samples of a key in runs of ``size``; the state is two numbers, not the samples."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        for b in rows:
            pos = pd.RangeIndex(n, n + len(b))
            yield b.assign(batch=(pos // self.size).astype("int64"), slot=(pos % self.size).astype("int32"))
            n += len(b)
        self.seen.update((n,))

    def close(self) -> None:
        pass


def count_off(stream: DataFrame, shard: str, key: str, size: int = 150, *, lanes: int) -> DataFrame:
    """Adds ``lane``, ``batch`` and ``slot``: runs of ``size`` samples in order of arrival.

    Samples pass straight through; only the count is kept, so a last, shorter run needs no flush.
    ``lanes`` splits each shard by hash of the sample key, because one shard is one task's work.
    """
    laned = stream.withColumn("lane", hashing.below(F.lit(lanes), "lane", F.col(key)).cast("int"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laned.schema.fields)
    return laned.groupBy(shard, "lane").transformWithStateInPandas(
        statefulProcessor=_CountOff(size), outputStructType=f"{fields}, batch bigint, slot int",
        outputMode="Append", timeMode="None",
    )


def problem_counts(rows: DataFrame) -> DataFrame:
    """Skipped shards of a tar scan by message."""
    return rows.where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("shards"))


class _Reservoir(StatefulProcessor):
    """Holds up to ``size`` rows of a lane; from then on every arrival takes the place of a drawn one, which leaves.

    The draw is a hash of the seed, the lane and the number of the arrival, so a repeated batch draws the
    same. What is held is read and written once per micro-batch. When nothing has arrived for a while, the
    rest leaves in the order of another hash.
    """

    def __init__(self, schema, size: int, seed, flush_ms: int):
        self.schema, self.size, self.seed, self.flush_ms = schema, size, seed, flush_ms
        self.names = schema.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        from pyspark.sql.types import LongType, StructField, StructType

        self.handle = handle
        self.count = handle.getValueState("count", "arrived long, left long")
        self.held = handle.getListState("held", StructType([StructField("arrival", LongType()), *self.schema.fields]))

    def _draw(self, lane: int, what) -> float:
        return int(hashlib.md5(f"{self.seed}:{lane}:{what}".encode()).hexdigest()[:8], 16) / 4294967296.0

    def _out(self, lane: int, place: int, kept: tuple) -> Row:
        return Row(**dict(zip(self.names, kept[1:], strict=True)), lane=lane, arrival=kept[0], place=place)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        lane = key[0]
        arrived, left = self.count.get() if self.count.exists() else (0, 0)
        held = [tuple(r) for r in self.held.get()]
        for r in rows:
            new = (arrived, *(r[n] for n in self.names))
            if len(held) < self.size:
                held.append(new)
            else:
                slot = int(self._draw(lane, arrived) * self.size)
                yield self._out(lane, left, held[slot])
                held[slot], left = new, left + 1
            arrived += 1
        self.held.put(held)
        self.count.update((arrived, left))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        lane = key[0]
        arrived, left = self.count.get()
        rest = sorted((tuple(r) for r in self.held.get()), key=lambda kept: (self._draw(lane, f"rest:{kept[0]}"), kept[0]))
        for kept in rest:
            yield self._out(lane, left, kept)
            left += 1
        self.held.clear()
        self.count.update((arrived, left))

    def close(self) -> None:
        pass


def shuffle_rows(stream: DataFrame, key: str, buffer: int = 10_000, seed=0, *, lanes: int, flush_ms: int = 60_000) -> DataFrame:
    """Bounded shuffle of a stream that goes on across micro-batches: adds ``lane``, ``arrival`` and ``place``.

    Every lane (a hash of ``key``) holds ``buffer`` rows. The row that leaves for the n-th arrival is
    drawn from those that are held, so a row can leave at most ``buffer`` places earlier than it came, and
    as late as chance has it. ``arrival`` and ``place`` number the rows of a lane from 0 as they come and
    go. What is held leaves after ``flush_ms`` without arrivals; nothing is lost. State is ``buffer`` rows a lane.
    """
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    schema = stream.schema
    clash = {"lane", "arrival", "place"} & {n.lower() for n in schema.names}
    if clash:
        raise ValueError(f"columns of the result are in the stream already: {sorted(clash)}")
    laned = stream.withColumn("lane", hashing.below(F.lit(lanes), "lane", F.col(key)).cast("int"))
    made = StructType([*schema.fields, StructField("lane", IntegerType()), StructField("arrival", LongType()), StructField("place", LongType())])
    return laned.groupBy("lane").transformWithState(
        statefulProcessor=_Reservoir(schema, buffer, seed, flush_ms), outputStructType=made, outputMode="Append", timeMode="ProcessingTime"
    )
