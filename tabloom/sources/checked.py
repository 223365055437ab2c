"""Parquet files whose damage is a row instead of an error, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabloom.sources.files import filesystem

BATCH_ROWS = 8192


def read_checked(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", stream: bool = False, files_per_batch: int | None = None,
) -> DataFrame:
    """The columns of ``schema``, then ``source`` (the file) and ``reason``.

    A file that cannot be read, or whose columns do not fit, gives one row with a reason and nulls; its
    rows before the damage stay. A column that a file does not have is null. Files are told to tasks by
    name and opened there; a task reads a file batch by batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema.fields], T.StructField("source", T.StringType()), T.StructField("reason", T.StringType())])
    clash = {"source", "reason"} & {n.lower() for n in schema.names}
    if clash:
        raise ValueError(f"columns of the result are in the table already: {sorted(clash)}")
    target = to_arrow_schema(made)
    names = schema.names

    def rows(path: str) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        fs, inner = filesystem(path)
        done = 0
        try:
            with fs.open_input_file(inner) as f:
                file = pq.ParquetFile(f)
                there = [n for n in names if n in file.schema_arrow.names]
                for b in file.iter_batches(BATCH_ROWS, columns=there):
                    columns = [
                        b.column(b.schema.get_field_index(n)).cast(target.field(i).type) if n in there else pa.nulls(len(b), target.field(i).type)
                        for i, n in enumerate(names)
                    ]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([path] * len(b)), pa.nulls(len(b), pa.string())], schema=target)
                    done += len(b)
        except (OSError, pa.ArrowException, ValueError) as e:
            told = f"unreadable after {done} rows: {str(e)[:200]}"
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in list(target)[:-2]], pa.array([path]), pa.array([told])], schema=target)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from rows(path)

    r = (spark.readStream if stream else spark.read).format("binaryFile").option("pathGlobFilter", glob)
    if stream:
        r = r.schema("path string, modificationTime timestamp, length long, content binary")  # what the format gives
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(folder).select("path").mapInArrow(read, made)
