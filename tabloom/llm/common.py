"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, and the letters that are lower-cased.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the table does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, everything else as it is."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """The runs of characters between white space, in order."""
    return F.array_remove(F.split(F.translate(c, SPACES, " " * len(SPACES)), " "), "")


def map_batches(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]]) -> DataFrame:
    """``mapInArrow`` for functions that make one dict of columns per batch.

    ``start`` runs once per task and returns the function, so that it can keep a bounded cache.
    """
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            for made in each(batch):
                yield pa.RecordBatch.from_arrays(
                    [_array(made[f.name], f.type) for f in target], schema=target
                )

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values.cast(kind)
    return pa.array(values, type=kind)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def type_of(df: DataFrame, column: str) -> str:
    """The column's type as written in a schema string."""
    return df.schema[column].dataType.simpleString()
