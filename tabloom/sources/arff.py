"""ARFF tables: the head names and types the columns, the data lines are CSV."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATTRIBUTE = re.compile(r"""^\s*@attribute\s+('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\S+)\s+(.+?)\s*$""", re.IGNORECASE)


def parse_head(lines: list[str]) -> list[tuple[str, str]]:
    """(name, type) of each @attribute line."""
    out = []
    for line in lines:
        m = _ATTRIBUTE.match(line)
        if m:
            name = m.group(1)
            out.append((name[1:-1] if name[0] in "'\"" else name, m.group(2)))
    return out


def _spark_type(kind: str) -> T.DataType:
    return T.DoubleType() if kind.split()[0].lower() in ("numeric", "real", "integer") else T.StringType()


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """A dense ARFF file. Only the attribute lines reach the driver."""
    lines = spark.read.text(path)
    heads = lines.where(F.regexp_like("value", F.lit(r"(?i)^\s*@attribute\s"))).collect()
    attributes = parse_head([r["value"] for r in heads])
    schema = T.StructType([T.StructField(f"c{i}", _spark_type(k)) for i, (_, k) in enumerate(attributes)])
    data = lines.where(~F.regexp_like("value", F.lit(r"^\s*(@|%|$)")))
    row = F.from_csv(
        "value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
        {"nullValue": "?", "quote": "'", "escape": "\\", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"},
    )
    return data.select(row.alias("r")).select("r.*").toDF(*[n for n, _ in attributes])
