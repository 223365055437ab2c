"""Column names, feature lists, value handling, per-source derivations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import text
from tabloom.operators.profile import is_missing


def clean_name(name: str) -> str:
    return name.replace(".", "_").replace("__", "_")


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def clean_name_column(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("."), F.lit("_")), F.lit("__"), F.lit("_"))


def file_safe(c: Column) -> Column:
    """Characters that file names may not hold become underscores."""
    return F.translate(c, "<>:/\\|?*", "_" * 8)


def slug(c: Column) -> Column:
    """First hyphen to a slash; one owner name (a fixed value) has a hyphen of its own."""
    first = F.regexp_replace(c, "^([^-]*)-", "$1/")
    odd = "team-ai-spam-text-message-classification"
    return F.when(c == odd, F.lit("team-ai/spam-text-message-classification")).otherwise(first)


def coerce_columns(df: DataFrame) -> DataFrame:
    """Every column as text (arrays as arrays of text)."""
    return df.select(*[text.coerce(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def to_records(df: DataFrame, out: str = "data", keep: list[str] | None = None) -> DataFrame:
    """One JSON object per row, nulls included, in column order."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        plain = text.is_number(f.dataType) or isinstance(f.dataType, T.BooleanType)
        cells.append((c if plain else text.coerce(c, f.dataType)).alias(f.name))
    return df.select(*(keep or []), F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias(out))


def row_info(target: Column, choices: Column, task: Column) -> Column:
    """JSON of target, choices and task."""
    return F.to_json(F.struct(target.alias("target"), choices.alias("target_choices"), task.alias("task")))


def bools_to_int(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(f"`{f.name}`").cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


# --- feature lists ---------------------------------------------------------------------------

FEATURE_LIST_SCHEMA = (
    "name string, description string, is_target boolean, na_values array<string>, "
    "value_mapping map<string,string>, name_extended string, note string, kind string"
)


def drop_features(features: list[dict], names: list[str]) -> list[dict]:
    _known(features, names)
    return [f for f in features if f["name"] not in names]


def subset_features(features: list[dict], names: list[str]) -> list[dict]:
    """Features in the order of ``names``."""
    _known(features, names)
    by = {f["name"]: f for f in features}
    return [by[n] for n in names]


def describe_features(features: list[dict], descriptions: dict[str, str]) -> list[dict]:
    """New descriptions; the described features come first, the rest keep their order."""
    _known(features, list(descriptions))
    by = {f["name"]: f for f in features}
    first = [{**by[n], "description": d} for n, d in descriptions.items()]
    return first + [f for f in features if f["name"] not in descriptions]


def _known(features, names):
    have = {f["name"] for f in features}
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"no such feature: {missing}")


def apply_feature_list(df: DataFrame, features: list[dict], values: str = "none", names: str = "none") -> DataFrame:
    """Keeps the listed columns in list order; optionally decodes values and extends names."""
    out = []
    for f in features:
        c = F.col(f"`{f['name']}`")
        dt = df.schema[f["name"]].dataType
        mapping = f.get("value_mapping")
        if values == "map" and mapping:
            c = decode_values(text.py_str(c, dt), mapping)
        label = f.get("name_extended") if names == "map" and f.get("name_extended") else f["name"]
        out.append(c.alias(label))
    return df.select(*out)


def decode_values(c: Column, mapping: dict[str, str]) -> Column:
    """Code -> meaning; codes outside the dictionary stay as they are."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(table[c], c)


def decode_by_table(df: DataFrame, column: str, codes: DataFrame, code: str, meaning: str) -> DataFrame:
    """The same against a dictionary table."""
    d = codes.select(F.col(code).alias("__code"), F.col(meaning).alias("__meaning"))
    shown = text.py_str(F.col(column), df.schema[column].dataType)
    return df.join(d, shown == F.col("__code"), "left").withColumn(column, F.coalesce("__meaning", shown)).drop("__code", "__meaning")


def drop_missing(df: DataFrame, how: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with a missing value, or columns that have one (one aggregation decides)."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if how == "rows":
        cond = F.lit(True)
        for f in fields:
            cond = cond & ~is_missing(F.col(f"`{f.name}`"), f.dataType)
        return df.where(cond)
    if how != "columns":
        raise ValueError(f"unknown choice: {how}")
    counts = df.agg(*[F.count_if(is_missing(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in fields]).first()
    return df.drop(*[f.name for f in fields if counts[f.name]])


def normalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation of each column, in one pass."""
    aggs = [e for c in columns for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    stats = df.agg(*aggs).first()
    return df.withColumns({c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns})


# --- per-source derivations ------------------------------------------------------------------

def nhis_diabetes(df: DataFrame) -> DataFrame:
    return df.withColumn("diabetes", F.coalesce((F.col("DIABETICAGE") <= 85).cast("int"), F.lit(0))).drop("DIABETICAGE")


def dhs_diabetes(df: DataFrame) -> DataFrame:
    return df.fillna({"ALFREQ": 998.0, "HIGHBP": 9.0, "RELIGION": 9998.0}).where(F.col("DIABETES").isin(0.0, 1.0))


def bank_marketing(df: DataFrame) -> DataFrame:
    return df.withColumn("y", F.coalesce((F.col("y") == "yes").cast("int"), F.lit(0)))


def covertype(df: DataFrame) -> DataFrame:
    return df.withColumn("Cover_Type", F.coalesce(F.col("Cover_Type") == 2, F.lit(False)))


def magic_telescope(df: DataFrame) -> DataFrame:
    named = df.withColumn("is_signal", F.coalesce((F.col("class") == "g").cast("int"), F.lit(0))).drop("class")
    return named.toDF(*[c if c == "is_signal" else c + ":" for c in named.columns])


def road_safety(df: DataFrame) -> DataFrame:
    return df.where(F.col("Sex_of_Driver").cast("string").isin("1.0", "2.0"))


PREPROCESS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "nhis_diabetes": nhis_diabetes,
    "dhs_diabetes": dhs_diabetes,
    "bank_marketing": bank_marketing,
    "covertype": covertype,
    "magic_telescope": magic_telescope,
    "road_safety": road_safety,
}
