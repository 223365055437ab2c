"""A table as its settings want it, before rows become text: everything ``DataConfig`` says about columns and values."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabloom.config import DataConfig
from tabloom.functions import text
from tabloom.operators import baselines, columns, metafeatures
from tabloom.operators.serialize import shuffled_columns


def prepare(df: DataFrame, target: str, config: DataConfig = DataConfig(), features: list[dict] | None = None, table: str = "", seed=0) -> DataFrame:
    """The table under ``config``, in this order: feature list, missing values, numbers, metafeatures, column order.

    ``feature_values`` and ``feature_names`` choose whether the list's dictionaries and long names apply
    (``target`` is the name after that); ``dropna`` drops rows, or columns other than the target, that miss
    a value; ``numeric="normalize"`` takes mean and deviation out of numbers other than the target, and
    ``categorical="label_encode"`` numbers the values of other columns in sorted order;
    ``use_metafeatures`` adds scale and quantile of them, rounded to ``metafeatures_precision``;
    ``shuffle_table_features`` gives the whole table one hashed order of columns, the target last.
    """
    if features:
        df = columns.apply_feature_list(df, features, config.feature_values, config.feature_names)
    elif "map" in (config.feature_values, config.feature_names):
        raise ValueError("values or names are to be mapped, but there is no feature list")
    if config.dropna == "columns":
        df = columns.drop_missing(df, "columns", [c for c in df.columns if c != target])
    elif config.dropna:
        df = columns.drop_missing(df, config.dropna)
    names = df.columns
    numbers = [f.name for f in df.schema.fields if f.name != target and text.is_number(f.dataType)]
    if config.numeric == "normalize":
        df = columns.normalize(df, numbers)
    elif config.numeric != "none":
        raise ValueError(f"unknown choice: {config.numeric}")
    if config.categorical == "label_encode":
        rest = [n for n in names if n != target and n not in numbers]
        df = baselines.label_encode(df, df.limit(0), rest)[0].select(*[f"`{n}`" for n in names])
    elif config.categorical != "none":
        raise ValueError(f"unknown choice: {config.categorical}")
    if config.use_metafeatures and numbers:
        digits = config.metafeatures_precision
        df = metafeatures.scaled(metafeatures.quantile_by_rank(df, numbers, digits), numbers, digits)
    if config.shuffle_table_features:
        order = shuffled_columns([n for n in names if n != target], table, seed)
        last = [target] if target in names else []
        df = df.select(*[f"`{n}`" for n in [*order, *last, *[c for c in df.columns if c not in names]]])
    return df
