"""Label text: template sentences, mappings, label sets, and the row -> sample step."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.config import DataConfig, SerializerConfig
from tabloom.functions import text
from tabloom.operators.serialize import Feature, features_of, serialize

# Default names of binary labels.
BINARY_LABELS = {"1": "Yes", "1.0": "Yes", "0": "No", "0.0": "No"}


@dataclass(frozen=True)
class TaskConfig:
    """Sentences and labels of one task."""

    prefix: str
    suffix: str
    task_context: str | None = None
    labels_mapping: dict[str, str] | None = field(default_factory=lambda: dict(BINARY_LABELS))
    label_values: list | None = None

    def label_list(self) -> list[str]:
        """Distinct labels, first seen first."""
        if self.label_values:
            return list(dict.fromkeys(str(x) for x in self.label_values))
        if self.labels_mapping:
            return list(dict.fromkeys(self.labels_mapping.values()))
        raise ValueError("no label values for the task")

    def full_prefix(self) -> str:
        p = self.prefix.strip()
        return p if p.endswith(":") else p + ":"

    def full_suffix(self) -> str:
        # The test looks at the text before trimming.
        s = self.suffix.strip()
        return s if self.suffix.endswith("?") else s + "?"

    def context(self) -> str:
        return (self.task_context or "").strip()


def prefix_text(c: Column) -> Column:
    p = text.strip(c)
    return F.when(F.endswith(p, F.lit(":")), p).otherwise(F.concat(p, F.lit(":")))


def suffix_text(c: Column) -> Column:
    s = text.strip(c)
    return F.when(F.endswith(c, F.lit("?")), s).otherwise(F.concat(s, F.lit("?")))


def default_prefix(target: Column) -> Column:
    return F.concat(F.lit("Predict the "), target)


def default_suffix(target: Column) -> Column:
    return F.concat(F.lit("What is the value of "), target, F.lit("?"))


def map_label(c: Column, mapping: dict[str, str] | None, labels: list[str] | None = None) -> Column:
    """Mapped label; a value outside the mapping (or outside ``labels`` without one) is an error."""
    bad = F.raise_error(F.concat(F.lit("no such label: "), F.coalesce(c, F.lit("null"))))
    if mapping is None:
        return F.when(c.isin(labels or []), c).otherwise(bad)
    if not mapping:
        return bad
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(table[c], bad)


def reverse_label(c: Column, mapping: dict[str, str]) -> Column:
    """Original label; where several share a name, the smallest."""
    inverse: dict[str, str] = {}
    for k in sorted(mapping, reverse=True):
        inverse[mapping[k]] = k
    table = F.create_map(*[F.lit(x) for kv in inverse.items() for x in kv])
    return F.coalesce(table[c], F.raise_error(F.concat(F.lit("no such label: "), c)))


def target_feature_values(feature_list: DataFrame) -> DataFrame:
    """Mapped values of the target in a feature list (name, is_target, value_mapping)."""
    return feature_list.where("is_target").select("name", F.map_values("value_mapping").alias("values"))


def to_samples(
    df: DataFrame,
    target: str,
    serializer: SerializerConfig = SerializerConfig(),
    data: DataConfig = DataConfig(),
    task: TaskConfig | None = None,
    choices=None,
    columns: list[str] | None = None,
    row_key: Column | None = None,
    keep: list[str] | None = None,
    seed=0,
) -> DataFrame:
    """One sample per row: ``text`` and ``class_label_as_text`` (and the columns in ``keep``).

    The features are the other columns in table order. Without a task the sentences are made from
    the target's name and ``choices`` (list, array Column or null) is the label set.
    """
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    hidden = [c for c in (keep or []) if columns is None and c.startswith("__")]
    feats = features_of(df, columns, meta=data.use_metafeatures)
    feats = [f for f in feats if f.name != target and f.name not in hidden]
    label = text.py_str(F.col(f"`{target}`"), dtypes[target])
    if task is None:
        task = TaskConfig(f"Predict the {target}", f"What is the value of {target}?", labels_mapping=dict(BINARY_LABELS))
    else:
        choices = task.label_list()
    if data.targets == "map":
        label = map_label(label, task.labels_mapping, task.label_list() if task.labels_mapping is None else None)
    context = task.context() if data.use_task_context else ""
    if data.use_task_context and not context:
        raise ValueError("a task context is expected but missing")
    body = serialize(
        feats,
        serializer,
        prefix=task.full_prefix() if serializer.use_prefix else "",
        suffix=task.full_suffix() if serializer.use_suffix else "",
        choices=choices,
        context=context,
        row_key=row_key,
        seed=seed,
    )
    return df.select(*(keep or []), body.alias("text"), label.alias("class_label_as_text"))


def to_samples_by_spec(
    df: DataFrame,
    spec_cols: dict[str, str],
    columns: list[str],
    serializer: SerializerConfig = SerializerConfig(),
    row_key: Column | None = None,
    keep: list[str] | None = None,
    seed=0,
) -> DataFrame:
    """Samples of many same-schema tables whose targets differ.

    ``spec_cols`` names the columns that hold each row's target name, label and choices. A column
    is left out of the text of exactly those rows that have it as target.
    """
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    target, label = F.col(spec_cols["target"]), F.col(spec_cols["label"])
    feats = [Feature(n, F.col(f"`{n}`"), dtypes[n], present=target != n) for n in columns]
    choices = F.col(spec_cols["choices"]) if "choices" in spec_cols else None
    return df.select(*(keep or []), *sample_of(target, label, choices, serializer, feats, row_key, seed))


def sample_of(target: Column, label: Column, choices, serializer: SerializerConfig, feats: list[Feature],
              row_key: Column | None = None, seed=0, body: list[Column] | None = None) -> list[Column]:
    """``text`` and ``class_label_as_text`` of rows whose target is a column value."""
    whole = serialize(
        feats,
        serializer,
        prefix=prefix_text(default_prefix(target)) if serializer.use_prefix else "",
        suffix=suffix_text(default_suffix(target)) if serializer.use_suffix else "",
        choices=choices,
        row_key=row_key,
        seed=seed,
        body=body,
    )
    return [whole.alias("text"), label.alias("class_label_as_text")]


def drop_long(df: DataFrame, max_chars: int = 14336) -> DataFrame:
    """Samples of at most ``max_chars`` characters."""
    return df.where(F.length("text") <= max_chars)
