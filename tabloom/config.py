"""Settings with the defaults the samples were defined with."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TargetConfig:
    """Choice of the prediction target of a table that names none."""

    selection: str = "random"  # random | max | topk | temperature
    k: int = 3
    temperature: float = 1.0
    require_nonunique: bool = True
    min_unique_values: int = 2
    drop_numeric: bool = False
    p_numeric: float = 0.1
    drop_dates: bool = True
    max_choices: int = 8
    max_label_chars: int = 256
    null_is_value: bool = True
    min_buckets: int = 2
    max_buckets: int = 8


@dataclass(frozen=True)
class SerializerConfig:
    """Text form of a row."""

    style: str = "basic_v2"
    shuffle_features: bool = False
    feature_dropout: float = 0.0
    use_prefix: bool = True
    use_suffix: bool = True
    choices_position: str = "both"  # front | back | both
    max_precision: int | None = None
    strict: bool = False


@dataclass(frozen=True)
class DataConfig:
    """Treatment of values and assembly of training samples."""

    feature_values: str = "none"  # none | map
    feature_names: str = "none"  # none | map
    targets: str = "none"  # none | map
    numeric: str = "none"  # none | normalize
    categorical: str = "none"  # none | label_encode
    dropna: str | None = None  # rows | columns | None
    use_task_context: bool = False
    use_metafeatures: bool = False
    metafeatures_precision: int = 2
    shuffle_table_features: bool = False
    too_long: str = "drop"  # drop | warn
    pack: bool = True
    pack_batch: int = 150
    merge_by_key: bool = True
    trim_extra_bos: bool = False
    num_shots: int = 0
    max_len: int = 4096
    tokenize_batch: int = 1000


@dataclass(frozen=True)
class PipelineConfig:
    """Batch conversion of many tables into sample shards."""

    max_tables: int | None = None
    train_frac: str = "0.975"  # decimal text: 1 - 0.975 is not exact in binary
    traineval_frac: str = "0.01"
    split_seed: int = 42
    chunk_size: int = 64
    target_shard_mb: int = 500
    max_chars: int = 14336  # 4096 tokens of about 3.5 characters
    file_prefix: str | None = None
