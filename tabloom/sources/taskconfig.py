"""Task configurations from YAML files, as a table and as a lookup."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.labels import TaskConfig
from tabloom.sources.synthetic import GENERATORS

SCHEMA = "task string, prefix string, suffix string, task_context string, labels_mapping map<string,string>, label_values array<string>, problem string"
REQUIRED = ("prefix", "suffix", "labels_mapping")


def parse_flat_yaml(source: str) -> dict:
    """The YAML such files use: scalars, one level of lists and of maps, quoted or folded text."""
    try:
        import yaml

        return yaml.safe_load(source) or {}
    except ImportError:
        pass

    def scalar(s: str):
        s = s.strip()
        if s in ("", "null", "~"):
            return None
        if len(s) > 1 and s[0] == s[-1] == "'":
            return s[1:-1].replace("''", "'")
        if len(s) > 1 and s[0] == s[-1] == '"':
            return json.loads(s)
        for cast in (int, float):
            try:
                return cast(s)
            except ValueError:
                continue
        return {"true": True, "false": False}.get(s, s)

    out: dict = {}
    key = None
    for line in source.splitlines():
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        nested = line[0] == " "
        if body.startswith("- "):
            out[key] = (out[key] or []) + [scalar(body[2:])]
        elif nested and isinstance(out[key], str):
            out[key] = f"{out[key]} {body}"  # folded text
        elif nested:
            k, _, v = body.partition(":")
            out[key] = {**(out[key] or {}), scalar(k): scalar(v)}
        else:
            key, _, v = line.partition(":")
            out[key] = scalar(v)
    return out


def from_yaml(source: str, required: tuple[str, ...] = REQUIRED) -> tuple[TaskConfig, list[str]]:
    """Configuration and the required fields it lacks."""
    d = parse_flat_yaml(source)
    missing = [f for f in required if f not in d]
    known = {k: d[k] for k in ("prefix", "suffix", "task_context", "labels_mapping", "label_values") if k in d}
    known.setdefault("prefix", "")
    known.setdefault("suffix", "")
    if known.get("labels_mapping"):
        known["labels_mapping"] = {str(k): str(v) for k, v in known["labels_mapping"].items()}
    return TaskConfig(**known), missing


def to_yaml(c: TaskConfig) -> str:
    """The same fields as YAML text, keys in alphabetical order."""
    def scalar(v):
        return "null" if v is None else (json.dumps(v) if isinstance(v, str) else str(v))

    out = []
    for k in ("label_values", "labels_mapping", "prefix", "suffix", "task_context"):
        v = getattr(c, k)
        if isinstance(v, list):
            out += [f"{k}:"] + [f"- {scalar(x)}" for x in v]
        elif isinstance(v, dict):
            out += [f"{k}:"] + [f"  {scalar(a)}: {scalar(b)}" for a, b in v.items()]
        else:
            out.append(f"{k}: {scalar(v)}")
    return "\n".join(out) + "\n"


def synthetic_config() -> TaskConfig:
    """Configuration of the toy tables: class numbers, also when written as floats."""
    mapping = {str(float(x)): str(x) for x in range(10)} | {str(x): str(x) for x in range(10)}
    return TaskConfig(
        "Tell from the coordinates of a point which group it was drawn from.", "Which group is it?",
        "Points in the plane, drawn around a few centres.", mapping,
    )


def read_configs(spark: SparkSession, roots: str) -> DataFrame:
    """Configurations below the colon-separated folders; a task is named by its folder.

    Files are parsed in tasks; a broken file gets a ``problem`` instead of failing the scan.
    """
    def parse(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for task, source in zip(b["task"], b["value"]):
                try:
                    c, missing = from_yaml(source)
                    rows.append((task, c.prefix, c.suffix, c.task_context, c.labels_mapping,
                                 None if c.label_values is None else [str(x) for x in c.label_values],
                                 f"missing: {missing}" if missing else None))
                except Exception as e:
                    rows.append((task, None, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.replace("map<string,string>", "m").split(", ")])

    out = None
    for root in [r for r in roots.split(":") if r]:
        full = root.rstrip("/")
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.yaml").text(full, wholetext=True)
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        task = F.regexp_replace(F.substring_index(folder, full + "/", -1), "^/", "")
        part = files.select(task.alias("task"), "value").mapInPandas(parse, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def registry(configs: DataFrame | None = None) -> dict[str, TaskConfig]:
    """Configurations by task (a few hundred at most), toy tables included."""
    out = {name: synthetic_config() for name in GENERATORS}
    if configs is not None:
        for r in configs.where("prefix is not null").collect():
            out[r["task"]] = TaskConfig(r["prefix"], r["suffix"], r["task_context"], r["labels_mapping"], r["label_values"])
    return out


def get_config(task: str, known: dict[str, TaskConfig], override: TaskConfig | None = None) -> TaskConfig:
    if override is not None:
        return override
    if task not in known:
        raise KeyError(f"no configuration for {task}; known tasks: {sorted(known)}")
    return known[task]


def join_configs(df: DataFrame, configs: DataFrame, task: str = "task") -> DataFrame:
    """Rows with their task's configuration; a row whose task has none is an error."""
    c = F.broadcast(configs) if configs.count() <= 10_000 else configs
    out = df.join(c, task, "left")
    return out.withColumn("prefix", F.coalesce("prefix", F.raise_error(F.concat(F.lit("no configuration for "), F.col(task)))))
