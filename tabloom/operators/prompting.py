"""Dataset metadata to prompts, and JSON out of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.profile import summary, value_counts
from tabloom.functions import text

# Layout of the metadata block.
SECTION_SEP = "\n\n##############\n\n"
URL_PATTERN = r'(?U)https?://(?:[-\w.]|%[\da-fA-F]{2})[^\s<>"]*[^\s<>".,;]'

# Default wording; any of these can be replaced by a file of the same name (see load_templates).
TEMPLATES = {
    "task_summary": "{PREFIX}\nSummarize the dataset described below as one JSON object with the keys Source, Collection, "
    "Population, Time range, Features, Prediction target, Class distribution and Predictive Variables.\n\n{METADATA}\n\n{SUFFIX}\n",
    "task_context": "{PREFIX}\nDescribe in one plain paragraph the dataset documented below, as the origin of a single "
    "observation.\n\n{METADATA}\n\n{SUFFIX}\n",
    "context_variants": "{PREFIX}\nWrite eight differently worded descriptions of the dataset below, as a JSON object with the "
    "keys 0 to 7.\n\n{METADATA}\n\nOne of them could read: {EXAMPLE}\n\n{SUFFIX}\n",
    "feature_variants": "{PREFIX}\nGive 32 other names for the feature {FEATURE}, as a JSON object with the keys 0 to 31.\n\n"
    "{METADATA}\n\nThe feature: {SERIALIZED_FEATURE}\n\n{SUFFIX}\n",
    "code_variants": "{PREFIX}\nGive 32 other names for every coded value of the feature {FEATURE}, as a JSON object from code "
    "to list.\n\n{METADATA}\n\nThe feature: {SERIALIZED_FEATURE}\n\n{SUFFIX}\n",
}


def load_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Templates from ``<name>.txt`` files, over the defaults."""
    rows = (
        spark.read.text(path, wholetext=True)
        .select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("name"), "value")
        .where("name != ''")
        .collect()
    )
    return {**TEMPLATES, **{r["name"]: r["value"] for r in rows}}


def table_metadata(df: DataFrame, task: str, target: str, columns: list[str] | None = None) -> DataFrame:
    """Metadata elements made from the data: description of the columns, distribution of the target."""
    line = F.concat_ws(" ", "column", "statistic", "value")
    desc = summary(df, columns).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    dist = value_counts(df, target)
    shown = F.concat_ws(" ", text.py_str(F.col(target), df.schema[target].dataType), F.col("count").cast("string"), text.py_float(F.round("share", 6)))
    top = dist.select((-F.col("count")).alias("c"), shown.alias("t"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("c", "t"))), lambda s: s["t"])
    body = top.agg(F.array_join(lines, "\n").alias("body"))
    return desc.select(
        F.lit(task).alias("task"), F.lit(1).alias("ord"), F.lit("data_description").alias("key"),
        F.lit("Summary statistics of the columns").alias("description"), "body",
    ).unionByName(
        body.select(
            F.lit(task).alias("task"), F.lit(2).alias("ord"), F.lit("target_distribution").alias("key"),
            F.lit("Distribution of the prediction target").alias("description"), "body",
        )
    )


def feature_list_text(features: DataFrame, task: Column, order: str) -> DataFrame:
    """(task, body): one JSON object per feature and line."""
    cols = [c for c in features.columns if c != order]
    js = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    per = features.groupBy(task.alias("task")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), js.alias("j")))).alias("l"))
    return per.select("task", F.array_join("l.j", "\n").alias("body"))


def metadata_text(elements: DataFrame) -> DataFrame:
    """(task, metadata): the elements of a task (a handful) in order, each in its own section."""
    part = F.concat(
        F.lit("<"), F.col("key"), F.lit(">\n"), F.col("description"), F.lit(":\n"), F.col("body"), F.lit("\n</"), F.col("key"), F.lit(">")
    )
    per = elements.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("ord", part.alias("p")))).alias("l"))
    return per.select(
        "task",
        F.concat(
            F.lit("<metadata>" + SECTION_SEP), F.array_join("l.p", SECTION_SEP), F.lit(SECTION_SEP + "</metadata>")
        ).alias("metadata"),
    )


def public_metadata(elements: DataFrame) -> DataFrame:
    """(task, description, body) without the raw data."""
    return elements.where(F.col("key") != "data").select("task", "description", "body")


def fill(template: str | Column, values: dict[str, Column | str]) -> Column:
    """Template with ``{NAME}`` placeholders replaced; metadata goes in last, so that braces in it
    are never taken for placeholders."""
    out = F.lit(template) if isinstance(template, str) else template
    for name in sorted(values, key=lambda n: n == "METADATA"):
        v = values[name]
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(v) if isinstance(v, str) else v)
    return out


def make_prompt(metadata: DataFrame, name: str, templates: dict[str, str] | None = None, prefix: str = "", suffix: str = "", **more) -> DataFrame:
    """(task, prompt) for tasks with metadata text. ``task_context`` needs a task_summary section."""
    body = fill((templates or TEMPLATES)[name], {"PREFIX": prefix, "SUFFIX": suffix, "METADATA": F.col("metadata"), **more})
    if name == "task_context":
        has = F.contains("metadata", F.lit("<task_summary>\n"))
        body = F.when(has, body).otherwise(F.raise_error(F.concat(F.lit("no task summary for "), F.col("task"))))
    return metadata.select("task", body.alias("prompt"))


def make_feature_prompts(metadata: DataFrame, features: DataFrame, name: str, templates: dict[str, str] | None = None,
                         prefix: str = "", suffix: str = "") -> DataFrame:
    """(task, feature, prompt): one prompt per feature of a task (feature_variants, code_variants)."""
    shown = F.col("name")
    if name == "feature_variants":
        shown = F.coalesce(F.when(F.col("name_extended") != "", F.col("name_extended")), F.col("name"))
    js = F.to_json(F.struct(*[c for c in features.columns if c != "task"]), {"ignoreNullFields": "false"})
    both = features.join(metadata, "task")
    body = fill((templates or TEMPLATES)[name], {
        "PREFIX": prefix, "SUFFIX": suffix, "FEATURE": shown, "SERIALIZED_FEATURE": js, "METADATA": F.col("metadata")})
    return both.select("task", F.col("name").alias("feature"), body.alias("prompt"))


def extract_urls(c: Column) -> Column:
    """All URLs, without punctuation at their end."""
    return F.regexp_extract_all(c, F.lit(URL_PATTERN), F.lit(0))


def parse_json_answer(c: Column, pick: str = "last", on_missing: str = "error") -> Column:
    """JSON object in an answer: among the shortest brace pairs that parse, the last (or the longest).

    An answer without braces is an error, or null with ``on_missing="null"``.
    """
    found = F.filter(
        F.regexp_extract_all(c, F.lit(r"(?s)\{.*?\}"), F.lit(0)), lambda x: F.try_parse_json(x).isNotNull()
    )
    if pick == "longest":
        # The first of the longest ones.
        best = F.aggregate(found, F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))
        out = F.when(F.size(found) > 0, best)
    else:
        out = F.try_element_at(found, F.lit(-1))
    has = F.contains(c, F.lit("{")) & F.contains(c, F.lit("}"))
    if on_missing == "null":
        return F.when(has, out)
    return F.when(has, out).otherwise(F.raise_error(F.concat(F.lit("no JSON in answer: "), c)))
