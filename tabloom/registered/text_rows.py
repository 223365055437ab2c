"""Rows to text and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.config import DataConfig, SerializerConfig
from tabloom.functions import text
from tabloom.operators import columns, labels, metafeatures, serialize, target
from tabloom.plans import prepare
from tabloom.registered.common import TABLE_COLUMNS, digest, iso, load, num, q, raw, sentences, txt, uniform

QUERIES, SQL = {}, {}


def _sample(table, key, tgt, style, position="both"):
    def run(spark, folder):
        df = load(spark, folder, table)
        df = target.with_choices(df, [], tgt, [key]).withColumnRenamed("choices", "__choices")
        cols = [c for c in df.columns if c != "__choices"]
        return labels.to_samples(
            df, tgt, SerializerConfig(style=style, choices_position=position), choices=F.col("__choices"), columns=cols, keep=[key],
        )

    return run


def _choices(table, tgt, style):
    sep = {"basic": " or ", "basic_v2": "||", "structured": "||"}.get(style, " or ")
    c = f"(SELECT string_agg(v, {q(sep)} ORDER BY v) FROM (SELECT DISTINCT {tgt} AS v FROM {table}))"
    return f"'||' || {c} || '||'" if style == "basic_v2" else c


def _sample_sql(table, key, tgt, style, position="both"):
    ch = _choices(table, tgt, style)
    front = f"|| {ch} || ' '" if position in ("front", "both") else ""
    back = f"|| ' ' || {ch}" if position in ("back", "both") else ""
    return (
        f"SELECT {key}, 'Predict the {tgt}: ' {front} || {sentences(table, tgt)} || ' What is the value of {tgt}?' {back} AS text, "
        f"{tgt} AS class_label_as_text FROM {table}"
    )


for _name, _args in {
    "serialize_basic": ("orders", "o_orderkey", "o_orderpriority", "basic"),
    "serialize_basic_v2_both": ("customer", "c_custkey", "c_mktsegment", "basic_v2"),
    "serialize_basic_v2_front": ("part", "p_partkey", "p_type", "basic_v2", "front"),
    "serialize_basic_v2_back": ("events", "event_id", "event_type", "basic_v2", "back"),
}.items():
    QUERIES[_name] = _sample(*_args)
    SQL[_name] = _sample_sql(*_args)


# --- structured ------------------------------------------------------------------------------

QUERIES["serialize_structured"] = _sample("orders", "o_orderkey", "o_orderstatus", "structured")
_st = " || ".join(
    f"'<|KEY|>{c}<|/KEY|><|VALUE|>' || {raw('orders', c)} || '<|/VALUE|>'" for c in TABLE_COLUMNS["orders"] if c != "o_orderstatus"
)
_ch = f"'<|CHOICES|>' || {_choices('orders', 'o_orderstatus', 'structured')} || '<|/CHOICES|>'"
SQL["serialize_structured"] = (
    f"SELECT o_orderkey, '<|PREFIX|>Predict the o_orderstatus:<|/PREFIX|>' || {_ch} || '<|EXAMPLE|>' || {_st} || '<|/EXAMPLE|>' || "
    f"'<|SUFFIX|>What is the value of o_orderstatus?<|/SUFFIX|>' || {_ch} AS text, o_orderstatus AS class_label_as_text FROM orders"
)

# --- mappings: JSON, series, HTML ------------------------------------------------------------


def _mapping_sql(table, tgt, mark):
    parts = []
    for c, f in TABLE_COLUMNS[table].items():
        if c == tgt:
            continue
        head = q(f"{mark}{c}{mark}: {{{mark}value{mark}: ")
        v = f(c) if f is num else f"{q(mark)} || {f(c)} || {q(mark)}"
        parts.append(f"{head} || {v} || '}}'")
    return "'{' || " + " || ', ' || ".join(parts) + " || '}'"


QUERIES["serialize_json"] = _sample("part", "p_partkey", "p_type", "json")
SQL["serialize_json"] = (
    "SELECT p_partkey, '{\"prefix\": \"Predict the p_type:\", \"features\": ' || " + _mapping_sql("part", "p_type", '"')
    + " || ', \"suffix\": \"What is the value of p_type?\", \"choices\": [' || "
    "(SELECT string_agg('\"' || v || '\"', ', ' ORDER BY v) FROM (SELECT DISTINCT p_type AS v FROM part)) || ']}' AS text, "
    "p_type AS class_label_as_text FROM part"
)
QUERIES["serialize_pandas"] = _sample("customer", "c_custkey", "c_mktsegment", "pandas")
SQL["serialize_pandas"] = (
    "SELECT c_custkey, " + q("pd.Series({'prefix': 'Predict the c_mktsegment:', 'features': ") + " || "
    + _mapping_sql("customer", "c_mktsegment", "'") + " || "
    + q(", 'suffix': 'What is the value of c_mktsegment?', 'choices': '") + " || " + _choices("customer", "c_mktsegment", "pandas")
    + " || " + q("'})") + " AS text, c_mktsegment AS class_label_as_text FROM customer"
)


def _html_sql(nl, pad):
    def line(n, s):
        return pad * n + s + nl

    head = (
        line(0, '<table border="1" class="dataframe">') + line(2, "<thead>") + line(4, '<tr style="text-align: right;">')
        + line(6, "<th></th>") + line(6, "<th>0</th>") + line(4, "</tr>") + line(2, "</thead>") + line(2, "<tbody>")
    )

    def row(k, v):
        return f"{q(line(4, '<tr>') + line(6, f'<th>{k}</th>') + pad * 6 + '<td>')} || {v} || {q('</td>' + nl + line(4, '</tr>'))}"

    body = " || ".join([
        row("prefix", "'Predict the c_mktsegment:'"),
        row("features", _mapping_sql("customer", "c_mktsegment", "'")),
        row("suffix", "'What is the value of c_mktsegment?'"),
        row("choices", _choices("customer", "c_mktsegment", "html")),
    ])
    tail = q(line(2, "</tbody>") + "</table>")
    return f"SELECT c_custkey, {q(head)} || {body} || {tail} AS text, c_mktsegment AS class_label_as_text FROM customer"


QUERIES["serialize_html"] = _sample("customer", "c_custkey", "c_mktsegment", "html")
SQL["serialize_html"] = _html_sql("\n", " ")
QUERIES["serialize_html_compact"] = _sample("customer", "c_custkey", "c_mktsegment", "html_compact")
SQL["serialize_html_compact"] = _html_sql("", "")


def _html_wide(spark, folder):
    """Rows of more than a hundred columns: the components of a vector, twice."""
    df = load(spark, folder, "embeddings")
    cols = [F.round(F.get("embedding", F.lit(i % 64)) * 1000).cast("int").alias(f"e{i}") for i in range(128)]
    feats = serialize.features_of(df.select("vec_id", *cols), [f"e{i}" for i in range(128)])
    html = serialize.serialize(feats, SerializerConfig(style="html_compact"))
    return df.select("vec_id", *cols).select("vec_id", html.alias("text"))


QUERIES["serialize_html_wide"] = _html_wide
_cell = " || ', ' || ".join(
    f"{q(f'&#x27;e{i}&#x27;: {{&#x27;value&#x27;: ')} || round(embedding[{i % 64 + 1}]::DOUBLE * 1000)::INT || '}}'" for i in range(128)
).replace("&#x27;", "''")
SQL["serialize_html_wide"] = (
    "SELECT vec_id, '<table border=\"1\" class=\"dataframe\"><thead><tr style=\"text-align: right;\"><th></th><th>0</th></tr></thead><tbody><tr><th>features</th><td>{' || "
    f"{_cell} || '}}</td></tr></tbody></table>' AS text FROM embeddings"
)


# --- arrays, missing values, precision -------------------------------------------------------

def _serialize_arrays(spark, folder):
    df = load(spark, folder, "embeddings")
    feats = serialize.features_of(df, ["embedding", "label"])
    return df.select("vec_id", serialize.serialize(feats, SerializerConfig(style="basic")).alias("text"))


QUERIES["serialize_arrays"] = _serialize_arrays
SQL["serialize_arrays"] = (
    "SELECT vec_id, 'The embedding is [' || array_to_string(list_transform(embedding, "
    "lambda x: '''' || (x::DOUBLE)::VARCHAR || ''''), ', ') || ']. The label is ' || label || '.' AS text FROM embeddings"
)


def _serialize_missing(spark, folder):
    docs, marks = load(spark, folder, "documents"), load(spark, folder, "labels")
    df = docs.select("doc_id", "lang", "source", "n_chars").join(marks, "doc_id", "left")
    feats = serialize.features_of(df, ["lang", "source", "n_chars", "quality", "toxic"])
    return df.select("doc_id", serialize.serialize(feats, SerializerConfig(style="basic")).alias("text"))


QUERIES["serialize_missing"] = _serialize_missing
SQL["serialize_missing"] = (
    f"SELECT d.doc_id, 'The lang is ' || {txt('lang')} || '. The source is ' || {txt('source')} || '. The n_chars is ' || n_chars || "
    f"'. The quality is ' || {num('quality')} || '. The toxic is ' || {num('toxic')} || '.' AS text "
    "FROM documents d LEFT JOIN labels l USING (doc_id)"
)


# --- metafeatures ----------------------------------------------------------------------------

def _serialize_with_meta(spark, folder):
    df = load(spark, folder, "customer")
    cols = ["c_nationkey", "c_acctbal"]
    df = metafeatures.scaled(metafeatures.quantile_by_rank(df, cols), cols)
    feats = serialize.features_of(df, ["c_name", *cols, "c_mktsegment"], meta=True)
    return df.select("c_custkey", serialize.serialize(feats, SerializerConfig(style="basic")).alias("text"))


def _rank_sql(c, table):
    return (
        f"SELECT {c} AS v, sum(k) OVER (ORDER BY {c}) - k AS b, k, sum(k) OVER () AS n FROM "
        f"(SELECT {c}, count(*) AS k FROM {table} GROUP BY {c})"
    )


def _quantile_sql(c):
    return (
        f"round_even(100.0::DOUBLE * (CASE WHEN {c}.b = 0 THEN 0.0::DOUBLE WHEN {c}.b + {c}.k = {c}.n THEN 1.0::DOUBLE "
        f"ELSE (2 * {c}.b + {c}.k - 1)::DOUBLE / (2.0::DOUBLE * ({c}.n - 1)) END), 0) / 100.0::DOUBLE"
    )


def _scale_sql(c, table):
    return (
        f"round_even(100.0::DOUBLE * ({c} - (SELECT avg({c}) FROM {table})) / (SELECT stddev_pop({c}) FROM {table}), 0) / 100.0::DOUBLE"
    )


def _meta_part(c):
    v, s = _quantile_sql(f"r_{c}"), _scale_sql(c, "customer")
    return f"'The {c} is ' || {c} || ' (quantile:' || ({v})::VARCHAR || ', scale:' || ({s})::VARCHAR || ').'"


QUERIES["serialize_with_meta"] = _serialize_with_meta
SQL["serialize_with_meta"] = (
    f"WITH r_c_nationkey AS ({_rank_sql('c_nationkey', 'customer')}), r_c_acctbal AS ({_rank_sql('c_acctbal', 'customer')}) "
    f"SELECT c_custkey, 'The c_name is ' || c_name || '. ' || {_meta_part('c_nationkey')} || ' ' || {_meta_part('c_acctbal')} || "
    "' The c_mktsegment is ' || c_mktsegment || '.' AS text FROM customer "
    "JOIN r_c_nationkey ON c_nationkey = r_c_nationkey.v JOIN r_c_acctbal ON c_acctbal = r_c_acctbal.v"
)


# --- order and dropout -----------------------------------------------------------------------

def _feature_shuffle(spark, folder):
    df = load(spark, folder, "part")
    cfg = SerializerConfig(style="basic", shuffle_features=True)
    return df.select("p_partkey", serialize.serialize(serialize.features_of(df), cfg, row_key=F.col("p_partkey"), seed=5).alias("text"))


_part_rows = ", ".join(
    "{'k': %s, 't': %s}" % (digest(5, "'order'", "p_partkey", q(c)), f"'The {c} is ' || {f(c)} || '.'") for c, f in TABLE_COLUMNS["part"].items()
)
QUERIES["feature_shuffle"] = _feature_shuffle
SQL["feature_shuffle"] = (
    f"SELECT p_partkey, array_to_string(list_transform(list_sort([{_part_rows}]), lambda s: s.t), ' ') AS text FROM part"
)


def _feature_dropout(spark, folder):
    df = load(spark, folder, "part")
    cfg = SerializerConfig(style="basic", feature_dropout=0.4)
    return df.select("p_partkey", serialize.serialize(serialize.features_of(df), cfg, row_key=F.col("p_partkey"), seed=5).alias("text"))


_kept = ", ".join(
    f"CASE WHEN {uniform(5, chr(39) + 'drop' + chr(39), 'p_partkey', q(c))} > 0.4 THEN 'The {c} is ' || {f(c)} || '.' END"
    for c, f in TABLE_COLUMNS["part"].items()
)
QUERIES["feature_dropout"] = _feature_dropout
SQL["feature_dropout"] = f"SELECT p_partkey, concat_ws(' ', {_kept}) AS text FROM part"


def _column_shuffle(spark, folder):
    df = load(spark, folder, "supplier")
    names = serialize.shuffled_columns(df.columns, "supplier", 3)
    feats = serialize.features_of(df, names)
    return df.select("s_suppkey", serialize.serialize(feats, SerializerConfig(style="basic")).alias("text"))


_sup = ", ".join(
    "{'k': %s, 't': %s}" % (f"md5({q('3:supplier:' + c)})", f"'The {c} is ' || {f(c)} || '.'") for c, f in TABLE_COLUMNS["supplier"].items()
)
QUERIES["column_shuffle"] = _column_shuffle
SQL["column_shuffle"] = (
    f"SELECT s_suppkey, array_to_string(list_transform(list_sort([{_sup}]), lambda s: s.t), ' ') AS text FROM supplier"
)


# --- back to values --------------------------------------------------------------------------

def _back(style):
    def run(spark, folder):
        df = load(spark, folder, "customer")
        t = serialize.serialize(serialize.features_of(df), SerializerConfig(style=style))
        df = df.select("c_custkey", t.alias("t"))
        m = serialize.deserialize_structured(F.col("t")) if style == "structured" else serialize.deserialize_basic(
            F.col("t"), ["c_mktsegment", "c_custkey", "c_name", "c_nationkey", "c_acctbal"])
        df = df.select("c_custkey", m.alias("m"))
        return df.select("c_custkey", *[F.col("m")[c].alias(c[2:]) for c in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")])

    return run


_back_sql = (
    "SELECT c_custkey, c_name AS name, c_nationkey::VARCHAR AS nationkey, c_acctbal::VARCHAR AS acctbal, "
    "c_mktsegment AS mktsegment FROM customer"
)
QUERIES["deserialize_basic"] = _back("basic")
SQL["deserialize_basic"] = _back_sql
QUERIES["deserialize_structured"] = _back("structured")
SQL["deserialize_structured"] = _back_sql


# --- coercion and records --------------------------------------------------------------------

def _coerce(spark, folder):
    df = load(spark, folder, "events")
    return columns.coerce_columns(df)


QUERIES["coerce_columns"] = _coerce
SQL["coerce_columns"] = (
    f"SELECT event_id::VARCHAR AS event_id, {iso('ts')} AS ts, user_id::VARCHAR AS user_id, event_type, value::VARCHAR AS value, props FROM events"
)


def _records(spark, folder):
    df = load(spark, folder, "orders")
    return columns.to_records(df, keep=["o_orderkey"])


QUERIES["row_records"] = _records
SQL["row_records"] = (
    "SELECT o_orderkey, '{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || "
    "'\",\"o_totalprice\":' || o_totalprice || ',\"o_orderdate\":\"' || " + iso("o_orderdate") + " || '\",\"o_orderpriority\":\"' || "
    "o_orderpriority || '\"}' AS data FROM orders"
)


def _bytes(spark, folder):
    df = load(spark, folder, "documents")
    # The same text as UTF-8 and as Latin-1 bytes: the second is rarely valid UTF-8.
    utf8 = text.decode_bytes(F.encode("text", "UTF-8"))
    return df.select("doc_id", F.md5(utf8.cast("binary")).alias("utf8_md5"), F.length(utf8).alias("chars"))


QUERIES["decode_bytes"] = _bytes
SQL["decode_bytes"] = "SELECT doc_id, md5(text) AS utf8_md5, length(text)::INT AS chars FROM documents"


def _map_features(spark, folder):
    df = load(spark, folder, "customer")
    feature_list = [
        {"name": "c_custkey"}, {"name": "c_nationkey", "value_mapping": {"0": "zero", "1": "one", "2": "two"}, "name_extended": "nation"},
        {"name": "c_mktsegment"}, {"name": "c_acctbal", "name_extended": "account balance"},
    ]
    feature_list = columns.drop_features(feature_list, ["c_mktsegment"])
    return columns.apply_feature_list(df, feature_list, values="map", names="map")


QUERIES["feature_list_map"] = _map_features
SQL["feature_list_map"] = (
    "SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE c_nationkey::VARCHAR END AS nation, "
    "c_acctbal AS \"account balance\" FROM customer"
)


def _decode(spark, folder):
    codes = load(spark, folder, "nation")
    df = load(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return columns.decode_by_table(df, "c_nationkey", codes.select(F.col("n_nationkey").cast("string").alias("k"), "n_name"), "k", "n_name")


QUERIES["decode_by_table"] = _decode
SQL["decode_by_table"] = (
    "SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS c_nationkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"
)


def _drop_missing(spark, folder):
    docs, marks = load(spark, folder, "documents"), load(spark, folder, "labels")
    df = docs.select("doc_id", "lang", "n_chars").join(marks, "doc_id", "left")
    return columns.drop_missing(df, "rows")


QUERIES["drop_missing"] = _drop_missing
SQL["drop_missing"] = "SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL"


def _normalize(spark, folder):
    df = load(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return columns.normalize(df, ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice", 6).alias("z"))


QUERIES["normalize"] = _normalize
SQL["normalize"] = (
    "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS z FROM orders"
)


# --- a whole table under its settings --------------------------------------------------------

_NATIONS = {str(i): f"nation no. {i}" for i in range(0, 25, 2)}


def _prepared(spark, folder):
    """Feature list with dictionaries and long names, missing rows out, metafeatures of one digit, hashed columns."""
    df = load(spark, folder, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal")))
    entry = lambda name, long=None, codes=None: {"name": name, "name_extended": long, "value_mapping": codes}
    features = [entry("c_custkey"), entry("c_acctbal", "balance"), entry("c_nationkey", "home", _NATIONS), entry("c_mktsegment")]
    config = DataConfig(feature_values="map", feature_names="map", dropna="rows", use_metafeatures=True, metafeatures_precision=1, shuffle_table_features=True)
    out = prepare.prepare(df, "c_mktsegment", config, features, "customer", 1)
    order = F.lit(",".join(c for c in out.columns if "__" not in c))
    return out.select("c_custkey", "home", "balance__scale", "balance__quantile", order.alias("columns"))


QUERIES["prepared_table"] = _prepared
_ordered = ",".join([*serialize.shuffled_columns(["c_custkey", "balance", "home"], "customer", 1), "c_mktsegment"])
SQL["prepared_table"] = (
    "WITH c AS (SELECT * FROM customer WHERE c_custkey % 7 > 0 AND c_acctbal IS NOT NULL), r AS (SELECT *, rank() OVER (ORDER BY c_acctbal) - 1 AS b, "
    "count(*) OVER (PARTITION BY c_acctbal) AS k, count(*) OVER () AS n, avg(c_acctbal) OVER () AS m, stddev_pop(c_acctbal) OVER () AS d FROM c) "
    f"SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'nation no. ' || c_nationkey ELSE c_nationkey::VARCHAR END AS home, round_even(10.0::DOUBLE * ((c_acctbal - m) / d), 0) / 10.0::DOUBLE AS balance__scale, "
    "round_even(10.0::DOUBLE * (CASE WHEN b = 0 THEN 0.0::DOUBLE WHEN b + k = n THEN 1.0::DOUBLE ELSE (2 * b + k - 1)::DOUBLE / (2.0::DOUBLE * (n - 1)) END), 0) / 10.0::DOUBLE AS balance__quantile, "
    f"{q(_ordered)} AS columns FROM r"
)
