"""Splits, shuffles, shards, tokens, packing, few-shot sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import tokens as K
from tabloom.operators import columns, encoding, packing, sampling, shards, tokenize
from tabloom.operators.ordering import hash_position
from tabloom.registered.common import digest, joined, load, q, uniform
from tabloom.session import scratch_path

QUERIES, SQL = {}, {}


# --- splits and orders -----------------------------------------------------------------------

QUERIES["split_tables"] = lambda spark, folder: sampling.split_tables(
    load(spark, folder, "customer").select(F.col("c_name").alias("table_id")))
SQL["split_tables"] = (
    f"SELECT c_name AS table_id, CASE WHEN row_number() OVER (ORDER BY {digest(42, 'c_name')}, c_name) <= (count(*) OVER () * 25 + 999) // 1000 "
    "THEN 'test' ELSE 'train' END AS split FROM customer"
)


def _split_rows(spark, folder):
    df = load(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return sampling.split_rows(df, "o_orderpriority", ["o_orderkey"], F.col("o_orderstatus"), "0.4", 42)


QUERIES["split_rows"] = _split_rows
SQL["split_rows"] = (
    f"SELECT o_orderkey, o_orderpriority, o_orderstatus, CASE WHEN {uniform(42, q('chunk'), 'o_orderstatus')} < 0.4 AND row_number() OVER "
    f"(PARTITION BY o_orderpriority ORDER BY {digest(42, 'o_orderkey::VARCHAR')}, o_orderkey) <= "
    "(count(*) OVER (PARTITION BY o_orderpriority) * 2 + 4) // 5 THEN 'traineval' ELSE 'train' END AS split FROM orders"
)

_u = uniform(7, q("split"), "l_orderkey::VARCHAR", "l_linenumber::VARCHAR")
QUERIES["split_iid"] = lambda spark, folder: sampling.split_iid(
    load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 7).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))
SQL["split_iid"] = (
    f"SELECT CASE WHEN {_u} < 0.8 THEN 'train' WHEN {_u} < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split, count(*) AS n, "
    "sum(l_orderkey)::BIGINT AS keys FROM lineitem GROUP BY 1"
)

QUERIES["shuffle_positions"] = lambda spark, folder: hash_position(
    load(spark, folder, "events").select("event_id", "event_type"), ["event_type"], 3, ["event_id"], "pos", "total")
SQL["shuffle_positions"] = (
    f"SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {digest(3, 'event_id::VARCHAR')}) - 1 AS pos, "
    "count(*) OVER (PARTITION BY event_type) AS total FROM events"
)

QUERIES["shuffle_rows"] = lambda spark, folder: sampling.shuffle_rows(load(spark, folder, "customer").select("c_custkey", "c_name"), ["c_custkey"], 3)
SQL["shuffle_rows"] = f"SELECT c_custkey, c_name FROM customer ORDER BY {digest(3, 'c_custkey::VARCHAR')}"
QUERIES["shuffle_buffered"] = lambda spark, folder: sampling.shuffle_buffered(load(spark, folder, "documents").select("doc_id", "lang"), ["doc_id"], 3)
SQL["shuffle_buffered"] = "SELECT doc_id, lang FROM documents"

QUERIES["first_rows_per_group"] = lambda spark, folder: sampling.first_rows(
    load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), 2, [F.desc("o_totalprice"), "o_orderkey"], ["o_custkey"])
SQL["first_rows_per_group"] = (
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"
)


def _interleave(spark, folder):
    a = load(spark, folder, "supplier").select(F.col("s_name").alias("name"))
    b = load(spark, folder, "customer").select(F.col("c_name").alias("name"))
    c = load(spark, folder, "part").select(F.concat("p_name", F.lit("#"), "p_partkey").alias("name"))
    return sampling.interleave([a, b, c], [["name"]] * 3).select("turn", "source", "name")


def _source(i, name, table):
    return (
        f"SELECT t AS turn, {i} AS source, name FROM generate_series(0, (SELECT greatest((SELECT count(*) FROM supplier), (SELECT count(*) FROM customer), "
        f"(SELECT count(*) FROM part)) - 1)) AS g(t) JOIN (SELECT {name} AS name, row_number() OVER (ORDER BY {name}) - 1 AS r, count(*) OVER () AS n FROM {table}) s "
        "ON t % n = r"
    )


QUERIES["interleave"] = _interleave
SQL["interleave"] = " UNION ALL ".join(
    _source(i, n, t) for i, (n, t) in enumerate((("s_name", "supplier"), ("c_name", "customer"), ("p_name || '#' || p_partkey", "part"))))


def _concat(spark, folder):
    df = load(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    s = sampling.split_iid(df, ["c_custkey"], 2)
    parts = {n: s.where(F.col("split") == n).drop("split") for n in ("train", "validation", "test")}
    return sampling.concat_splits(parts)


_u2 = uniform(2, q("split"), "c_custkey::VARCHAR")
QUERIES["concat_splits"] = _concat
SQL["concat_splits"] = (
    f"SELECT c_custkey, c_mktsegment, CASE WHEN {_u2} < 0.8 THEN 'train' WHEN {_u2} < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM customer"
)

QUERIES["task_filter"] = lambda spark, folder: sampling.resolve_names(
    load(spark, folder, "customer"), "c_name", ["Customer#*7", "Customer#00000000*", "Customer#000000123"], ["Customer#000000007"])
SQL["task_filter"] = (
    "SELECT DISTINCT c_name FROM customer WHERE (regexp_matches(c_name, '^Customer#.*7') OR regexp_matches(c_name, '^Customer#00000000.*') OR "
    "c_name = 'Customer#000000123') AND c_name <> 'Customer#000000007'"
)


def _task_filter_tables(spark, folder):
    part = load(spark, folder, "part")
    pats = part.select(F.concat(F.col("p_brand"), F.lit("*")).alias("pattern")).distinct()
    cat = part.select(F.concat("p_brand", F.lit("/"), "p_type").alias("task"))
    excl = part.where("p_size = 1").select(F.concat("p_brand", F.lit("/"), "p_type").alias("name"))
    return sampling.resolve_names_by_table(cat, "task", pats, excl)


QUERIES["task_filter_tables"] = _task_filter_tables
SQL["task_filter_tables"] = (
    "SELECT DISTINCT p_brand || '/' || p_type AS task FROM part WHERE p_brand || '/' || p_type NOT IN (SELECT p_brand || '/' || p_type FROM part WHERE p_size = 1)"
)

def _task_filter_list(spark, folder):
    """Thousands of names and patterns from a text file."""
    keys = load(spark, folder, "orders").select("o_custkey").distinct()
    digits = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    lines = F.when(F.pmod("o_custkey", F.lit(3)) == 0, F.concat(F.lit(" Customer#"), digits)).otherwise(
        F.concat(F.lit("Customer#"), F.substring(digits, 1, 8), F.lit("*"), F.pmod("o_custkey", F.lit(7)).cast("string")))
    path = scratch_path(spark, "names") + ".txt"
    keys.select(lines.alias("value")).write.text(path)
    none = spark.createDataFrame([], "name string")
    return sampling.resolve_names_by_table(load(spark, folder, "customer"), "c_name", sampling.read_names(spark, path), none)


QUERIES["task_filter_list"] = _task_filter_list
SQL["task_filter_list"] = (
    "SELECT DISTINCT c_name FROM customer JOIN (SELECT DISTINCT o_custkey % 3 = 0 AS whole, CASE WHEN o_custkey % 3 = 0 THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') "
    "ELSE 'Customer#' || substr(lpad(o_custkey::VARCHAR, 9, '0'), 1, 8) || '%' || (o_custkey % 7) || '%' END AS p FROM orders) ON c_name LIKE p"
)


# --- shards and names ------------------------------------------------------------------------

QUERIES["reshard_bins"] = lambda spark, folder: shards.shard_by_size(
    load(spark, folder, "documents").select("doc_id", "lang", "n_chars"), ["doc_id"], "n_chars", 50_000, ["lang"]).withColumn(
        "file", shards.shard_name(F.col("shard"), "train"))
SQL["reshard_bins"] = (
    "SELECT doc_id, lang, n_chars, s::BIGINT AS shard, 'train-' || lpad(s::VARCHAR, 6, '0') || '.tar' AS file FROM (SELECT *, (greatest(sum(n_chars) OVER "
    "(PARTITION BY lang ORDER BY doc_id), 1) - 1) // 50000 AS s FROM documents)"
)
QUERIES["file_chunks"] = lambda spark, folder: shards.file_chunks(load(spark, folder, "pages").select(F.col("url").alias("path")).distinct(), "path", 64)
SQL["file_chunks"] = "SELECT path, (row_number() OVER (ORDER BY path) - 1) // 64 AS chunk FROM (SELECT DISTINCT url AS path FROM pages)"


def _names(spark, folder):
    df = load(spark, folder, "pages")
    return df.select("page_id", columns.clean_name_column(F.col("url")).alias("clean"), columns.file_safe(F.col("url")).alias("safe"),
                     columns.slug(F.concat(F.lit("a-"), F.col("url"))).alias("slug"))


QUERIES["name_cleaning"] = _names
SQL["name_cleaning"] = (
    "SELECT page_id, replace(replace(url, '.', '_'), '__', '_') AS clean, translate(url, '<>:/\\|?*', '________') AS safe, 'a/' || url AS slug FROM pages"
)

QUERIES["sample_keys"] = lambda spark, folder: load(spark, folder, "conversations").select(
    "conv_id", "turn", shards.sample_key(F.concat(F.lit("t"), F.col("conv_id").cast("string")), F.col("turn")).alias("key")).withColumn(
        "table_id", shards.table_of_key(F.col("key")))
SQL["sample_keys"] = "SELECT conv_id, turn, 't' || conv_id || '__' || turn AS key, 't' || conv_id AS table_id FROM conversations"

# --- text length and markers -----------------------------------------------------------------


def _doc_samples(spark, folder):
    docs, marks = load(spark, folder, "documents"), load(spark, folder, "labels")
    y = F.when(F.col("quality") == 1, "good").otherwise("bad")
    return docs.join(marks, "doc_id").select(
        "doc_id", "lang", shards.sample_key(F.col("lang"), F.col("doc_id")).alias("key"), "text", y.alias("class_label_as_text"))


_DOCS = (
    "SELECT doc_id, lang, lang || '__' || doc_id AS key, text, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS y FROM documents JOIN labels USING (doc_id)"
)


def _drop_long(spark, folder):
    from tabloom.operators.labels import drop_long

    return drop_long(load(spark, folder, "documents")).select("doc_id", F.length("text").alias("chars"))


QUERIES["text_length_filter"] = _drop_long
SQL["text_length_filter"] = "SELECT doc_id, length(text)::INT AS chars FROM documents WHERE length(text) <= 14336"

QUERIES["qa_markers"] = lambda spark, folder: tokenize.with_markers(_doc_samples(spark, folder)).select(
    "doc_id", F.md5(F.col("input_text").cast("binary")).alias("input_md5"), "target_text")
SQL["qa_markers"] = f"SELECT doc_id, md5(text || '<|endinput|>') AS input_md5, y || '<|endcompletion|>' AS target_text FROM ({_DOCS})"


# --- tokens ----------------------------------------------------------------------------------

def _ids_sql(c):
    """Byte ids as a list (texts without markers)."""
    return f"list_transform(regexp_extract_all(hex({c}), '..'), lambda b: ('0x' || b)::INT)"


QUERIES["byte_tokenize"] = lambda spark, folder: load(spark, folder, "documents").select(
    "doc_id", tokenize.token_column(F.col("text")).alias("ids")).select(
        "doc_id", F.size("ids").alias("n"), F.md5(joined(F.col("ids")).cast("binary")).alias("ids_md5"))
SQL["byte_tokenize"] = (
    f"SELECT doc_id, (len(ids) + 1)::INT AS n, md5('256,' || array_to_string(ids, ',')) AS ids_md5 FROM (SELECT doc_id, {_ids_sql('text')} AS ids FROM documents)"
)

_SEP = K.FIRST_SPECIAL_ID + 1  # order of the markers: end of completion, separator, choices
_EOC = K.FIRST_SPECIAL_ID


def _tokens(spark, folder):
    return tokenize.tokenize_samples(tokenize.with_markers(_doc_samples(spark, folder)))


# ids: begin, text, separator, label, end; labels: the same with the part up to the separator masked
_TOK = (
    f"SELECT doc_id, lang, key, list_concat([256], {_ids_sql('text')}, [{_SEP}]) AS src, list_concat({_ids_sql('y')}, [{_EOC}]) AS tgt FROM ({_DOCS})"
)
_IGN = "list_transform(src, lambda x: -100)"
QUERIES["label_mask"] = lambda spark, folder: _tokens(spark, folder).select(
    "doc_id", F.size("input_ids").alias("n"), F.md5(joined(F.col("input_ids")).cast("binary")).alias("ids_md5"),
    F.md5(joined(F.col("labels")).cast("binary")).alias("labels_md5"), joined(tokenize.unmasked(F.col("labels"))).alias("target_ids"),
    F.array_min(tokenize.unmasked_positions(F.col("labels"))).alias("first"))
SQL["label_mask"] = (
    f"SELECT doc_id, (len(src) + len(tgt))::INT AS n, md5(array_to_string(list_concat(src, tgt), ',')) AS ids_md5, "
    f"md5(array_to_string(list_concat({_IGN}, tgt), ',')) AS labels_md5, array_to_string(tgt, ',') AS target_ids, len(src)::INT AS first FROM ({_TOK})"
)

QUERIES["tokenize_truncated"] = lambda spark, folder: tokenize.tokenize_samples(tokenize.with_markers(_doc_samples(spark, folder)), truncate=512).select(
    "doc_id", F.size("input_ids").alias("n"), F.size(tokenize.unmasked(F.col("labels"))).alias("unmasked"))
SQL["tokenize_truncated"] = (
    f"SELECT doc_id, least(len(src) + len(tgt), 512)::INT AS n, (least(len(src) + len(tgt), 512) - least(len(src), 512))::INT AS unmasked FROM ({_TOK})"
)

for _mode, _cond in {
    "at_most": "len(src) + len(tgt) <= 2000",
    "eval": "len(src) + len(tgt) + len(tgt) <= 2000",
}.items():
    QUERIES[f"token_length_{_mode}"] = (lambda m: lambda spark, folder: tokenize.filter_length(_tokens(spark, folder), 2000, m).select(
        "doc_id", F.size("input_ids").alias("n")))(_mode)
    SQL[f"token_length_{_mode}"] = f"SELECT doc_id, (len(src) + len(tgt))::INT AS n FROM ({_TOK}) WHERE {_cond}"

QUERIES["prompt_cut"] = lambda spark, folder: _tokens(spark, folder).select(
    "doc_id", tokenize.prompt_only(F.col("input_ids"), F.col("labels")).alias("p")).select(
        "doc_id", F.size("p").alias("n"), F.element_at("p", -1).alias("last_id"))
SQL["prompt_cut"] = f"SELECT doc_id, len(src)::INT AS n, {_SEP} AS last_id FROM ({_TOK})"

QUERIES["context_budget"] = lambda spark, folder: tokenize.context_budget(
    _tokens(spark, folder).withColumn("p", tokenize.prompt_only(F.col("input_ids"), F.col("labels"))), "p", 2048, 16).select("doc_id", "max_new_tokens")
SQL["context_budget"] = f"SELECT doc_id, least(16, 2048 - len(src))::INT AS max_new_tokens FROM ({_TOK}) WHERE 2048 - len(src) >= 2"


def _pad(spark, folder):
    df = load(spark, folder, "conversations")
    df = df.select("conv_id", "turn", tokenize.token_column(F.col("text")).alias("input_ids"))
    df = tokenize.pad_batches(df.withColumn("labels", F.col("input_ids")), ["conv_id"])
    return df.select("conv_id", "turn", F.md5(joined(F.col("input_ids")).cast("binary")).alias("ids_md5"), F.md5(joined(F.col("labels")).cast("binary")).alias("labels_md5"),
                     F.size(F.filter("pad_mask", lambda x: x)).alias("content"))


def _padded(v):
    return f"md5(array_to_string(list_concat(ids, list_transform(range(0, (m - len(ids))::BIGINT), lambda x: {v})), ','))"


QUERIES["pad_batch"] = _pad
SQL["pad_batch"] = (
    f"SELECT conv_id, turn, {_padded(K.PAD_ID)} AS ids_md5, {_padded(K.IGNORE)} AS labels_md5, len(ids)::INT AS content FROM (SELECT *, max(len(ids)) OVER "
    f"(PARTITION BY conv_id) AS m FROM (SELECT conv_id, turn, list_concat([256], {_ids_sql('text')}) AS ids FROM conversations))"
)

QUERIES["labels_max_len"] = lambda spark, folder: tokenize.labels_max_len(load(spark, folder, "part"), "p_brand", "p_name")
SQL["labels_max_len"] = (
    "SELECT p_brand, max(strlen(p_name) + 3)::INT AS max_len, first(p_name ORDER BY strlen(p_name) DESC, p_name) AS longest FROM part GROUP BY p_brand"
)


# --- packing ---------------------------------------------------------------------------------

def _conv(spark, folder):
    df = load(spark, folder, "conversations")
    key = shards.sample_key(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("turn"))
    return df.select("conv_id", "turn", key.alias("key"), "text", F.col("role").alias("class_label_as_text"))


def _islands(spark, folder):
    df = packing.with_batch(_conv(spark, folder), [], ["conv_id", "turn"], 10)
    return packing.island_ids(df, ["batch"], ["slot"], "key").select("key", "batch", "slot", "example_id")


_BATCHED = (
    "SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // {n} AS batch, ((row_number() OVER (ORDER BY conv_id, turn) - 1) % {n})::INT AS slot FROM "
    "(SELECT conv_id, turn, 'c' || conv_id || '__' || turn AS key, text, role FROM conversations)"
)
_ISLAND = (
    "SELECT *, (sum(CASE WHEN prev <> conv_id THEN 1 ELSE 0 END) OVER (PARTITION BY batch ORDER BY slot))::INT AS ex FROM (SELECT *, lag(conv_id) OVER "
    "(PARTITION BY batch ORDER BY slot) AS prev FROM ({b}))"
)
QUERIES["table_islands"] = _islands
SQL["table_islands"] = f"SELECT key, batch, slot, ex AS example_id FROM ({_ISLAND.format(b=_BATCHED.format(n=10))})"


def _pack(max_len, n, merge=True, trim=False, tail="keep"):
    def run(spark, folder):
        toks = tokenize.tokenize_samples(tokenize.with_markers(_conv(spark, folder)))
        toks = toks.withColumn("shard", F.lit("all"))
        out = packing.pack(toks, ["shard"], ["conv_id", "turn"], "key", max_len, n, merge, trim, tail=tail)
        span = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["example_id"].cast("string"), s["start"].cast("string"), s["len"].cast("string"))), " ")
        lost = ["dropped"] if tail == "drop" else []
        return out.select("batch", "part", *lost, F.size("input_ids").alias("n"), *[F.md5(joined(F.col(c)).cast("binary")).alias(c + "_md5") for c in (
            "input_ids", "labels", "example_ids", "position_ids")], span.alias("spans"))

    return run


def _full_packs(spark, folder):
    toks = tokenize.tokenize_samples(tokenize.with_markers(_conv(spark, folder)))
    out = packing.pack(toks, [], ["conv_id", "turn"], "key", 4096, 20)
    return tokenize.filter_length(out, 4096, "exact").select("batch", "part", F.size("input_ids").alias("n"))


def _pack_sql(max_len, n, merge=True, trim=False, tail="keep"):
    toks = (
        f"SELECT batch, slot, ex, list_concat([256], {_ids_sql('text')}, [{_SEP}]) AS src, list_concat({_ids_sql('role')}, [{_EOC}]) AS tgt FROM "
        f"({_ISLAND.format(b=_BATCHED.format(n=n))})"
    )
    ids, labs = "list_concat(src, tgt)", f"list_concat({_IGN}, tgt)"
    if trim:
        ids, labs = (f"CASE WHEN slot > 0 THEN ({x})[2:] ELSE {x} END" for x in (ids, labs))
    ex = "ex" if merge else "slot"
    rows = f"SELECT batch, slot, {ex} AS ex, {ids} AS ids, {labs} AS labs FROM ({toks})"
    rows = f"SELECT *, coalesce(sum(len(ids)) OVER (PARTITION BY batch, ex ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p0 FROM ({rows})"
    rows = (
        "SELECT batch, flatten(list(ids ORDER BY slot)) AS i, flatten(list(labs ORDER BY slot)) AS l, flatten(list(list_transform(ids, lambda x: ex) ORDER BY slot)) AS e, "
        f"flatten(list(range(p0, p0 + len(ids)) ORDER BY slot)) AS p FROM ({rows}) GROUP BY batch"
    )
    cut = ", ".join(f"{c}[part * {max_len} + 1:(part + 1) * {max_len}] AS {c}" for c in "ilep")
    rows = (
        f"SELECT batch, part, {cut}, greatest(len(i) - {max_len}, 0)::BIGINT AS dropped FROM "
        f"(SELECT *, unnest(range(greatest(1, (len(i) + {max_len - 1}) // {max_len})))::INT AS part FROM ({rows}))"
    )
    lost = ", dropped" if tail == "drop" else ""
    rows += " WHERE part = 0" if tail == "drop" else ""
    spans = (
        "array_to_string(list_transform(list_sort(list_distinct(e)), lambda k: k || ':' || (list_position(e, k) - 1) || ':' || len(list_filter(e, lambda y: y = k))), ' ')"
    )
    return (
        f"SELECT batch, part{lost}, len(i)::INT AS n, md5(array_to_string(i, ',')) AS input_ids_md5, md5(array_to_string(l, ',')) AS labels_md5, "
        f"md5(array_to_string(e, ',')) AS example_ids_md5, md5(array_to_string(p, ',')) AS position_ids_md5, {spans} AS spans FROM ({rows})"
    )


for _n, _a in {"pack": (4096, 20), "pack_unmerged_trimmed": (3000, 15, False, True, "drop")}.items():
    QUERIES[_n], SQL[_n] = _pack(*_a), _pack_sql(*_a)

QUERIES["token_length_exact"] = _full_packs
SQL["token_length_exact"] = f"SELECT batch, part, n FROM ({SQL['pack']}) WHERE n = 4096"


# --- few-shot --------------------------------------------------------------------------------

def _few_shot(spark, folder):
    out = packing.few_shot(_tokens(spark, folder), ["lang"], ["doc_id"], ["key"], 3, 6000, True, 8)
    return out.select("lang", "batch", "slot", "key", "n_cut", F.size("input_ids").alias("n"), F.md5(joined(F.col("input_ids")).cast("binary")).alias("ids_md5"),
                      F.md5(joined(F.col("labels")).cast("binary")).alias("labels_md5"))


_RUNS = (
    f"SELECT *, list_concat(src, tgt) AS ids, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 4 AS batch, "
    f"((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 4)::INT AS slot FROM ({_TOK})"
)
_h = digest(8, q("shot"), "t.key", "s.slot::VARCHAR")
_PAIRS = (
    f"SELECT t.lang, t.batch, t.slot, t.key, s.ids, row_number() OVER (PARTITION BY t.key ORDER BY {_h}) AS o FROM r t JOIN r s ON t.lang = s.lang AND t.batch = s.batch "
    "AND t.slot <> s.slot"
)
QUERIES["few_shot"] = _few_shot
SQL["few_shot"] = (
    f"WITH r AS ({_RUNS}), c AS (SELECT key, flatten(list(CASE WHEN o > 1 THEN ids[2:] ELSE ids END ORDER BY o)) AS ctx FROM ({_PAIRS}) GROUP BY key), "
    "f AS (SELECT r.lang, r.batch, r.slot, r.key, coalesce(ctx, []) AS ctx, CASE WHEN ctx IS NULL THEN r.ids ELSE r.ids[2:] END AS t, "
    "list_concat(list_transform(CASE WHEN ctx IS NULL THEN src ELSE src[2:] END, lambda x: -100), tgt) AS tl FROM r LEFT JOIN c USING (key)), "
    "g AS (SELECT *, ctx[1:greatest(6000 - len(t), 0)] AS c, t[greatest(len(t) - 6000, 0) + 1:] AS tt, tl[greatest(len(t) - 6000, 0) + 1:] AS ttl FROM f) "
    "SELECT lang, batch, slot, key, greatest(len(ctx) + len(t) - 6000, 0)::INT AS n_cut, (len(c) + len(tt))::INT AS n, md5(array_to_string(list_concat(c, tt), ',')) AS ids_md5, "
    "md5(array_to_string(list_concat(list_transform(c, lambda x: -100), ttl), ',')) AS labels_md5 FROM g"
)


# --- numbers ---------------------------------------------------------------------------------

def _periodic(spark, folder):
    enc = encoding.periodic(F.col("p_size"), encoding.coefficients(3, 0.05))
    return load(spark, folder, "part").select("p_partkey", enc.alias("e")).select("p_partkey", *[F.round(F.col("e")[i], 9).alias(f"e{i}") for i in range(6)])


QUERIES["periodic_encode"] = _periodic
SQL["periodic_encode"] = "SELECT p_partkey, " + ", ".join(
    f"round({'cos' if i < 3 else 'sin'}(2 * pi() * pow(0.05::DOUBLE, {i % 3}.0::DOUBLE / 3) * p_size), 9) AS e{i}" for i in range(6)) + " FROM part"
