"""Profiles, targets, bins, choices, label mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.config import TargetConfig
from tabloom.functions import text
from tabloom.operators import baselines, labels, metafeatures, profile, sampling, target
from tabloom.registered.common import draws, iso, load, q, uniform

QUERIES, SQL = {}, {}

PROFILED = ("customer", "orders", "part", "supplier")
_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
}
_DATES = ("o_orderdate",)


def _profiles(spark, folder):
    out = None
    for t in PROFILED:
        p = profile.column_profile(load(spark, folder, t), F.lit(t))
        out = p if out is None else out.unionByName(p)
    return out


def _shown(c):
    return iso(c) if c in _DATES else f"coalesce({c}::VARCHAR, 'nan')"


def _profile_one(t, i, c):
    return (
        f"SELECT {q(t)} AS table_id, {q(c)} AS \"column\", {i} AS ordinal, count(*) AS n, count(DISTINCT {c}) AS n_unique, "
        f"count(DISTINCT {_shown(c)}) AS n_unique_with_null, "
        f"bool_and(regexp_matches({_shown(c)}, '^-?\\d+(\\.+\\d+)?$')) AS all_numeric, "
        f"(bool_and({_shown(c)} IN ('0', '1')) AND count(DISTINCT {_shown(c)}) = 2) AS is_binary01, "
        f"max(length({_shown(c)}))::INT AS max_len, {str(c in _DATES).lower()} AS is_date, false AS is_nested FROM {t}"
    )


_PROFILE_SQL = " UNION ALL ".join(_profile_one(t, i, c) for t in PROFILED for i, c in enumerate(_COLUMNS[t]))
_CAND_SQL = (
    "SELECT *, CASE WHEN contains(\"column\", 'Unnamed:') THEN 'unnamed' WHEN is_date THEN 'date' WHEN n_unique < 2 THEN 'too few values' "
    "WHEN n_unique = n AND all_numeric THEN 'unique numbers' WHEN max_len > 256 THEN 'too long' END AS reason FROM (" + _PROFILE_SQL + ")"
)

QUERIES["column_profile"] = _profiles
SQL["column_profile"] = _PROFILE_SQL

QUERIES["column_profile_lineitem"] = lambda spark, folder: profile.column_profile(load(spark, folder, "lineitem"), F.col("l_linestatus")).select(
    "table_id", "column", "n", "n_unique", "all_numeric", "max_len")
SQL["column_profile_lineitem"] = " UNION ALL ".join(
    f"SELECT l_linestatus AS table_id, {q(c)} AS \"column\", count(*) AS n, count(DISTINCT {c}) AS n_unique, "
    f"bool_and(regexp_matches({e}, '^-?\\d+(\\.+\\d+)?$')) AS all_numeric, max(length({e}))::INT AS max_len FROM lineitem GROUP BY l_linestatus"
    for c, e in [(c, iso(c) if c == "l_shipdate" else f"{c}::VARCHAR") for c in (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus", "l_shipdate")]
)

QUERIES["target_candidates"] = lambda spark, folder: profile.target_candidates(_profiles(spark, folder)).select(
    "table_id", "column", "reason", "is_candidate")
SQL["target_candidates"] = f"SELECT table_id, \"column\", reason, reason IS NULL AS is_candidate FROM ({_CAND_SQL})"

QUERIES["target_candidates_strict"] = lambda spark, folder: profile.target_candidates(
    _profiles(spark, folder), TargetConfig(drop_numeric=True, drop_dates=False, max_label_chars=16)).select("table_id", "column", "reason")
SQL["target_candidates_strict"] = (
    "SELECT table_id, \"column\", CASE WHEN n_unique < 2 THEN 'too few values' WHEN all_numeric AND NOT is_binary01 THEN 'numeric' "
    f"WHEN max_len > 16 THEN 'too long' END AS reason FROM ({_PROFILE_SQL})"
)


def _draw(spark, folder):
    cand = profile.target_candidates(_profiles(spark, folder))
    return target.draw_target(cand, seed=11).select("table_id", "target", F.round("p", 9).alias("p"))


def _pick_sql(pool, weight, order, seed, name):
    return (
        f"SELECT table_id, first(\"column\" ORDER BY rn) FILTER (cum > u OR rn = last) AS {name}, first(w ORDER BY rn) FILTER (cum > u OR rn = last) AS w "
        f"FROM (SELECT *, sum(w) OVER (PARTITION BY table_id ORDER BY {order}) AS cum, row_number() OVER (PARTITION BY table_id ORDER BY {order}) AS rn, "
        f"count(*) OVER (PARTITION BY table_id) AS last, {uniform(seed, q('target'), 'table_id')} * sum(w) OVER (PARTITION BY table_id) AS u "
        f"FROM (SELECT *, {weight} AS w FROM ({pool}))) GROUP BY table_id"
    )


_weights = (
    "CASE WHEN n_num = 0 OR n_num = n_all THEN 1.0::DOUBLE / n_all WHEN all_numeric THEN 0.1::DOUBLE / n_num "
    "ELSE (1.0::DOUBLE - 0.1::DOUBLE) / (n_all - n_num) END"
)
_pool = (
    "SELECT *, sum(all_numeric::INT) OVER (PARTITION BY table_id) AS n_num, count(*) OVER (PARTITION BY table_id) AS n_all FROM "
    f"({_CAND_SQL}) WHERE reason IS NULL"
)
QUERIES["target_draw"] = _draw
SQL["target_draw"] = f"SELECT table_id, target, round(w, 9) AS p FROM ({_pick_sql(_pool, _weights, 'ordinal', 11, 'target')})"


def _scores(spark, folder):
    # A stand-in for a learned score: prefers columns with few values.
    return _profiles(spark, folder).select("table_id", "column", (F.lit(1.0) / (F.lit(1.0) + F.col("n_unique"))).alias("score"))


_score_sql = f"SELECT table_id, \"column\", 1.0::DOUBLE / (1.0::DOUBLE + n_unique) AS score FROM ({_PROFILE_SQL})"
QUERIES["target_best"] = lambda spark, folder: target.select_by_score(_scores(spark, folder), TargetConfig(selection="max"))
SQL["target_best"] = f"SELECT table_id, first(\"column\" ORDER BY score DESC, \"column\") AS target FROM ({_score_sql}) GROUP BY table_id"
QUERIES["target_topk"] = lambda spark, folder: target.select_by_score(_scores(spark, folder), TargetConfig(selection="topk", k=3), 4)
SQL["target_topk"] = "SELECT table_id, target FROM (" + _pick_sql(
    f"SELECT * FROM ({_score_sql}) QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY score DESC, \"column\") <= 3",
    "score", '"column"', 4, "target") + ")"
QUERIES["target_temperature"] = lambda spark, folder: target.select_by_score(
    _scores(spark, folder), TargetConfig(selection="temperature", temperature=2.0), 4)
SQL["target_temperature"] = "SELECT table_id, target FROM (" + _pick_sql(_score_sql, "pow(score, 0.5::DOUBLE)", '"column"', 4, "target") + ")"


# --- bins ------------------------------------------------------------------------------------

def _thresholds_sql(table, v, group, parts):
    """(group, i, t): inner quantiles i/parts by explicit ranks."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    ranked = f"SELECT {g}{v} AS v, row_number() OVER ({part} ORDER BY {v}) - 1 AS r, count(*) OVER ({part}) AS n FROM {table} WHERE {v} IS NOT NULL"
    groups = f"SELECT {g}count({v}) AS n, {parts} AS p FROM {table}" + (f" GROUP BY {group}" if group else "")
    wanted = (
        f"SELECT {g}i, (i::DOUBLE / p::DOUBLE * 100.0::DOUBLE / 100.0::DOUBLE) * (n - 1)::DOUBLE AS h, n FROM ({groups}), generate_series(1, 8) AS s(i) WHERE i < p"
    )
    on = f"w.{group} = a.{group} AND " if group else ""
    on_b = f"w.{group} = b.{group} AND " if group else ""
    gs = f"w.{group}, " if group else ""
    t = "(h - floor(h))"
    return (
        f"SELECT {gs}w.i, CASE WHEN {t} >= 0.5 THEN b.v - (b.v - a.v) * (1 - {t}) ELSE a.v + (b.v - a.v) * {t} END AS t FROM ({wanted}) w "
        f"JOIN ({ranked}) a ON {on}a.r = floor(h)::BIGINT JOIN ({ranked}) b ON {on_b}b.r = least(floor(h)::BIGINT + 1, w.n - 1)"
    )


def _bucket_sql(v, ts):
    """Bucket text from an ordered list of thresholds."""
    above = f"len(list_filter({ts}, lambda t: NOT coalesce({v} < t, false)))"
    return (
        f"CASE WHEN {above} >= len({ts}) THEN 'greater than ' || {ts}[len({ts})]::VARCHAR WHEN {above} = 0 THEN 'less than ' || {ts}[1]::VARCHAR "
        f"ELSE 'between ' || {ts}[{above}]::VARCHAR || ' and ' || {ts}[{above} + 1]::VARCHAR END"
    )


QUERIES["discretize_4"] = lambda spark, folder: target.discretize(
    load(spark, folder, "orders"), "o_totalprice", 4, "bucket").select("o_orderkey", "bucket")
SQL["discretize_4"] = (
    f"WITH th AS (SELECT list(t ORDER BY i) AS ts FROM ({_thresholds_sql('orders', 'o_totalprice', '', '4')})) "
    f"SELECT o_orderkey, {_bucket_sql('o_totalprice', 'ts')} AS bucket FROM orders, th"
)


def _by_table(spark, folder):
    df = load(spark, folder, "part").select("p_partkey", "p_brand", "p_retailprice")
    df = df.withColumn("k", target.num_buckets(F.col("p_brand"), TargetConfig(), 9))
    th = target.fit_thresholds(df, ["p_brand"], "p_retailprice", "k")
    return df.join(th, "p_brand").select("p_partkey", "k", target.bucket_label(F.col("p_retailprice"), F.col("thresholds")).alias("bucket"))


_k = f"(2 + floor({uniform(9, q('buckets'), 'p_brand')} * 7))::INT"
QUERIES["discretize_by_table"] = _by_table
SQL["discretize_by_table"] = (
    f"WITH th AS (SELECT p_brand, list(t ORDER BY i) AS ts FROM ({_thresholds_sql('part', 'p_retailprice', 'p_brand', _k)}) GROUP BY p_brand) "
    f"SELECT p_partkey, {_k} AS k, {_bucket_sql('p_retailprice', 'ts')} AS bucket FROM part JOIN th USING (p_brand)"
)


# --- metafeatures ----------------------------------------------------------------------------

def _meta_rank(spark, folder):
    df = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return metafeatures.quantile_by_rank(df, ["l_quantity"], 2, ["l_returnflag"]).groupBy("l_returnflag", "l_quantity", "l_quantity__quantile").agg(
        F.count(F.lit(1)).alias("n")).withColumnRenamed("l_quantity__quantile", "quantile")


QUERIES["metafeatures_rank"] = _meta_rank
SQL["metafeatures_rank"] = (
    "WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS k FROM lineitem GROUP BY ALL), r AS (SELECT *, "
    "sum(k) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - k AS b, sum(k) OVER (PARTITION BY l_returnflag) AS n FROM c) "
    "SELECT l_returnflag, l_quantity, round_even(100.0::DOUBLE * (CASE WHEN b = 0 THEN 0.0::DOUBLE WHEN b + k = n THEN 1.0::DOUBLE ELSE "
    "(2 * b + k - 1)::DOUBLE / (2.0::DOUBLE * (n - 1)) END), 0) / 100.0::DOUBLE AS quantile, k AS n FROM r"
)


def _meta_rank_columns(spark, folder):
    """Several columns at once, one with missing values, in groups of which one has none of it."""
    price = F.when((F.col("l_linenumber") > 1) & (F.col("l_returnflag") != "A"), F.col("l_extendedprice"))
    df = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", price.alias("price"), "l_discount", "l_suppkey")
    return metafeatures.quantile_by_rank(df, ["price", "l_discount", "l_suppkey"], 3, ["l_returnflag"]).drop("l_returnflag", "price", "l_discount", "l_suppkey")


def _cdf_sql(c):
    ranks = f"rank() OVER o - 1 AS b, count(*) OVER (PARTITION BY l_returnflag, {c}) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n"
    return (
        f"SELECT rid, round_even(1000.0::DOUBLE * (CASE WHEN b = 0 THEN 0.0::DOUBLE WHEN b + k = n THEN 1.0::DOUBLE ELSE (2 * b + k - 1)::DOUBLE / (2.0::DOUBLE * (n - 1)) END), 0) / 1000.0::DOUBLE AS q "
        f"FROM (SELECT rid, {ranks} FROM l WHERE {c} IS NOT NULL WINDOW o AS (PARTITION BY l_returnflag ORDER BY {c}))"
    )


QUERIES["metafeatures_rank_columns"] = _meta_rank_columns
SQL["metafeatures_rank_columns"] = (
    "WITH l AS (SELECT row_number() OVER () AS rid, *, CASE WHEN l_linenumber > 1 AND l_returnflag <> 'A' THEN l_extendedprice END AS price FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, a.q AS price__quantile, b.q AS l_discount__quantile, c.q AS l_suppkey__quantile FROM l "
    f"LEFT JOIN ({_cdf_sql('price')}) a USING (rid) LEFT JOIN ({_cdf_sql('l_discount')}) b USING (rid) LEFT JOIN ({_cdf_sql('l_suppkey')}) c USING (rid)"
)


def _meta_grid(spark, folder):
    df = load(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    df = metafeatures.quantile_by_grid(df, ["o_totalprice", "o_custkey"], 9)
    return df.select("o_orderkey", F.col("o_totalprice__quantile").alias("price_q"), F.col("o_custkey__quantile").alias("cust_q"))


def _grid_sql(v):
    return (
        f"SELECT i, (i * (n - 1))::DOUBLE / p::DOUBLE AS h, n, p FROM "
        f"(SELECT count({v}) AS n, least(count({v}), 1000) - 1 AS p FROM orders), generate_series(0, 999) AS s(i) WHERE i <= p"
    )


def _grid_values(v):
    ranked = f"SELECT {v}::DOUBLE AS v, row_number() OVER (ORDER BY {v}) - 1 AS r FROM orders"
    t = "(h - floor(h))"
    return (
        f"SELECT i, p, CASE WHEN {t} >= 0.5 THEN b.v - (b.v - a.v) * (1 - {t}) ELSE a.v + (b.v - a.v) * {t} END AS g FROM ({_grid_sql(v)}) w "
        f"JOIN ({ranked}) a ON a.r = floor(h)::BIGINT JOIN ({ranked}) b ON b.r = least(floor(h)::BIGINT + 1, w.n - 1)"
    )


def _interp(v, name):
    """Mean of the interpolation from below and from above; ends are pinned."""
    return f"""
      SELECT o_orderkey, CASE WHEN x = lo THEN 0.0::DOUBLE WHEN x = hi THEN 1.0::DOUBLE ELSE 0.5::DOUBLE * (
          (CASE WHEN dn.g = x OR up.g = dn.g THEN dn.last_i ELSE dn.last_i + (x - dn.g) / (up.g - dn.g) END)
        + (CASE WHEN up.g = x OR up.g = dn.g THEN up.first_i ELSE up.first_i - (up.g - x) / (up.g - dn.g) END)) / up.p END AS {name}
      FROM (SELECT o_orderkey, {v}::DOUBLE AS x, min({v}) OVER () AS lo, max({v}) OVER () AS hi FROM orders) o
      ASOF JOIN (SELECT g, max(i)::DOUBLE AS last_i FROM ({_grid_values(v)}) GROUP BY g) dn ON o.x >= dn.g
      ASOF JOIN (SELECT g, min(i)::DOUBLE AS first_i, max(p) AS p FROM ({_grid_values(v)}) GROUP BY g) up ON o.x <= up.g
    """


QUERIES["metafeatures_grid"] = _meta_grid
SQL["metafeatures_grid"] = (
    f"SELECT o_orderkey, round_even(price_q, 9) AS price_q, round_even(cust_q, 9) AS cust_q FROM ({_interp('o_totalprice', 'price_q')}) "
    f"JOIN ({_interp('o_custkey', 'cust_q')}) USING (o_orderkey)"
)


def _meta_scale(spark, folder):
    df = load(spark, folder, "part").select("p_partkey", "p_brand", "p_retailprice")
    return metafeatures.scaled(df, ["p_retailprice"], 2, ["p_brand"]).select("p_partkey", F.col("p_retailprice__scale").alias("scale"))


QUERIES["metafeatures_scale"] = _meta_scale
SQL["metafeatures_scale"] = (
    "SELECT p_partkey, round_even(100.0::DOUBLE * (p_retailprice - avg(p_retailprice) OVER w) / (CASE WHEN stddev_pop(p_retailprice) OVER w = 0 THEN 1.0::DOUBLE ELSE "
    "stddev_pop(p_retailprice) OVER w END), 0) / 100.0::DOUBLE AS scale FROM part WINDOW w AS (PARTITION BY p_brand)"
)


# --- choices ---------------------------------------------------------------------------------

def _choices(table, group, label, key, **kw):
    def run(spark, folder):
        df = load(spark, folder, table)
        return target.with_choices(df, group, label, [key], seed=2, **kw).select(key, F.array_join("choices", "|").alias("choices"))

    return run


def _choices_sql(table, group, label, key):
    """Few labels: all. Many: the true one, then the drawn others."""
    g = ", ".join(group)
    by = f"GROUP BY {g}" if group else ""
    dom = f"SELECT {g + ', ' if g else ''}list(DISTINCT {label} ORDER BY {label}) AS vs FROM {table} {by}"
    join = f"JOIN dom USING ({g})" if group else ", dom"
    picked = draws("m", 8, 2, "'choices'", f"{key}::VARCHAR")
    return (
        f"WITH dom AS ({dom}), r AS (SELECT {key}, {label} AS label, vs, len(vs) AS m FROM {table} {join}), "
        f"p AS (SELECT *, {picked} AS d FROM r) "
        f"SELECT {key}, CASE WHEN m <= 8 THEN array_to_string(vs, '|') ELSE array_to_string(list_concat([label], "
        f"list_filter(list_transform(d, lambda i: vs[i + 1]), lambda x: x <> label)[1:7]), '|') END AS choices FROM p"
    )


QUERIES["choices_small"] = _choices("orders", ["o_orderstatus"], "o_orderpriority", "o_orderkey")
SQL["choices_small"] = _choices_sql("orders", ["o_orderstatus"], "o_orderpriority", "o_orderkey")
QUERIES["choices_sampled"] = _choices("part", ["p_type"], "p_brand", "p_partkey")
SQL["choices_sampled"] = _choices_sql("part", ["p_type"], "p_brand", "p_partkey")


def _choices_null_group(spark, folder):
    """Orders whose status is unknown are a group of their own."""
    status = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status")
    df = load(spark, folder, "orders").select("o_orderkey", status, "o_orderpriority")
    return target.with_choices(df, ["status"], "o_orderpriority", ["o_orderkey"], seed=2).select("o_orderkey", F.array_join("choices", "|").alias("choices"))


QUERIES["choices_null_group"] = _choices_null_group
SQL["choices_null_group"] = (
    "WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, o_orderpriority AS p FROM orders), "
    "d AS (SELECT status, string_agg(DISTINCT p, '|' ORDER BY p) AS choices FROM o GROUP BY status) "
    "SELECT o_orderkey, choices FROM o JOIN d ON o.status IS NOT DISTINCT FROM d.status"
)
# Every customer name is different, so this takes the lookup by position.
QUERIES["choices_large"] = _choices("customer", [], "c_name", "c_custkey", inline=100)
SQL["choices_large"] = _choices_sql("customer", [], "c_name", "c_custkey")


# --- labels ----------------------------------------------------------------------------------

def _label_map(spark, folder):
    df = load(spark, folder, "labels")
    y = labels.map_label(F.col("quality").cast("string"), labels.BINARY_LABELS)
    return df.select("doc_id", y.alias("label"), labels.reverse_label(y, labels.BINARY_LABELS).alias("back"))


QUERIES["label_map"] = _label_map
SQL["label_map"] = "SELECT doc_id, CASE quality WHEN 1 THEN 'Yes' ELSE 'No' END AS label, quality::VARCHAR AS back FROM labels"


def _sentences(spark, folder):
    df = load(spark, folder, "events")
    name = F.col("event_type")
    odd = F.concat(F.lit(" Is it "), name, F.lit("? "))
    return df.select(
        "event_id", labels.prefix_text(labels.default_prefix(name)).alias("prefix"),
        labels.prefix_text(F.concat(name, F.lit(": "))).alias("prefix_colon"),
        labels.suffix_text(labels.default_suffix(name)).alias("suffix"), labels.suffix_text(odd).alias("suffix_blank"),
    )


QUERIES["task_sentences"] = _sentences
SQL["task_sentences"] = (
    "SELECT event_id, 'Predict the ' || event_type || ':' AS prefix, event_type || ':' AS prefix_colon, "
    "'What is the value of ' || event_type || '?' AS suffix, 'Is it ' || event_type || '??' AS suffix_blank FROM events"
)

QUERIES["value_counts"] = lambda spark, folder: profile.value_counts(
    load(spark, folder, "lineitem"), "l_linestatus", ["l_returnflag"]).select("l_returnflag", "l_linestatus", "count", F.round("share", 9).alias("share"))
SQL["value_counts"] = (
    "SELECT l_returnflag, l_linestatus, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag)::DOUBLE, 9) AS share "
    "FROM lineitem GROUP BY l_returnflag, l_linestatus"
)


def _describe(spark, folder):
    s = profile.summary(load(spark, folder, "orders"))
    v = F.when(F.col("statistic").isin("mean", "std"), text.py_float(F.round(F.col("value").try_cast("double"), 6))).otherwise(F.col("value"))
    return s.select("column", "statistic", v.alias("value"))


def _describe_sql():
    parts = []
    for c in ("o_orderkey", "o_custkey", "o_totalprice"):
        stats = {"count": f"count({c})::DOUBLE", "mean": f"round(avg({c}), 6)", "std": f"round(stddev_samp({c}), 6)",
                 "min": f"min({c})::DOUBLE", "max": f"max({c})::DOUBLE"}
        for k, e in stats.items():
            parts.append(f"SELECT {q(c)} AS \"column\", {q(k)} AS statistic, ({e})::VARCHAR AS value FROM orders")
        parts.append(
            f"SELECT {q(c)}, (i * 25) || '%', t::VARCHAR FROM ({_thresholds_sql('orders', c + '::DOUBLE', '', '4')})"
        )
    for c, e in (("o_orderstatus", "o_orderstatus"), ("o_orderpriority", "o_orderpriority"), ("o_orderdate", iso("o_orderdate"))):
        parts.append(f"SELECT {q(c)}, 'count', count({c})::DOUBLE::VARCHAR FROM orders")
        parts.append(f"SELECT {q(c)}, 'unique', count(DISTINCT {c})::VARCHAR FROM orders")
        freq = f"(SELECT {e} AS v, count(*) AS k FROM orders GROUP BY 1 ORDER BY k DESC, v LIMIT 1)"
        parts.append(f"SELECT {q(c)}, 'top', v FROM {freq}")
        parts.append(f"SELECT {q(c)}, 'freq', k::VARCHAR FROM {freq}")
    return " UNION ALL ".join(parts)


QUERIES["describe"] = _describe
SQL["describe"] = _describe_sql()


def _label_encode(spark, folder):
    df = sampling.split_iid(load(spark, folder, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"], 1)
    train, test = df.where("split = 'train'"), df.where("split <> 'train'")
    a, b = baselines.label_encode(train, test, ["c_mktsegment"])
    return a.unionByName(b)


def _split_sql(seed, key):
    u = uniform(seed, "'split'", f"{key}::VARCHAR")
    return f"CASE WHEN {u} < 0.8 THEN 'train' WHEN {u} < (0.8::DOUBLE + 0.1::DOUBLE) THEN 'validation' ELSE 'test' END"


QUERIES["label_encode"] = _label_encode
SQL["label_encode"] = (
    f"SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment, {_split_sql(1, 'c_custkey')} AS split FROM customer"
)


def _recode(spark, folder):
    test = load(spark, folder, "customer").select(F.col("c_nationkey").alias("y"))
    sample = load(spark, folder, "supplier").select(F.col("s_nationkey").alias("y"))
    return baselines.recode_classes(test, sample, "y")


QUERIES["recode_classes"] = _recode
SQL["recode_classes"] = (
    "WITH s AS (SELECT DISTINCT s_nationkey AS y, 0 AS late FROM supplier), t AS (SELECT DISTINCT c_nationkey AS y, 1 AS late "
    "FROM customer WHERE c_nationkey NOT IN (SELECT y FROM s)) SELECT y, row_number() OVER (ORDER BY late, y) - 1 AS code FROM (SELECT * FROM s UNION ALL SELECT * FROM t)"
)
QUERIES["shared_categories"] = lambda spark, folder: baselines.shared_categories(
    load(spark, folder, "customer").select(F.col("c_nationkey").alias("k")), load(spark, folder, "supplier").select(F.col("s_nationkey").alias("k")), "k")
SQL["shared_categories"] = "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"
