"""Dataset pages and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import pages, prompting
from tabloom.registered.common import load, q

QUERIES, SQL = {}, {}

QUERIES["page_text"] = lambda spark, folder: load(spark, folder, "pages").select("page_id", pages.visible_text(F.col("html")).alias("text"))
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def _unescaped(c):
    for a, b in _ENTITIES:
        c = f"replace({c}, {q(a)}, {q(b)})"
    return c


_WS = q(" \t\n\r\x0b\x0c\u00a0")
SQL["page_text"] = (
    "SELECT page_id, array_to_string(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '<x>', 'g'), "
    f"'(?s)<!--.*?-->', '<x>', 'g'), '<[^>]*>'), lambda t: trim({_unescaped('t')}, {_WS})), '') AS text FROM pages"
)

QUERIES["extract_urls"] = lambda spark, folder: load(spark, folder, "pages").select(
    "page_id", F.posexplode(prompting.extract_urls(F.concat("url", F.lit(" "), "html"))).alias("pos", "found"))
SQL["extract_urls"] = (
    "SELECT page_id, (generate_subscripts(u, 1) - 1)::INT AS pos, unnest(u) AS found FROM (SELECT page_id, regexp_extract_all(url || ' ' || html, "
    "'https?://(?:[-\\w.]|%[0-9a-fA-F]{2})[^\\s<>\"]*[^\\s<>\".,;]') AS u FROM pages)"
)


PAGES_A_TASK = 5_000


def _dataset_pages(spark, folder):
    """A dataset page per part, in the layout of a repository site.

    The narrow rows are dealt out before pages are made of them: the file of a few bytes a row gives few tasks, and
    every page is parsed.
    """
    p = load(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    p = p.repartition(p.count() // PAGES_A_TASK + 1)
    table = F.concat(
        F.lit('<table class="w-full"><thead><tr><th>Variable Name</th></tr></thead><tbody><tr><td> '), F.col("p_name"), F.lit(" </td><td>Feature</td><td>"), F.col("p_type"),
        F.lit("</td><td></td><td>size &amp; price</td><td>"), F.col("p_size").cast("string"), F.lit("</td><td>no</td></tr></tbody></table>"),
    )
    html = F.concat(
        F.lit("<html><body><div><h1>Subject Area</h1><span>x</span><p>"), F.col("p_brand"), F.lit("</p></div><div><h1># Instances</h1><p>"), F.col("p_partkey").cast("string"),
        F.lit('</p></div><div><h1>Dataset Information</h1></div><div><p>no</p><p class="whitespace-pre-wrap svelte-17wf9gp">About <b>'), F.col("p_name"), F.lit("</b>.</p></div>"), table,
        F.lit("</body></html>"),
    )
    return p.select("p_partkey", html.alias("html"))


QUERIES["page_sections"] = lambda spark, folder: pages.section_fields(_dataset_pages(spark, folder), "p_partkey", "html")
SQL["page_sections"] = (
    "SELECT p_partkey, field, CASE field WHEN 'Subject Area' THEN p_brand WHEN '# Instances' THEN p_partkey::VARCHAR WHEN 'Dataset Information' THEN 'About ' || p_name || '.' END "
    "AS value FROM part, (SELECT unnest([" + ", ".join(q(f) for f in pages.SUMMARY_FIELDS + pages.SECTION_FIELDS) + "]) AS field)"
)
QUERIES["page_variables"] = lambda spark, folder: pages.variables(_dataset_pages(spark, folder), "p_partkey", "html")
SQL["page_variables"] = (
    "SELECT p_partkey, 0 AS row_no, p_name AS \"Variable Name\", 'Feature' AS \"Role\", p_type AS \"Type\", '' AS \"Demographic\", 'size & price' AS \"Description\", "
    "p_size::VARCHAR AS \"Units\", 'no' AS \"Missing Values\" FROM part"
)


def _elements(spark, folder):
    """Metadata per brand: a description and the number of parts of each type."""
    p = load(spark, folder, "part")
    about = p.groupBy("p_brand").agg(F.concat(F.lit("parts: "), F.count(F.lit(1)).cast("string")).alias("body")).select(
        F.col("p_brand").alias("task"), F.lit(1).alias("ord"), F.lit("task_summary").alias("key"), F.lit("Summary").alias("description"), "body")
    types = p.groupBy("p_brand", "p_type").count().groupBy("p_brand").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "p_type", F.col("count").cast("string")))), "\n").alias("body")).select(
            F.col("p_brand").alias("task"), F.lit(2).alias("ord"), F.lit("target_distribution").alias("key"), F.lit("Distribution").alias("description"), "body")
    return about.unionByName(types)


_sep = "E'\\n\\n##############\\n\\n'"
_meta = (
    f"SELECT task, '<metadata>' || {_sep} || string_agg('<' || key || E'>\\n' || description || E':\\n' || body || E'\\n</' || key || '>', {_sep} ORDER BY ord) || {_sep} || '</metadata>' AS metadata "
    "FROM (SELECT p_brand AS task, 1 AS ord, 'task_summary' AS key, 'Summary' AS description, 'parts: ' || count(*) AS body FROM part GROUP BY p_brand UNION ALL "
    "SELECT task, 2, 'target_distribution', 'Distribution', string_agg(t, E'\\n' ORDER BY t) FROM (SELECT p_brand AS task, p_type || ' ' || count(*) AS t FROM part GROUP BY p_brand, p_type) GROUP BY task) GROUP BY task"
)
QUERIES["metadata_text"] = lambda spark, folder: prompting.metadata_text(_elements(spark, folder))
SQL["metadata_text"] = _meta
QUERIES["context_prompt"] = lambda spark, folder: prompting.make_prompt(prompting.metadata_text(_elements(spark, folder)), "task_context", prefix="Hello.", suffix="Bye.")
_tpl = prompting.TEMPLATES["task_context"].replace("{PREFIX}", "Hello.").replace("{SUFFIX}", "Bye.")
SQL["context_prompt"] = f"SELECT task, replace({q(_tpl)}, '{{METADATA}}', metadata) AS prompt FROM ({_meta})"


def _feature_prompts(spark, folder):
    feats = load(spark, folder, "part").select(
        F.col("p_brand").alias("task"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("name_extended"))
    out = prompting.make_feature_prompts(prompting.metadata_text(_elements(spark, folder)), feats, "feature_variants")
    return out.select("task", "feature", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


_ft = prompting.TEMPLATES["feature_variants"].replace("{PREFIX}", "").replace("{SUFFIX}", "")
QUERIES["feature_prompts"] = _feature_prompts
SQL["feature_prompts"] = (
    "SELECT task, 'f' || p_partkey AS feature, md5(replace(replace(replace(" + q(_ft) + ", '{FEATURE}', p_name), '{SERIALIZED_FEATURE}', "
    "'{\"name\":\"f' || p_partkey || '\",\"name_extended\":\"' || p_name || '\"}'), '{METADATA}', metadata)) AS prompt_md5 FROM part JOIN (" + _meta + ") ON task = p_brand"
)
QUERIES["feature_list_text"] = lambda spark, folder: prompting.feature_list_text(
    load(spark, folder, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("note")), F.col("note"), "p_partkey")
SQL["feature_list_text"] = (
    "SELECT p_brand AS task, string_agg('{\"name\":\"' || p_name || '\",\"note\":\"' || p_brand || '\"}', E'\\n' ORDER BY p_partkey) AS body FROM part GROUP BY p_brand"
)


def _json(spark, folder):
    answer = F.concat(F.lit("Sure: {not json} "), F.col("props"), F.lit(" or {\"a\": {\"b\": 1}} or {\"k\": \"long enough to win, always\"} or "), F.col("props"), F.lit(" {bad"))
    df = load(spark, folder, "events").select("event_id", answer.alias("a"))
    return df.select("event_id", prompting.parse_json_answer(F.col("a")).alias("last"), prompting.parse_json_answer(F.col("a"), "longest").alias("longest"))


_cands = "list_filter(regexp_extract_all(a, '(?s)\\{.*?\\}'), lambda c: json_valid(c))"
QUERIES["json_answer"] = _json
SQL["json_answer"] = (
    f"SELECT event_id, c[len(c)] AS last, (list_sort(list_transform(c, lambda x: {{'n': -length(x), 'x': x}})))[1].x AS longest FROM (SELECT event_id, {_cands} AS c FROM "
    "(SELECT event_id, 'Sure: {not json} ' || props || ' or {\"a\": {\"b\": 1}} or {\"k\": \"long enough to win, always\"} or ' || props || ' {bad' AS a FROM events))"
)


def _table_metadata(spark, folder):
    m = prompting.table_metadata(load(spark, folder, "customer"), "customer", "c_mktsegment", ["c_nationkey", "c_mktsegment"])
    return m.where("key = 'target_distribution'").select("task", "ord", "key", "body")


def _many_classes(spark, folder):
    """A target with a class for every part name and size: the distribution names them all."""
    df = load(spark, folder, "part").select(F.concat_ws(" of ", "p_name", F.col("p_size").cast("string")).alias("kind"))
    m = prompting.table_metadata(df, "part", "kind", ["kind"])
    return m.where("key = 'target_distribution'").select("task", F.size(F.split("body", "\n")).cast("long").alias("classes"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


_LINE = "kind || ' ' || k || ' ' || CASE WHEN round(k::DOUBLE / n, 6) < 0.0001 THEN regexp_replace(format('{:e}', round(k::DOUBLE / n, 6)), '[.]?0+e', 'e') ELSE round(k::DOUBLE / n, 6)::VARCHAR END"
QUERIES["distribution_many_classes"] = _many_classes
SQL["distribution_many_classes"] = (
    f"SELECT 'part' AS task, count(*) AS classes, md5(string_agg(line, E'\n' ORDER BY k DESC, line)) AS body_md5 FROM (SELECT k, {_LINE} AS line FROM "
    "(SELECT p_name || ' of ' || p_size AS kind, count(*) AS k, sum(count(*)) OVER () AS n FROM part GROUP BY 1))"
)
QUERIES["target_distribution"] = _table_metadata
SQL["target_distribution"] = (
    "SELECT 'customer' AS task, 2 AS ord, 'target_distribution' AS key, string_agg(c_mktsegment || ' ' || k || ' ' || round(k::DOUBLE / n, 6)::VARCHAR, E'\\n' ORDER BY k DESC, "
    "c_mktsegment || ' ' || k || ' ' || round(k::DOUBLE / n, 6)::VARCHAR) AS body FROM (SELECT c_mktsegment, count(*) AS k, sum(count(*)) OVER () AS n FROM customer GROUP BY 1)"
)
