"""The corpus operators as registered queries, each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import ann, bpe, centroids, licenses, line_dedup, mixing, mtree, quality, resample, secrets, simhash, token_counts, urls
from tabloom.llm.common import load

PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"


def byte_vocabulary() -> bpe.Ranks:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the pieces and scores of a public vocabulary."""
    import public_tokenizers

    return token_counts.token_counts(load(spark, sf_dir, "documents"), token_counts.read_pieces(public_tokenizers.path(PIECES)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.find_secrets(load(spark, sf_dir, "documents")).drop("found")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge_urls(load(spark, sf_dir, "pages"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.find_licenses(load(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    q = F.col("quality")
    return quality.judge(load(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    )


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth vector."""
    return ann.search(load(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, k=10)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that other documents have too."""
    out = line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the bytes they decode to, as digests."""
    coded = bpe.encode(load(spark, sf_dir, "documents"), byte_vocabulary())
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn to look like the benchmark, and the scores of all."""
    return resample.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows of the largest inner product with every hundredth vector."""
    return mtree.search(load(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, k=10)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after five rounds, and the inertia."""
    return centroids.cluster(load(spark, sf_dir, "embeddings")).drop("centroid")


_WORD = r"[^\x20\x09-\x0D]"
_STOP = ", ".join(f"'{w}'" for w in sorted({w for some in quality.STOP_WORDS.values() for w in some}))

OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{_WORD}+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM split),
g AS (SELECT rid, pos, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS gram
  FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) AS n FROM g WHERE gram[5] IS NOT NULL) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT pos + o) AS n FROM twice, (SELECT unnest(range(5)) AS o) GROUP BY rid),
c AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(covered.n, 0) AS n_repeat_words, strlen(t) <= length(t) * 1.2 AS latin, len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop
  FROM split LEFT JOIN covered USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars / n_words > 40 OR n_symbols / n_words > 0.3
    OR (n_lines >= 4 AND n_dup_lines / n_lines > 0.5) OR (latin AND n_words >= 200 AND n_stop = 0)) AS kept
FROM c
"""

OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 AND doc_id IS NOT NULL
  GROUP BY key HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT k.*, first IS NOT NULL AND k.doc_id IS NOT NULL AND k.doc_id <> first AS gone FROM k LEFT JOIN shared USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""

OP11_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x] || range(8),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT row_number() OVER () AS rid, true AS own, doc_id AS id, text FROM documents
  UNION ALL SELECT row_number() OVER (), false, item_id, text FROM benchmark),
w AS (SELECT rid, own, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
f AS (SELECT rid, own, unnest(ws) AS word FROM w),
hexed AS (SELECT word, hex(word) AS h FROM (SELECT DISTINCT word FROM f)),
b AS (SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, crc),
n AS (SELECT bucket, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM f JOIN b USING (word) GROUP BY bucket),
total AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM n),
g AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000))))::BIGINT AS gain FROM n, total),
weights AS (SELECT rid, sum(gain)::BIGINT AS weight FROM f JOIN b USING (word) JOIN g USING (bucket) WHERE own GROUP BY rid),
d AS (SELECT rid, id AS doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN weights USING (rid) WHERE own),
sc AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
  10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS draw FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= draw THEN place END AS rank FROM r
"""

OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranks AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranks WHERE rank <= 10
"""


def _op13_sql(rounds: int = 5) -> str:
    """The rounds one after another, each a join of all vectors with all centroids."""
    near = """SELECT rid, c, d FROM (SELECT rid, c, d, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS place FROM
  (SELECT rid, c, list_dot_product(x.v, x.v) + list_dot_product(m.v, m.v) - 2 * list_dot_product(x.v, m.v) AS d FROM x, {m} m)) WHERE place = 1"""
    steps = "".join(
        f""",
a{i} AS MATERIALIZED ({near.format(m=f"c{i}")}),
s{i} AS (SELECT c, pos, floor(sum(y) / count(*)) AS y FROM (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS pos FROM a{i} JOIN x USING (rid)) GROUP BY c, pos),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(y ORDER BY pos) AS v FROM s{i} GROUP BY c) m ON m.c = o.c)"""
        for i in range(rounds)
    )
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM x QUALIFY c < 40){steps},
last AS MATERIALIZED ({near.format(m=f"c{rounds}")})
SELECT vec_id, l.c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY l.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(m.v, lambda y: y::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM last l JOIN x USING (rid) JOIN c{rounds} m ON m.c = l.c
"""


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash": op3_simhash,
    "op4_url_filter": op4_url_filter,
    "op5_mix_sources": op5_mix_sources,
    "op6_license_scan": op6_license_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_nearest": op8_nearest,
    "op9_line_dedup": op9_line_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_resample": op11_resample,
    "op12_exact_search": op12_exact_search,
    "op13_centroids": op13_centroids,
}

SQL = {
    "op7_quality_rules": OP7_SQL, "op9_line_dedup": OP9_SQL, "op11_resample": OP11_SQL, "op12_exact_search": OP12_SQL,
    "op13_centroids": _op13_sql(),
}
