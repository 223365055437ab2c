"""File formats, task folders, derivations, toy tables: round trips over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import columns, shards
from tabloom.operators.ordering import position
from tabloom.plans import reshard, tables_to_samples, training
from tabloom.config import DataConfig, PipelineConfig
from tabloom.registered.common import load, q, uniform
from tabloom.session import cut_lineage, scratch_path
from tabloom.sources import arff, synthetic, tables, tar, taskconfig
from tabloom.sources.commit import shard_files

QUERIES, SQL = {}, {}


def _shard_count(docs):
    """Four shards, and more where those would hold over 64 MB of text each."""
    return max(4, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (1 << 26) + 1)


def _tar(spark, folder):
    df = load(spark, folder, "documents")
    body = F.to_json(F.struct("text", F.col("lang").alias("class_label_as_text"), F.col("source").alias("filename")))
    path = scratch_path(spark, "tar")
    tar.write_tar(df.select(F.concat_ws("__", "lang", "doc_id").alias("key"), body.alias("json")).repartition(_shard_count(df), "key"), path, "docs")
    back = training.samples_from_tar(tar.read_tar(spark, path, split_bytes=256 * 1024))
    return back.select("key", F.md5(F.col("text").cast("binary")).alias("text_md5"), "class_label_as_text", "filename")


QUERIES["tar_round_trip"] = _tar
SQL["tar_round_trip"] = "SELECT lang || '__' || doc_id AS key, md5(text) AS text_md5, lang AS class_label_as_text, source AS filename FROM documents"


def _tar_corrupt(spark, folder):
    """One small shard loses the header of its middle sample: every sample before it and in the other shards
    comes back, and the problem is told once, whatever the splits."""
    from tabloom.sources.files import filesystem

    df = load(spark, folder, "documents")
    path = scratch_path(spark, "tar")
    body = F.to_json(F.struct("text", F.col("lang").alias("class_label_as_text"), F.col("source").alias("filename")))
    samples = df.select(F.concat_ws("__", "lang", "doc_id").alias("key"), body.alias("json"))
    placed = cut_lineage(shards.shard_by_size(samples.withColumn("bytes", F.octet_length("json") + 1024), ["key"], "bytes", 1 << 18))
    count = placed.agg(F.max("shard") + 1).first()[0]
    tar.write_numbered(placed.select("key", "json", "shard"), path, 1 << 18, count - 1, "docs")
    index = cut_lineage(tar.read_index(spark, path))
    # The first shard's middle sample; those before it in that shard stay readable.
    held = index.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).orderBy("name").limit(1)
    broken = position(index.join(F.broadcast(held.select("name", "n")), "name"), [], ["offset"], out="nth", bound=1).where("nth = n div 2")

    def damage(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = filesystem(row["path"])
                with fs.open_input_file(row["path"]) as f:
                    raw = bytearray(f.read())
                raw[row["offset"] : row["offset"] + 512] = b"x" * 512
                with fs.open_output_stream(row["path"]) as f:
                    f.write(bytes(raw))
            yield batch

    lost = cut_lineage(broken.select("path", "offset", (F.col("n") - F.col("nth")).alias("behind")).mapInArrow(damage, "path string, offset long, behind long"))
    rows = tar.read_tar(spark, path, split_bytes=64 * 1024)
    told = rows.groupBy(F.lit(1).alias("one")).agg(F.count("problem").alias("problems"), F.count_distinct(F.when(F.col("problem").isNotNull(), F.col("shard"))).alias("shards"))
    behind = lost.first()["behind"]
    survivors = rows.where("problem is null").select("key").join(samples.select("key"), "key").count()
    return told.select("problems", "shards", F.lit(survivors + behind).alias("survivors_and_lost"))


QUERIES["tar_corrupt_reported"] = _tar_corrupt
SQL["tar_corrupt_reported"] = "SELECT count(DISTINCT 1) AS problems, count(DISTINCT 1) AS shards, count(*) AS survivors_and_lost FROM documents"


def _reshard(spark, folder):
    """Shards of documents become shards of half the size in their place: every member as it was, in order."""
    df = load(spark, folder, "documents")
    path = scratch_path(spark, "tar")
    body = F.to_json(F.struct("text", "lang", "source"))
    tar.write_tar(df.select(F.concat_ws("__", "lang", "doc_id").alias("key"), body.alias("json")).repartition(_shard_count(df), "key"), path, "docs")

    def member_places():
        index = cut_lineage(tar.read_index(spark, path).select("name", "key", "offset", "length"))
        return position(index, [], ["name", "offset"], out="place").select("key", "length", "place")

    before = member_places()
    target = max(size for _, size, _ in shard_files(path)) // 2
    made = reshard.reshard(spark, path, target, "docs")
    # A shard holds its share and no more than the sample that crosses into it.
    fits = made.agg(F.max("bytes") <= target + before.agg(F.max("length")).first()[0] + 2048).first()[0]
    after = member_places().withColumnsRenamed({"length": "new_length", "place": "new_place"})
    # Digests meet the places; texts do not move.
    text_md5 = F.md5(F.from_json("json", "text string")["text"].cast("binary"))
    back = tar.read_tar(spark, path, strict=True).select("key", text_md5.alias("text_md5"))
    same = (F.col("place") == F.col("new_place")) & (F.col("length") == F.col("new_length"))
    return back.join(before, "key").join(after, "key").select(
        "key", "text_md5", same.alias("in_place"), F.lit(fits).alias("fits"))


QUERIES["reshard_shards"] = _reshard
SQL["reshard_shards"] = "SELECT lang || '__' || doc_id AS key, md5(text) AS text_md5, true AS in_place, true AS fits FROM documents"


def _arff(spark, folder):
    df = load(spark, folder, "part")
    path = scratch_path(spark, "arff")
    lines = df.select(F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit("'"), "p_name", F.lit("'")), F.col("p_brand"),
                                  F.when(F.col("p_size") > 0, F.col("p_size").cast("string")).otherwise(F.lit("?")), F.col("p_retailprice").cast("string")).alias("value"))
    head = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (
        "% parts", "@relation part", "@attribute p_partkey integer", "@attribute 'part name' string", "@ATTRIBUTE p_brand {A, B}",
        "@attribute p_size numeric", "@attribute p_retailprice real", "@data")])).alias("value"))
    head.unionByName(lines).write.text(path)
    return arff.read_arff(spark, path)


QUERIES["arff_scan"] = _arff
SQL["arff_scan"] = (
    "SELECT p_partkey::DOUBLE AS p_partkey, p_name AS \"part name\", p_brand, CASE WHEN p_size > 0 THEN p_size::DOUBLE END AS p_size, p_retailprice FROM part"
)


def _csv(spark, folder):
    path = scratch_path(spark, "named.csv.gz")
    df = load(spark, folder, "orders")
    df.write.option("header", True).option("compression", "gzip").csv(path)
    out = tables.read_named_csv(spark, path, ["key", "customer", "status", "price", "day", "priority"])
    return out.select(F.col("key").cast("long").alias("key"), "status", "price", F.substring("day", 1, 10).alias("day"))


QUERIES["csv_named_scan"] = _csv
SQL["csv_named_scan"] = "SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"


def _folder_scan(spark, folder):
    path = scratch_path(spark, "many")
    for name, cols in (("a", ["c_custkey", "c_name"]), ("b", ["c_custkey", "c_name"]), ("c", ["c_custkey", "c_acctbal"])):
        load(spark, folder, "customer").select(*cols).coalesce(1).write.parquet(f"{path}/{name}")
    groups, _ = tables.schema_groups(tables.list_tables(spark, path))
    out = None
    for schema, paths in groups:
        g = tables.read_group(spark, paths).withColumn("table", F.element_at(F.split("table_id", "/"), -2))
        g = g.groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys")).withColumn("columns", F.lit(len(schema)).cast("int"))
        out = g if out is None else out.unionByName(g)
    return out


QUERIES["folder_scan"] = _folder_scan
SQL["folder_scan"] = (
    "SELECT t AS \"table\", count(*) AS n, sum(c_custkey)::BIGINT AS keys, 2 AS columns FROM customer, (SELECT unnest(['a', 'b', 'c']) AS t) GROUP BY t"
)


def _bundle(spark, folder):
    df = load(spark, folder, "customer").select(F.col("c_name").alias("the.name"), F.col("c_nationkey").alias("c__nation"), "c_acctbal")
    data, features, config = tables.task_bundle(df, "bank", to_regression=True)
    path = scratch_path(spark, "bundle")
    tables.write_task_bundle((data, features, config), path)
    back = spark.read.json(f"{path}/feature_list").select("name", "is_target", "kind")
    labels = spark.read.json(f"{path}/task_config").count()
    return back.withColumn("labels", F.lit(labels)).withColumn("rows", F.lit(data.count()).cast("long"))


QUERIES["task_bundle"] = _bundle
SQL["task_bundle"] = (
    "SELECT name, is_target, kind, 4 AS labels, (SELECT count(*) FROM customer) AS rows FROM (VALUES ('the_name', false, 'categorical'), ('c_nation', false, 'int'), "
    "('c_acctbal', true, 'categorical')) AS t(name, is_target, kind)"
)


def _task_folder(spark, folder):
    path = scratch_path(spark, "task")
    df = load(spark, folder, "supplier")
    df.coalesce(1).write.option("header", True).csv(path)
    spark.createDataFrame(
        [("s_nationkey", None, True, [], {"0": "zero"}, "nation", None, "int"), ("s_suppkey", None, False, [], None, None, None, "int")],
        columns.FEATURE_LIST_SCHEMA).coalesce(1).write.mode("append").json(path + "-list")
    from tabloom.sources.files import filesystem, listing

    fs, _ = filesystem(path)
    for i, (p, _) in enumerate(listing(path + "-list", ".json")):
        fs.copy_file(p, f"{filesystem(path)[1]}/features{i}.jsonl")
    return tables.load_task(spark, path, row_keys=["s_suppkey"], values="map", names="map", seed=4).select(
        "nation", F.col("s_suppkey").cast("long").alias("s_suppkey"), "split")


_u = uniform(4, q("split"), "s_suppkey::VARCHAR")
QUERIES["task_folder_scan"] = _task_folder
SQL["task_folder_scan"] = (
    f"SELECT CASE s_nationkey WHEN 0 THEN 'zero' ELSE s_nationkey::VARCHAR END AS nation, s_suppkey, CASE WHEN {_u} < 0.8 THEN 'train' WHEN {_u} < 0.8::DOUBLE + 0.1::DOUBLE "
    "THEN 'validation' ELSE 'test' END AS split FROM supplier"
)


def _config_join(spark, folder):
    path = scratch_path(spark, "configs")
    segs = load(spark, folder, "customer").select("c_mktsegment").distinct()
    body = F.concat(F.lit("label_values:\n- 1\n- 2.5\nlabels_mapping: null\nprefix: Predict "), "c_mktsegment", F.lit("\nsuffix: 'What, for "), "c_mktsegment", F.lit("?'\ntask_context: null"))
    segs.select(body.alias("value"), F.col("c_mktsegment").alias("t")).write.partitionBy("t").option("lineSep", "\n").text(path)
    from tabloom.sources.files import filesystem, listing

    fs, root = filesystem(path)
    for p, _ in listing(path, ".txt"):
        seg = p.split("/t=")[1].split("/")[0]
        fs.create_dir(f"{root}-yaml/{seg}", recursive=True)
        fs.copy_file(p, f"{root}-yaml/{seg}/task.yaml")
    configs = taskconfig.read_configs(spark, f"{root}-yaml")
    df = load(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("task"))
    return taskconfig.join_configs(df, configs).select("c_custkey", "prefix", "suffix", F.array_join("label_values", "|").alias("labels"), "problem")


QUERIES["config_join"] = _config_join
SQL["config_join"] = (
    "SELECT c_custkey, 'Predict ' || c_mktsegment AS prefix, 'What, for ' || c_mktsegment || '?' AS suffix, '1|2.5' AS labels, NULL::VARCHAR AS problem FROM customer"
)


# --- derivations -----------------------------------------------------------------------------

def _derive(spark, folder):
    o = load(spark, folder, "orders")
    price = F.col("o_totalprice")
    a = columns.nhis_diabetes(o.select("o_orderkey", F.when(price > 100000, F.pmod("o_custkey", F.lit(100))).alias("DIABETICAGE")))
    b = columns.bank_marketing(o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("y")))
    c = columns.covertype(o.select("o_orderkey", F.pmod("o_custkey", F.lit(7)).alias("Cover_Type")))
    d = columns.magic_telescope(o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "g").otherwise("h").alias("class"))).withColumnRenamed("o_orderkey:", "o_orderkey")
    return a.join(b, "o_orderkey").join(c, "o_orderkey").join(d, "o_orderkey")


QUERIES["derive_binary_targets"] = _derive
SQL["derive_binary_targets"] = (
    "SELECT o_orderkey, coalesce((CASE WHEN o_totalprice > 100000 THEN o_custkey % 100 END <= 85)::INT, 0) AS diabetes, (o_orderstatus = 'F')::INT AS y, "
    "(o_custkey % 7 = 2) AS \"Cover_Type\", (o_orderstatus = 'O')::INT AS is_signal FROM orders"
)


def _derive_filter(spark, folder):
    e = load(spark, folder, "events")
    k = F.pmod("user_id", F.lit(5))
    a = columns.dhs_diabetes(e.select("event_id", F.when(k > 0, F.col("value")).alias("ALFREQ"), F.when(k > 1, F.lit(1.0)).alias("HIGHBP"),
                                      F.when(k > 2, F.lit(2.0)).alias("RELIGION"), k.cast("double").alias("DIABETES")))
    b = columns.road_safety(e.select("event_id", k.cast("double").cast("string").alias("Sex_of_Driver")))
    return a.join(b, "event_id", "full")


QUERIES["derive_filtered"] = _derive_filter
SQL["derive_filtered"] = (
    "SELECT coalesce(a.event_id, b.event_id) AS event_id, \"ALFREQ\", \"HIGHBP\", \"RELIGION\", \"DIABETES\", \"Sex_of_Driver\" FROM (SELECT event_id, coalesce(CASE WHEN user_id % 5 > 0 THEN value END, 998.0) AS "
    "\"ALFREQ\", CASE WHEN user_id % 5 > 1 THEN 1.0::DOUBLE ELSE 9.0::DOUBLE END AS \"HIGHBP\", CASE WHEN user_id % 5 > 2 THEN 2.0::DOUBLE ELSE 9998.0::DOUBLE END AS \"RELIGION\", (user_id % 5)::DOUBLE AS "
    "\"DIABETES\" FROM events WHERE user_id % 5 IN (0, 1)) a FULL JOIN (SELECT event_id, (user_id % 5)::DOUBLE::VARCHAR AS \"Sex_of_Driver\" FROM events WHERE user_id % 5 IN (1, 2)) b USING (event_id)"
)


# --- toy tables on the keys of a table -------------------------------------------------------

def _toy(name):
    def run(spark, folder):
        df = load(spark, folder, "orders").select("o_orderkey")
        out = synthetic.GENERATORS[name](df, "o_orderkey", df.count())
        return out.select("o_orderkey", F.round("x_0", 8).alias("x_0"), F.round("x_1", 8).alias("x_1"), "y")

    return run


def _gauss(which, k="o_orderkey::VARCHAR", seed=synthetic.SEED):
    return f"(sqrt(-2.0 * ln(1.0::DOUBLE - {uniform(seed, q('u'), q(which), k)})) * cos(2 * pi() * {uniform(seed, q('v'), q(which), k)}))"


def _toy_sql(x0, x1, y, noise=0.0):
    n0, n1 = (f" + {noise}::DOUBLE * {_gauss(w)}" if noise else "" for w in ("x0", "x1"))
    return (
        f"SELECT o_orderkey, round({x0}{n0}, 8) AS x_0, round({x1}{n1}, 8) AS x_1, ({y})::INT AS y FROM (SELECT o_orderkey, o_orderkey >= n // 2 AS inside, "
        "CASE WHEN o_orderkey >= n // 2 THEN o_orderkey - n // 2 ELSE o_orderkey END::DOUBLE AS k, CASE WHEN o_orderkey >= n // 2 THEN n - n // 2 ELSE n // 2 END::DOUBLE AS m, "
        "o_orderkey % 3 AS c FROM orders, (SELECT count(*) AS n FROM orders))"
    )


_r = "CASE WHEN inside THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"
QUERIES["synthetic_circles"] = _toy("noisy_circles")
SQL["synthetic_circles"] = _toy_sql(f"{_r} * cos(2 * pi() * k / m)", f"{_r} * sin(2 * pi() * k / m)", "inside", 0.05)
QUERIES["synthetic_moons"] = _toy("noisy_moons")
SQL["synthetic_moons"] = _toy_sql("CASE WHEN inside THEN 1.0::DOUBLE - cos(pi() * k / (m - 1)) ELSE cos(pi() * k / (m - 1)) END",
                                  "CASE WHEN inside THEN 0.5::DOUBLE - sin(pi() * k / (m - 1)) ELSE sin(pi() * k / (m - 1)) END", "inside", 0.05)


def _blob_sql(std, matrix=None):
    import random

    rng = random.Random(synthetic.SEED)
    centers = [(rng.uniform(-10.0, 10.0), rng.uniform(-10.0, 10.0)) for _ in std]

    def pick(vals):
        return "CASE c " + " ".join(f"WHEN {i} THEN {v!r}::DOUBLE" for i, v in enumerate(vals)) + " END"

    x0, x1 = (f"(({pick([c[j] for c in centers])}) + ({pick(std)}) * {_gauss(w)})" for j, w in enumerate(("x0", "x1")))
    if matrix:
        (a, b), (c, d) = matrix
        x0, x1 = f"({x0} * {a}::DOUBLE + {x1} * {c}::DOUBLE)", f"({x0} * {b}::DOUBLE + {x1} * {d}::DOUBLE)"
    return _toy_sql(x0, x1, "c")


QUERIES["synthetic_blobs"] = _toy("blobs")
SQL["synthetic_blobs"] = _blob_sql((1.0, 1.0, 1.0))
QUERIES["synthetic_varied"] = _toy("varied_clusters")
SQL["synthetic_varied"] = _blob_sql(synthetic.VARIED_STD)
QUERIES["synthetic_anisotropic"] = _toy("anisotropic_clusters")
SQL["synthetic_anisotropic"] = _blob_sql((1.0, 1.0, 1.0), synthetic.ANISOTROPIC)
_x0, _x1 = (uniform(synthetic.SEED, q(w), "o_orderkey::VARCHAR") for w in ("x0", "x1"))
QUERIES["synthetic_linear"] = _toy("linearly_separable")
SQL["synthetic_linear"] = _toy_sql(_x0, _x1, f"{_x1} - {_x0} + 0.1::DOUBLE * {_gauss('n')} > 0")


# --- whole lifecycle -------------------------------------------------------------------------

def _tables_to_samples(spark, folder):
    """Tables of a folder to shards: the given tables are written as a folder of unlabelled ones."""
    path = scratch_path(spark, "lake")
    for t in ("customer", "orders", "part", "supplier"):
        # One file is one table; row groups of a few MB let many tasks read it.
        load(spark, folder, t).coalesce(1).write.option("parquet.block.size", 4 << 20).parquet(f"{path}/in/{t}")
    samples = tables_to_samples.run(spark, f"{path}/in", f"{path}/out", pipeline=PipelineConfig(train_frac="0.75"), seed=3)
    files = tables_to_samples.to_shards(samples, f"{path}/shards", PipelineConfig(target_shard_mb=1))
    back = None
    for split in sorted({r["split"] for r in files.select("split").distinct().collect()}):
        s = training.samples_from_tar(tar.read_tar(spark, f"{path}/shards/{split}")).withColumn("split", F.lit(split))
        back = s if back is None else back.unionByName(s)
    table = F.element_at(F.split("filename", "/"), -2)
    return back.groupBy(table.alias("table_name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))


QUERIES["tables_to_samples"] = _tables_to_samples
# Every row of every table becomes one sample of its own in exactly one shard.
SQL["tables_to_samples"] = " UNION ALL ".join(
    f"SELECT {q(t)} AS table_name, count(*) AS n, count(*) AS keys FROM {t}" for t in ("customer", "orders", "part", "supplier"))


def _samples_rejects(spark, folder):
    """The same with everything that can go wrong: every row of every table is a sample or a letter, and both are counted."""
    from tabloom.sources.files import filesystem

    path = scratch_path(spark, "lake")
    for t in ("customer", "orders", "part"):
        load(spark, folder, t).write.parquet(f"{path}/in/{t}")
    load(spark, folder, "supplier").select("s_suppkey").repartition(2).write.parquet(f"{path}/in/supplier")

    def spoil(batches):
        for batch in batches:
            fs, root = filesystem(path)
            fs.create_dir(f"{root}/in/spoilt", recursive=True)
            with fs.open_output_stream(f"{root}/in/spoilt/a.parquet") as f:
                f.write(b"no table")
            yield batch

    spark.range(1).mapInArrow(spoil, "id long").count()
    counts: dict[str, int] = {}
    samples = tables_to_samples.run(
        spark, f"{path}/in", f"{path}/out", pipeline=PipelineConfig(max_chars=270), seed=3, skip_unreadable=True, counts=counts)
    refused = tables_to_samples.rejected(spark, f"{path}/out")
    of = lambda c: F.element_at(F.split(c, "/"), -2).alias("table_name")
    rows = samples.select(of("filename"), F.lit("kept").alias("outcome"), F.lit(1).cast("long").alias("rows")).unionByName(
        refused.select(of("source"), F.when(F.contains("reason", F.lit("no t")) | (F.col("reason") == "too long"), F.col("reason")).otherwise("unreadable").alias("outcome"), "rows"))
    told = rows.groupBy("table_name").agg(F.sum("rows").alias("n"), F.array_join(F.array_sort(F.collect_set(
        F.when(F.col("outcome").isin("kept", "too long"), "row").otherwise(F.col("outcome")))), ",").alias("kinds"))
    both = samples.count() == counts["kept"] > 0 and refused.where("reason = 'too long'").count() == counts["rejected"] > 0
    return told.withColumn("counted", F.lit(both))


QUERIES["tables_to_samples_rejects"] = _samples_rejects
SQL["tables_to_samples_rejects"] = " UNION ALL ".join(
    f"SELECT {q(t)} AS table_name, count(*)::BIGINT AS n, {q(kind)} AS kinds, true AS counted FROM {t}"
    for t, kind in (("customer", "row"), ("orders", "row"), ("part", "row"), ("supplier", "no target"))
) + " UNION ALL SELECT 'spoilt', NULL::BIGINT, 'unreadable', true"


def _training(spark, folder):
    c = load(spark, folder, "conversations")
    s = c.select(F.concat(F.lit("c"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("__"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("key"), "text", F.col("role").alias("class_label_as_text"))
    out = training.assemble(s, DataConfig(pack_batch=25, max_len=4096))
    return out.select("batch", "part", F.size("input_ids").alias("n"))


QUERIES["training_sequences"] = _training
SQL["training_sequences"] = (
    "SELECT batch, part, least(total - part * 4096, 4096)::INT AS n FROM (SELECT *, unnest(range((total + 4095) // 4096))::INT AS part FROM ("
    "SELECT batch, sum(strlen(text) + strlen(role) + 3)::BIGINT AS total FROM (SELECT text, role, (row_number() OVER (ORDER BY lpad(conv_id::VARCHAR, 8, '0'), turn) - 1) // 25 AS batch "
    "FROM conversations) GROUP BY batch))"
)
