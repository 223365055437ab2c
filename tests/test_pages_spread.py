from tabloom.registered import metadata


def test_pages_of_one_file_are_parsed_by_many_tasks(spark, tmp_path):
    rows = spark.range(12_000).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size")
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name, per_page in (("page_sections", 10), ("page_variables", 1)):
        out = metadata.QUERIES[name](spark, str(tmp_path))
        assert out.rdd.getNumPartitions() >= 3 and out.count() == 12_000 * per_page
