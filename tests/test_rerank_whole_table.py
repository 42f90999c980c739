from lexmill.plans import queries


def test_failed_rerank_reads_the_whole_table(spark, tmp_path):
    spark.range(100, 130).withColumnRenamed("id", "item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.QUERIES["e10_failed_rerank"](spark, str(tmp_path)).collect()
    assert sorted((r.item_id, r.rank) for r in got) == [(100 + k, k + 1) for k in range(10)]
