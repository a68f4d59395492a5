from treelake import model


def test_large_tables_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(1000).selectExpr("id % 250 as l_orderkey", "id % 10 as l_partkey", "id % 5 as l_suppkey")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(model, "TASK_BYTES", 200)
    dealt = model.dealt(spark, str(tmp_path), "lineitem", "l_orderkey")
    assert dealt.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, rows.collect()))
    monkeypatch.setattr(model, "TASK_BYTES", 8 << 20)
    assert model.dealt(spark, str(tmp_path), "lineitem", "l_orderkey").rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
