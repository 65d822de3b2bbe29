"""Row multiplicity of column-less joins (J21, J33) and its hot-group path."""

from pyspark.sql import functions as F

from settlekit.operators import fanout


def test_replicate_small_counts(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 0)], "k long, copies long")
    out = fanout.replicate(df, "copies")
    assert out.columns == ["k"]
    got = sorted(r["k"] for r in out.collect())
    assert got == [1, 2, 2, 2, 3, 4]


def test_replicate_hot_group_is_split_across_tasks(spark):
    n = fanout.CHUNK * 5000 + 17
    df = spark.createDataFrame([(1, n), (2, 2)], "k long, copies long").coalesce(1)
    sizes = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    for size in sizes:  # as if the rows were many
        spark.conf.set(size, "1k")
    try:
        out = fanout.replicate(df, "copies").select("k", F.spark_partition_id().alias("p"))
        rows = out.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("p").alias("tasks")).collect()
    finally:
        for size in sizes:
            spark.conf.unset(size)
    assert {r["k"]: r["c"] for r in rows} == {1: n, 2: 2}
    assert next(r["tasks"] for r in rows if r["k"] == 1) > 1
