from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.operators import pick, skew


def _rows(spark, n=60_000):
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 1000)
    return spark.range(n).select(F.col("id").alias("row"), key.cast("bigint").alias("k"))


def test_hot_keys_are_found_and_bounded(spark):
    hot = skew.hot_keys(_rows(spark), "k", share=32, min_rows=0)
    assert [k for k, _ in hot] == [7]
    assert 8 <= hot[0][1] <= 32
    assert skew.hot_keys(_rows(spark), "k") == []


def test_split_join_equals_plain_join(spark):
    rows = _rows(spark)
    unique = spark.range(900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        split = skew.join_to_unique(rows, unique, "k", ["row"], how, share=64, min_rows=0)
        plain = rows.join(unique, "k", how)
        assert split.columns == ["k", "row", "v"]
        assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0


def test_no_part_of_a_hot_key_dominates(spark):
    rows = _rows(spark)
    unique = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        split = skew.join_to_unique(rows, unique, "k", ["row"], "left", share=64, min_rows=0)
        largest = split.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        plain = rows.join(unique, "k", "left").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert plain > 20_000 and largest < 8_000


def test_group_arrays_keep_every_row_in_bounded_chunks(spark):
    rows = _rows(spark).filter("k is not null")
    chunks = pick.group_arrays(rows, "k", "row", [], F.col("row"), "members", limit=500)
    sizes = chunks.agg(F.max(F.size("members")), F.sum(F.size("members"))).first()
    assert sizes[0] <= 500 and sizes[1] == rows.count()
    flat = chunks.select("k", F.explode("members").alias("row"))
    assert flat.exceptAll(rows.select("k", "row")).count() == 0
    assert chunks.filter("k = 8").count() == 1
    assert chunks.filter(F.array_sort("members") != F.col("members")).count() == 0
    # Chunks follow each other in order, and only the last one of a key is not full.
    ends = chunks.select("k", "chunk", F.array_min("members").alias("low"), F.array_max("members").alias("high"), F.size("members").alias("n"))
    after = ends.select("k", (F.col("chunk") - 1).alias("chunk"), F.col("low").alias("next_low"))
    assert ends.join(after, ["k", "chunk"]).filter("high >= next_low or n <> 500").count() == 0
    whole = pick.group_arrays(rows, "k", "row", [], F.col("row"), "members", limit=10**6)
    assert whole.count() == whole.select("k").distinct().count()


def test_best_fields_and_top_per_key(spark):
    rows = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", None, "w")], "k string, t int, v string"
    )
    latest = {r.k: r.v for r in pick.best_fields(rows, ["k"], ["t", "v"], ["v"], latest=True).collect()}
    assert latest == {"a": "z", "b": "w"}
    top = pick.top_per_key(rows, ["k"], [F.col("t").desc_nulls_last(), F.col("v")], 2, rank="rk").collect()
    assert sorted((r.k, r.rk, r.v) for r in top) == [("a", 1, "y"), ("a", 2, "z"), ("b", 1, "w")]
