from collections import Counter

import pytest
from pyspark.sql import functions as F

import tabflow as tf

from conftest import rows


def test_order_puts_nulls_first(scores):
    assert [r.Score for r in tf.order_by(scores, "Score").collect()] == [None, 11.0, 20.0, 30.0]
    assert tf.order_by(scores, "Score").columns == scores.columns
    assert tf.order_by(scores, []) is scores


def test_order_by_several(spark):
    df = spark.createDataFrame([(2, "b"), (1, "b"), (1, "a")], "n int, s string")
    assert [tuple(r) for r in tf.order_by(df, ["n", "s"]).collect()] == [(1, "a"), (1, "b"), (2, "b")]


def test_order_spreads_a_repeated_value(spark):
    df = spark.range(20000).selectExpr("id", "1 AS same").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = tf.order_by(df, "same").select(F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = Counter(r[0] for r in tasks)
    assert sum(sizes.values()) == 20000
    assert len(sizes) == 8 and max(sizes.values()) < 5000


def test_order_of_map_columns(spark):
    df = spark.sql("SELECT 2 AS n, map('a', 1) AS m UNION ALL SELECT 1, map('b', 2)")
    assert [r.n for r in tf.order_by(df, "n").collect()] == [1, 2]


def test_limit(scores):
    assert tf.limit(scores, 2).count() == 2
    assert tf.limit(scores, 0).count() == 0


def test_top_k_is_one_step(scores):
    plan = tf.limit(tf.order_by(scores, "Score"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_union_is_by_position(spark):
    left = spark.createDataFrame([(1, "x")], "a int, b string")
    right = spark.createDataFrame([(2, "y")], "b bigint, a string")
    assert rows(tf.union(left, right)) == [(1, "x"), (2, "y")]
    assert tf.union(left, right).columns == ["a", "b"]


def test_union_refuses_other_types(spark):
    left = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(TypeError, match="'a'"):
        tf.union(left, left.select("b", "a"))
    with pytest.raises(ValueError, match="2 columns with 1"):
        tf.union(left, left.select("a"))


def test_union_by_name(spark):
    left = spark.createDataFrame([(1, "x")], "a int, b string")
    assert rows(tf.union_by_name(left, left.select("b", "a"))) == [(1, "x"), (1, "x")]
    with pytest.raises(ValueError, match="only one side has"):
        tf.union_by_name(left, left.select("a"))
    with pytest.raises(TypeError, match="'a'"):
        tf.union_by_name(left, left.selectExpr("b", "string(a) AS a"))


def test_distinct(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert rows(tf.distinct(df)) == [(1, None), (2, "x")]


def test_equal_rows_sort_in_many_tasks(spark):
    """A million copies of one row, beside others."""
    one = spark.range(0, 1_000_000, 1, 8).selectExpr("7 AS a", "'x' AS b", "double('-0.0') AS c")
    other = spark.range(100).selectExpr("int(id % 15) AS a", "string(id) AS b", "double(0) AS c")
    df = one.unionAll(other)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        out = tf.order_by(df, "a")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 1_000_100 and max(sizes) < 400_000
        got = out.select("a", "b", F.col("c").cast("string").alias("c")).collect()
    finally:
        spark.conf.unset(setting)
    assert [r.a for r in got] == sorted(r.a for r in got)
    assert sum(r.b == "x" and r.c == "-0.0" for r in got) == 1_000_000


def test_counted_sort_by_brute_force(spark):
    import random

    r = random.Random(8)
    data = [r.choice([(1, "a", 0.0, [1]), (1, "a", -0.0, [1]), (1, "a", float("nan"), None), (None, None, None, []), (2, "b", 1.5, [2, None]), (r.randint(0, 5), "c", r.random(), [3])]) for _ in range(500)]
    df = spark.createDataFrame(data, "`a a` int, b string, c double, d array<int>").repartition(4)
    for hot in (1, 20, 10**6):
        out = tf.order_by(df, ["a a", "b"], skew=tf.SkewPolicy(small_bytes=0, hot_rows=hot))
        assert out.columns == df.columns
        got = [tuple(map(str, x)) for x in out.collect()]
        assert sorted(got) == sorted(tuple(map(str, x)) for x in data)
        keys = [(x["a a"], x.b) for x in out.collect()]
        assert keys == sorted(keys, key=lambda k: (k[0] is not None, k[0] or 0, k[1] is not None, k[1] or ""))
    maps = df.selectExpr("*", "map('k', b) AS m")
    assert tf.order_by(maps, "b", skew=tf.SkewPolicy(small_bytes=0, hot_rows=1)).count() == 500
