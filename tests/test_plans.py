"""Plans have the shape that scales, and operators start no jobs."""

import re

import pytest

import __spark_entry__ as contract
import catalog
import tabflow as tf

from conftest import DATA

FOLDER = str(DATA / "sf0.01")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["Category", "event_id", "user_id", "Score"] and df.count() == 5
    # Operators for training data, where they are installed, are tested apart.
    own = catalog.QUERIES.keys()
    assert own <= contract.queries().keys() and own <= contract.oracle_sql().keys()
    assert own == catalog.SQL.keys()


def test_sample_job_pushes_down_and_prunes(spark):
    text = plan(catalog.etl_flagship(spark, FOLDER))
    assert "GreaterThan(value,10.0)" in text
    read = re.search(r"ReadSchema: struct<(.*?)>", text)[1]
    assert sorted(c.split(":")[0] for c in read.split(",")) == [
        "event_id", "event_type", "user_id", "value",
    ]
    assert text.count("Exchange") == 1 and "partial_avg" in text
    assert "stage" not in text and "current_timestamp" not in text


@pytest.mark.parametrize("name", ["groupby_agg", "std_var_nunique", "sum_int", "distinct"])
def test_rows_combine_before_the_shuffle(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    below = text[text.rindex("Exchange") :]
    assert "HashAggregate" in below and "SortAggregate" not in text


def test_small_side_is_broadcast_by_catalyst(spark):
    assert "BroadcastHashJoin" in plan(catalog.join_left(spark, FOLDER))


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_split_outer_joins_push_filters_and_read_little(spark, how):
    large = tf.SkewPolicy(small_bytes=0, hot_rows=500, broadcast=False)
    orders = tf.rename(catalog.table(spark, FOLDER, "orders"), {"o_custkey": "c_custkey"})
    customers = catalog.table(spark, FOLDER, "customer")
    out = tf.join(orders, customers, "c_custkey", how, skew=large)
    some = out.where("o_orderstatus = 'F' AND c_acctbal > 0").select("o_orderkey", "c_name")
    text = plan(some)
    assert "EqualTo(o_orderstatus,F)" in text and "GreaterThan(c_acctbal,0.0)" in text
    assert "o_totalprice" not in text and "c_mktsegment" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # As it runs, without hot keys: each side once, and again for null keys of a full join.
    reads = final_plan(out).count("FileScan")
    assert reads <= (4 if how == "full" else 2)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_large_joins_read_each_side_once_and_push_filters(spark, how):
    large = tf.SkewPolicy(small_bytes=0, hot_rows=500, broadcast=False)
    orders = tf.rename(catalog.table(spark, FOLDER, "orders"), {"o_custkey": "c_custkey"})
    out = tf.join(orders, catalog.table(spark, FOLDER, "customer"), "c_custkey", how, skew=large)
    text = plan(out.where("o_orderstatus = 'F'").select("o_orderkey"))
    assert text.count("FileScan") == 2 and "EqualTo(o_orderstatus,F)" in text


def test_order_by_lets_filters_through(spark):
    out = tf.order_by(catalog.table(spark, FOLDER, "orders"), "o_totalprice")
    assert "EqualTo(o_orderstatus,F)" in plan(out.where("o_orderstatus = 'F'"))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_no_python_no_cross_joins(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert word not in text
    if "split" in name or "salted" in name:
        return  # these add up group sizes and collect range boundaries, one row each
    # A window without partitions would pull the table into one task.
    assert "Exchange SinglePartition" not in text


READS_AND_WRITES = ("round_trip", "csv_", "parquet_append", "job_")


@pytest.mark.parametrize(
    "name", [n for n in catalog.QUERIES if not any(w in n for w in READS_AND_WRITES)]
)
def test_operators_start_no_job(spark, name):
    sc = spark.sparkContext
    names = {t for t in ("orders", "customer", "events", "lineitem", "supplier")}
    tables = {t: catalog.table(spark, FOLDER, t) for t in names}
    known, catalog.table = catalog.table, lambda s, f, t: tables[t]
    sc.setJobGroup(f"lazy-{name}", "no jobs expected")
    try:
        catalog.QUERIES[name](spark, FOLDER)
    finally:
        catalog.table = known
        jobs = sc.statusTracker().getJobIdsForGroup(f"lazy-{name}")
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []


def test_hot_groups_are_found_and_bounded(spark):
    from pyspark.sql import functions as F

    from tabflow.functions.skew import hot_groups

    df = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k")
    policy = tf.SkewPolicy(hot_rows=10, max_hot=64)
    (hot,) = hot_groups(df, F.col("k"), policy).collect()
    assert (hot["__g"], hot["__rows"], hot["__unit"]) == (0, 334, 16)
    assert hot_groups(df, F.col("k"), tf.SkewPolicy(hot_rows=334)).count() == 0
    even = spark.range(1000).selectExpr("id % 64 AS k")
    assert hot_groups(even, F.col("k"), tf.SkewPolicy(hot_rows=1, max_hot=64)).count() < 64


def test_hot_groups_shuffle_no_distinct_keys(spark):
    from pyspark.sql import functions as F

    from tabflow.functions.skew import hot_groups
    from test_windows import shuffled_rows

    df = spark.range(0, 300_000, 1, 8).selectExpr("CASE WHEN id % 4 = 0 THEN -1 WHEN id % 50 = 1 THEN NULL ELSE id END AS k")
    found = hot_groups(df, F.struct("k"), tf.SkewPolicy(hot_rows=1000, max_hot=64))
    assert sorted(((r["__g"].k, r["__rows"], r["__unit"]) for r in found.collect()), key=str) == [
        (-1, 75000, 4688), (None, 6000, 4688),
    ]
    assert shuffled_rows(spark, found) < 2000
    # Counts about the mark: what is hot is told exactly, whatever the sketch has missed.
    counts = [(k, n) for k, n in enumerate([99, 100, 101, 102, 2500])] + [(k, 1) for k in range(10, 9000)]
    many = spark.createDataFrame(counts, "k int, n int").selectExpr("k", "explode(sequence(1, n))").repartition(9)
    hot = hot_groups(many, F.col("k"), tf.SkewPolicy(hot_rows=100, max_hot=128)).collect()
    assert sorted((r["__g"], r["__rows"]) for r in hot) == [(2, 101), (3, 102), (4, 2500)]
    assert hot_groups(many.limit(0), F.col("k"), tf.SkewPolicy()).count() == 0


def test_hot_partitions_are_cut_evenly(spark):
    from pyspark.sql import functions as F

    from tabflow.functions.skew import with_range_bucket

    df = spark.range(20000).selectExpr("struct(1 AS k) AS __g", "id * id AS v", "100L AS __unit")
    cut = with_range_bucket(df, [F.col("v")], tf.SkewPolicy())
    sizes = [r["count"] for r in cut.groupBy("__bucket").count().collect()]
    assert sum(sizes) == 20000 and 120 < len(sizes) < 300 and max(sizes) < 1200
    ends = cut.groupBy("__bucket").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    ends = sorted((r["__bucket"], r.a, r.b) for r in ends.collect())
    assert all(x[2] < y[1] for x, y in zip(ends, ends[1:]))


def final_plan(df):
    df.collect()
    text = plan(df)
    return text[: text.index("Initial Plan")]


def test_without_hot_groups_only_the_plain_operator_runs(spark):
    even = tf.SkewPolicy(small_bytes=0, hot_rows=10**9, broadcast=False)
    events = catalog.table(spark, FOLDER, "events")
    text = final_plan(
        tf.window(events, "user_id", ["ts", "event_id"], func="sum", col="value", skew=even)
    )
    assert text.count("Window [") == 1 and text.count("Exchange hashpartitioning") == 1
    text = final_plan(tf.groupby_agg(events, "user_id", {"value": "median"}, skew=even))
    assert "__bounds" not in text and "__start" in text
    customers = catalog.customer_names(spark, FOLDER)
    text = final_plan(
        tf.join(customers, catalog.big_orders(spark, FOLDER), "c_custkey", skew=even)
    )
    assert text.count("Join") == 1


def test_size_check_chooses_the_operator(spark):
    events = catalog.table(spark, FOLDER, "events")
    call = {"func": "sum", "col": "value"}
    small = tf.window(events, "user_id", ["ts", "event_id"], **call)
    assert "__g" not in plan(small)
    tight = tf.SkewPolicy(small_bytes=1000)
    assert "__g" in plan(tf.window(events, "user_id", ["ts", "event_id"], **call, skew=tight))
    unsized = spark.createDataFrame(events.limit(5).rdd, events.schema)
    assert "__g" in plan(tf.window(unsized, "user_id", ["ts", "event_id"], **call))
