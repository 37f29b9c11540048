import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

import tabflow as tf
from conftest import rows

SPLIT = tf.SkewPolicy(small_bytes=0, hot_rows=3)


def test_worked_example(spark):
    sales = spark.createDataFrame(
        [("NL", "A", 1.0, 1), ("NL", "A", 3.0, 2), ("BE", "B", 5.0, None)],
        "country string, city string, amount double, id bigint",
    )
    df = tf.groupby_agg(sales, ["country", "city"], {"amount": ["sum", "mean"], "id": "count"})
    assert df.columns == ["country", "city", "sum_amount", "mean_amount", "count_id"]
    assert rows(df) == [("BE", "B", 5.0, 5.0, 0), ("NL", "A", 4.0, 2.0, 2)]


def test_missing_values(scores):
    df = tf.groupby_agg(scores, "Category", {"Score": ["sum", "mean", "count", "median"]})
    assert rows(df) == [
        (None, 30.0, 30.0, 1, 30.0),
        ("a", 31.0, 15.5, 2, 15.5),
        ("b", None, None, 0, None),
    ]


def test_drop_null_keys(scores):
    df = tf.groupby_agg(scores, "Category", {"Score": "max"}, dropna=True)
    assert rows(df) == [("a", 20.0), ("b", None)]


def test_empty_sum_as_zero(scores):
    df = tf.groupby_agg(scores, "Category", {"Score": "sum", "n": "sum"}, min_count0=True)
    assert rows(df) == [(None, 30.0, 0), ("a", 31.0, 3), ("b", 0.0, 4)]


def test_single_functions_get_flat_names_too(scores):
    assert tf.groupby_agg(scores, "Category", {"Score": "sum"}).columns == ["Category", "sum_Score"]


def test_aliased_items(scores):
    aggs = [
        {"func": "sum", "col": "Score", "alias": "total"},
        {"func": "size", "col": "*", "alias": "rows"},
        {"func": "nunique", "col": "s"},
        F.max("n").alias("top"),
    ]
    df = tf.groupby_agg(scores, ["Category"], aggs)
    assert df.columns == ["Category", "total", "rows", "nunique_s", "top"]
    assert rows(df)[1] == ("a", 31.0, 2, 2, 2)


@pytest.mark.parametrize("keys, aggs", [([], {"n": "sum"}), (None, {"n": "sum"}), ("n", {}), ("n", None)])
def test_nothing_to_group_is_identity(scores, keys, aggs):
    assert tf.groupby_agg(scores, keys, aggs) is scores


def test_reduce_without_keys_is_identity(scores):
    assert tf.groupby_reduce(scores, [], "mean") is scores


def test_reduce_keeps_names_and_numeric_columns(scores):
    df = tf.groupby_reduce(scores, "Category", "mean")
    assert df.columns == ["Category", "Score", "n"]
    assert rows(df) == [(None, 30.0, None), ("a", 15.5, 1.5), ("b", None, 4.0)]
    assert tf.groupby_reduce(scores, ["Category", "Score", "n"], "sum").columns == [
        "Category", "Score", "n",
    ]


def test_first_and_last_skip_nulls(spark):
    df = spark.createDataFrame(
        [("a", None, 1), ("a", "x", 2), ("a", "y", 3), ("a", None, 4), ("b", None, 5)],
        "k string, v string, t int",
    )
    out = tf.groupby_agg(df, "k", {"v": ["first", "last"]}, order_col="t")
    assert rows(out) == [("a", "x", "y"), ("b", None, None)]
    own = tf.groupby_agg(df, "k", [{"func": "last", "col": "v", "order_col": "t", "alias": "v"}])
    assert rows(own) == [("a", "y"), ("b", None)]


def test_spread_of_one_value_is_missing(scores):
    df = tf.groupby_agg(scores, "Category", {"Score": ["std", "var"]})
    assert rows(df)[0] == (None, None, None)


@pytest.mark.parametrize(
    "aggs, error, text",
    [
        ({"n": "mode"}, ValueError, "mode"),
        ([{"func": "sum"}], ValueError, "func and col"),
        ({"s": "first"}, ValueError, "order_col"),
        ({"s": "median"}, TypeError, "numeric"),
        ([{"func": "sum", "col": "n", "alias": "x"}, {"func": "max", "col": "n", "alias": "X"}],
         ValueError, "two columns"),
        ([{"func": "sum", "col": "n", "alias": "Category"}], ValueError, "two columns"),
    ],
)
def test_refusals(scores, aggs, error, text):
    with pytest.raises(error, match=text):
        tf.groupby_agg(scores, "Category", aggs)


def test_reduce_refuses_other_functions(scores):
    with pytest.raises(ValueError, match="std"):
        tf.groupby_reduce(scores, "Category", "std")


@pytest.mark.parametrize("policy", [SPLIT, tf.SkewPolicy()])
def test_empty_table(scores, policy):
    df = tf.groupby_agg(scores.where("false"), "Category", {"Score": ["median", "sum"]}, skew=policy)
    assert df.columns == ["Category", "median_Score", "sum_Score"] and df.count() == 0


def test_split_median_of_special_values(spark):
    data = [(1, v) for v in [None, -0.0, 0.0, float("inf"), float("-inf"), 1e-300, 5.0, 5.0, 5.0, None]]
    data += [(2, None), (None, 3.0), (None, 4.0), (3, float("nan")), (3, 1.0), (3, 2.0)]
    df = spark.createDataFrame(data, "k int, v double")
    out = tf.groupby_agg(df, "k", {"v": "median"}, skew=SPLIT)
    plain = df.groupBy("k").agg(F.median("v").alias("m"))
    assert rows(out) == rows(plain)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(1, 60))
def test_split_median_by_brute_force(spark, seed, size, values):
    rng = random.Random(seed)
    data = [
        (rng.choice(["hot", "hot", None, *"abc"]), rng.choice([None, *range(-values, values)]), rng.random())
        for _ in range(size)
    ]
    df = spark.createDataFrame(data, "k string, v bigint, w double").repartition(5)
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=rng.choice([1, 5, 50]), max_hot=64)
    out = tf.groupby_agg(df, "k", {"v": ["median", "count"], "w": "median"}, skew=policy)

    def middle(values):
        return statistics.median(values) if values else None

    expected = []
    for key in {k for k, *_ in data}:
        vs = [v for k, v, _ in data if k == key and v is not None]
        ws = [w for k, _, w in data if k == key]
        expected.append((key, middle(vs), len(vs), middle(ws)))
    got = {r[0]: tuple(r) for r in out.collect()}
    assert got.keys() == {e[0] for e in expected}
    for row in expected:
        assert got[row[0]] == pytest.approx(row, abs=1e-12)


def test_split_median_with_odd_names(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 4.0), (None, 3.0)], "`a.b` int, `Total Amount` double")
    out = tf.groupby_agg(df, ["a.b"], {"Total Amount": ["median", "max"]}, skew=SPLIT)
    assert out.columns == ["a.b", "median_Total Amount", "max_Total Amount"]
    assert rows(out) == [(None, 3.0, 3.0), (1, 2.5, 4.0)]


def test_medians_of_integers_and_decimals_are_doubles(spark):
    df = spark.sql("SELECT 1 AS k, 2 AS i, 1.5BD AS d UNION ALL SELECT 1, 3, 2.0BD")
    for policy in (SPLIT, tf.SkewPolicy(small_bytes=1 << 60)):
        out = tf.groupby_agg(df, "k", {"i": "median", "d": "median"}, skew=policy)
        assert rows(out) == [(1, 2.5, 1.75)]
        assert [f.dataType.simpleString() for f in out.schema.fields[1:]] == ["double", "double"]


def test_ties_of_an_order_give_one_result(spark):
    data = [("a", k % 7, f"v{k:03}", {"m": k}) for k in range(200)] + [("a", 0, None, None), ("a", None, "no", {"m": 0})]
    df = spark.createDataFrame(data, "k string, t int, v string, m map<string,int>")
    seen = set()
    for n in (1, 3, 8):
        for key in ("v", "t"):
            some = df.repartition(n, key).sortWithinPartitions(F.rand(n))
            out = tf.groupby_agg(some, "k", {"v": ["first", "last"], "m": ["first", "last"]}, order_col="t")
            (row,) = out.collect()
            seen.add((row.first_v, row.last_v, str(row.first_m), str(row.last_m)))
    assert len(seen) == 1 and next(iter(seen))[:2] == ("v000", "v195")


def scans(df):
    """How often a plan reads its files, as it ran."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[: text.index("Initial Plan")].count("FileScan")


@pytest.mark.parametrize("hot_rows", [100, 10**9])
def test_medians_read_the_input_once_and_other_aggregates_once_more(spark, tmp_path, hot_rows):
    spark.range(5000).selectExpr("id % 3 AS k", "id * 7 % 4999 AS v", "id AS w").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=hot_rows)
    out = tf.groupby_agg(df, "k", {"v": ["median", "sum"], "w": "median"}, skew=policy)
    plain = df.groupBy("k").agg(F.median("v").alias("a"), F.sum("v").alias("b"), F.median("w").alias("c"))
    assert rows(out) == rows(plain)
    assert scans(tf.groupby_agg(df, "k", {"v": ["median", "sum"], "w": "median"}, skew=policy)) <= 2


def test_medians_given_as_columns_are_split_or_refused(spark):
    df = spark.range(900).selectExpr("id % 2 AS k", "id AS v", "id * 2 AS `w w`")
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=50)
    out = tf.groupby_agg(df, "k", [F.median("v").alias("m"), F.median(F.col("`w w`")), F.max("v").alias("x")], skew=policy)
    assert out.columns == ["k", "m", "median(w w)", "x"]
    assert "__bucket" in out._jdf.queryExecution().optimizedPlan().toString()
    assert rows(out) == rows(df.groupBy("k").agg(F.median("v"), F.median("`w w`"), F.max("v")))
    for other in (F.median(F.col("v") + 1), F.percentile("v", 0.9).alias("p"), F.max("v") - F.median("v")):
        with pytest.raises(ValueError, match="median"):
            tf.groupby_agg(df, "k", [other], skew=policy)
        assert tf.groupby_agg(df.limit(10), "k", [other]).count() == 2
