import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import Window, functions as F

import tabflow as tf
from tabflow.operators import windows

from conftest import rows

FUNCS = {
    "sum": sum,
    "mean": lambda v: sum(v) / len(v),
    "min": min,
    "max": max,
}


def brute(data, func, low, high):
    out = []
    for key in {k for k, *_ in data}:
        part = sorted((t, v) for k, t, v in data if k == key)
        for i, (t, v) in enumerate(part):
            frame = [x for _, x in part[max(i + low, 0) : max(i + high + 1, 0)] if x is not None]
            value = len(frame) if func == "count" else FUNCS[func](frame) if frame else None
            out.append((key, t, v, value))
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.integers(0, 2**32),
    st.integers(1, 300),
    st.sampled_from(["sum", "mean", "avg", "count", "min", "max"]),
    st.integers(-9, 6),
    st.integers(0, 12),
)
def test_split_frames_by_brute_force(spark, seed, size, func, low, width):
    rng = random.Random(seed)
    data = [
        (rng.choice(["hot", "hot", None, "a", "b"]), t, rng.choice([None, *range(50)]))
        for t in rng.sample(range(10 * size), size)
    ]
    df = spark.createDataFrame(data, "k string, t int, v bigint").repartition(4)
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=rng.choice([1, 4, 30]), max_hot=64)
    out = tf.window(
        df, "k", "t", func=func, col="v", alias="w", rows=(low, low + width), skew=policy
    )
    expected = brute(data, "mean" if func == "avg" else func, low, low + width)
    got = sorted(map(tuple, out.collect()), key=lambda r: r[1])
    expected = sorted(expected, key=lambda r: r[1])
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g == pytest.approx(e)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.integers(0, 2**32),
    st.integers(1, 300),
    st.sampled_from(["sum", "mean", "count", "min", "max"]),
    st.sampled_from([0, 0, 1, -1, 7, -7, 40, -40, 1000, -1000, None]),
    st.booleans(),
)
def test_split_open_frames_by_brute_force(spark, seed, size, func, end, flip):
    rng = random.Random(seed)
    data = [
        (rng.choice(["hot", "hot", None, "a", "b"]), t, rng.choice([None, *range(50)]))
        for t in rng.sample(range(10 * size), size)
    ]
    df = spark.createDataFrame(data, "k string, t int, v bigint").repartition(4)
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=rng.choice([1, 4, 30]), max_hot=64)
    low, high = Window.unboundedPreceding, Window.unboundedFollowing
    if end is not None:
        low, high = (end, high) if flip else (low, end)
    out = tf.window(df, "k", "t", func=func, col="v", alias="w", rows=(low, high), skew=policy)
    expected = sorted(brute(data, func, max(low, -5000), min(high, 5000)), key=lambda r: r[1])
    got = sorted(map(tuple, out.collect()), key=lambda r: r[1])
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g == pytest.approx(e)


def test_open_frames_have_the_plain_type(spark):
    df = spark.range(200).selectExpr("id % 2 AS k", "id AS t", "CAST(id AS DECIMAL(9,2)) AS d", "CAST(id AS FLOAT) AS f")
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=20)
    for col in ("d", "f", "t"):
        for func in ("sum", "mean", "max", "count"):
            call = {"func": func, "col": col, "alias": "w", "rows": (Window.unboundedPreceding, -3)}
            small, large = tf.window(df, "k", "t", **call), tf.window(df, "k", "t", **call, skew=policy)
            assert small.schema["w"].dataType == large.schema["w"].dataType
            assert rows(small.select("t", "w")) == rows(large.select("t", "w"))


def test_default_frame_and_name(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(4)], "k int, t int, v double")
    out = tf.window(df, ["k"], ["t"], func="mean", col="v")
    assert out.columns == ["k", "t", "v", "mean_v"]
    assert [r[3] for r in rows(out)] == [0.5, 1.0, 2.0, 2.5]


def test_ties_keep_every_row(spark):
    df = spark.createDataFrame([(1, 0, 2)] * 500, "k int, t int, v int").repartition(4)
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=10)
    out = tf.window(df, "k", "t", func="sum", col="v", alias="w", rows=(0, 1), skew=policy)
    assert rows(out) == [(1, 0, 2, 2)] + [(1, 0, 2, 4)] * 499


def test_refusals(scores):
    with pytest.raises(ValueError, match="order_by"):
        tf.window(scores, "Category", [], func="sum", col="n")
    with pytest.raises(ValueError, match="median"):
        tf.window(scores, "Category", "n", func="median", col="n")
    with pytest.raises(ValueError, match="Empty frame"):
        tf.window(scores, "Category", "n", func="sum", col="n", rows=(1, 0))
    with pytest.raises(ValueError, match="two columns"):
        tf.window(scores, "Category", "n", func="sum", col="n", alias="S")


def test_split_frames_with_odd_names(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(20)], "`a.b` int, `t t` int, v double")
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=3)
    out = tf.window(df, "a.b", ["t t"], func="max", col="v", rows=(0, 2), skew=policy)
    assert out.columns == ["a.b", "t t", "v", "max_v"]
    assert [r[3] for r in rows(out)] == [min(i + 2.0, 19.0) for i in range(20)]


def test_map_columns_wide_frames_and_reserved_names(spark):
    df = spark.range(300).selectExpr("id % 2 AS k", "id AS t", "map('a', id) AS m", "id AS v")
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=20)
    for frame in ((-500, 500), (-120, -70), (Window.unboundedPreceding, 0)):
        call = {"func": "count", "col": "m", "alias": "w", "rows": frame}
        small = tf.window(df, "k", "t", **call).select("t", "w")
        assert rows(tf.window(df, "k", "t", **call, skew=policy).select("t", "w")) == rows(small)
    with pytest.raises(ValueError, match="__v"):
        tf.window(df.withColumnRenamed("v", "__v"), "k", "t", func="sum", col="__v")


def test_ties_that_differ_are_cut_apart(spark):
    df = spark.range(2000).selectExpr("1 AS k", "1 AS t", "id AS v")
    out = tf.window(df, "k", "t", func="count", col="v", alias="w", skew=tf.SkewPolicy(small_bytes=0, hot_rows=50))
    assert out.groupBy("w").count().count() == 2  # all rows but the two at the ends see three


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.integers(0, 2**32),
    st.integers(1, 300),
    st.sampled_from(["sum", "mean", "count", "min", "max"]),
    st.integers(-40, 30),
    st.sampled_from([2, 3, 7, 20, 64, 400]),
    st.booleans(),
)
def test_frames_of_blocks_by_brute_force(spark, seed, size, func, low, width, small):
    """Long frames, which are put together from blocks, in small and in split inputs."""
    rng = random.Random(seed)
    data = [
        (rng.choice(["hot", "hot", None, "a", "b"]), t, rng.choice([None, *range(50)]))
        for t in rng.sample(range(10 * size), size)
    ]
    df = spark.createDataFrame(data, "k string, t int, v bigint").repartition(4)
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=rng.choice([1, 4, 30, 10**6]), max_hot=64)
    if small:
        df, policy = df.limit(size), tf.SkewPolicy()
    before, windows.WIDE = windows.WIDE, 1
    try:
        out = tf.window(
            df, "k", "t", func=func, col="v", alias="w", rows=(low, low + width - 1), skew=policy
        )
        got = sorted(map(tuple, out.collect()), key=lambda r: r[1])
    finally:
        windows.WIDE = before
    expected = sorted(brute(data, func, low, low + width - 1), key=lambda r: r[1])
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g == pytest.approx(e)


def test_long_frames_have_the_plain_type_and_special_values(spark):
    df = spark.range(400).selectExpr(
        "id % 2 AS k", "id AS t", "CAST(id AS DECIMAL(9,2)) AS d", "CAST(id AS FLOAT) AS f",
        "CASE WHEN id % 50 = 7 THEN double('NaN') WHEN id % 90 = 1 THEN double('-inf') ELSE id END AS n",
        "CAST(id AS DECIMAL(30,2)) AS wide",
    )
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=50)
    for col in ("d", "f", "t", "n", "wide"):
        for func in ("sum", "mean", "max", "min", "count"):
            if col == "n" and func in ("sum", "mean"):
                continue  # infinite and missing numbers stay so, which is the same for all frames
            call = {"func": func, "col": col, "alias": "w", "rows": (-90, -3)}
            before, windows.WIDE = windows.WIDE, 10**6
            plain = tf.window(df.limit(400), "k", "t", **call)
            windows.WIDE = before
            for out in (tf.window(df.limit(400), "k", "t", **call), tf.window(df, "k", "t", **call, skew=policy)):
                assert out.schema["w"].dataType == plain.schema["w"].dataType
                assert str(rows(out.select("t", "w"))) == str(rows(plain.select("t", "w")))


def shuffled_rows(spark, df):
    """Rows that the shuffles of a plan wrote."""
    df.write.format("noop").mode("overwrite").save()
    seen, todo, total = set(), [df._jdf.queryExecution().executedPlan()], 0
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if name == "Exchange" and node.id() not in seen:
            seen.add(node.id())
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_long_frames_shuffle_each_row_a_few_times(spark):
    df = spark.range(0, 60_000, 1, 4).selectExpr("id % 1 AS k", "id * 7919 % 60000 AS t", "id AS v")
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=2000)
    out = tf.window(df, "k", "t", func="max", col="v", alias="w", rows=(-3000, 1999), skew=policy)
    assert shuffled_rows(spark, out) < 3 * 60_000


def steps(df, kind):
    """How many steps of one kind the plan that ran has, those of subqueries left out."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        total += name == kind
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("partition", ["k", None])
def test_long_frames_sort_each_row_a_few_times(spark, partition):
    """Beside placing the rows, a long frame takes two sorts, three windows and one shuffle."""
    df = spark.range(0, 60_000, 1, 4).selectExpr("id % 1 AS k", "id * 7919 % 60000 AS t", "id AS v")
    call = {"func": "max", "col": "v", "alias": "w", "skew": tf.SkewPolicy(small_bytes=0, hot_rows=2000)}
    short = tf.window(df, partition, "t", rows=(-2, 1), **call)
    out = tf.window(df, partition, "t", rows=(-3000, 1999), **call)
    # A short frame takes one of each. Rows with "k" may also go through the plain plan, which has
    # one more window and sort for a long frame's positions.
    plain = {"k": {"Sort": 2, "Window": 3, "Exchange": 0}, None: {"Sort": 0, "Window": 0, "Exchange": 0}}[partition]
    for kind, more in (("Sort", 1), ("Window", 2), ("Exchange", 0)):
        assert steps(out, kind) - steps(short, kind) <= more + plain[kind]
    assert shuffled_rows(spark, out) < 3 * 60_000
    got = {r["t"]: r["w"] for r in out.select("t", "w").collect()}
    at = {i * 7919 % 60000: i for i in range(60_000)}
    for t in (0, 1, 1998, 30_000, 59_000, 59_999):
        assert got[t] == max(at[x] for x in range(max(t - 3000, 0), min(t + 2000, 60_000)))


def test_exploded_rows_are_counted(spark, tmp_path):
    """A million rows of one partition that Catalyst takes for a few."""
    spark.range(1000).selectExpr("1 AS k", "id AS t").write.parquet(f"{tmp_path}/t")
    many = spark.read.parquet(f"{tmp_path}/t").selectExpr("k", "t", "explode(sequence(0, 999)) AS s")
    out = tf.window(many, "k", ["t", "s"], func="count", col="s", alias="w")
    out.write.format("noop").mode("overwrite").save()
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in text
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    sizes = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    spark.conf.unset(setting)
    assert sum(x["count"] for x in sizes) == 1_000_000 and max(x["count"] for x in sizes) <= 750_000
    assert out.where("w <> 3").count() == 2
    median = tf.groupby_agg(many, "k", {"s": "median"})
    assert rows(median) == [(1, 499.5)]
    plain = spark.read.parquet(f"{tmp_path}/t")
    assert "__bucket" not in tf.window(plain, "k", "t", func="count", col="t", alias="w")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind, split", [("30,2", True), ("38,2", True), ("36,6", None), ("38,12", False)])
def test_decimals_of_38_digits(spark, kind, split):
    """Same type and value as plain; in frames without an end split as far as sums are exact."""
    digits, scale = map(int, kind.split(","))
    big = "9" * (digits - scale - 8) + "." + "1" * scale
    df = spark.range(300).selectExpr(
        "id % 2 AS k", "id AS t",
        f"CAST(CASE WHEN id % 7 = 0 THEN {big}BD WHEN id % 7 = 1 THEN -{big}BD ELSE id / 3 END AS DECIMAL({kind})) AS d",
    )
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=20)
    for func in ("sum", "mean"):
        for frame in ((Window.unboundedPreceding, -3), (-100, 5)):
            call = {"func": func, "col": "d", "alias": "w", "rows": frame}
            before, windows.WIDE = windows.WIDE, 10**6
            plain = tf.window(df.limit(300), "k", "t", **call)
            windows.WIDE = before
            out = tf.window(df, "k", "t", **call, skew=policy)
            assert out.schema["w"].dataType == plain.schema["w"].dataType
            assert rows(out.select("t", "w")) == rows(plain.select("t", "w"))
            if frame[0] != -100:
                cut = "__bucket" in out._jdf.queryExecution().optimizedPlan().toString()
                assert cut == (func == "sum" if split is None else split)


def leaves(df):
    """How often a plan reads its inputs."""
    todo, total = [df._jdf.queryExecution().analyzed()], 0
    while todo:
        children = todo.pop().children()
        total += children.isEmpty()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize(
    "partition, frame",
    [("k", (-3, 0)), ("k", (-90, 3)), ("k", (Window.unboundedPreceding, -3)), (None, (-90, 3))],
)
def test_windows_over_one_frame_read_their_input_once(spark, partition, frame):
    """Several windows one after the other take a plan as large as one, with the same results."""
    data = [(i % 7 % 2, i * 37 % 300, None if i % 11 == 0 else i) for i in range(300)]
    df = spark.createDataFrame(data, "k int, t int, v bigint").repartition(4)
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=40)
    call = {"rows": frame, "skew": policy, "col": "v"}
    funcs = ("sum", "max", "count", "mean", "min")
    one = tf.window(df, partition, "t", func="sum", **call)
    out = df
    for func in funcs:
        out = tf.window(out, partition, "t", func=func, **call)
    assert out.columns == ["k", "t", "v", *(f"{f}_v" for f in funcs)]
    assert leaves(out) <= leaves(one) + 2
    got = sorted(map(tuple, out.collect()), key=lambda r: r[1])
    data = [(k if partition else 0, t, v) for k, t, v in data]
    low, high = max(frame[0], -5000), min(frame[1], 5000)
    for i, func in enumerate(funcs):
        expected = sorted(brute(data, func, low, high), key=lambda r: r[1])
        assert [r[3 + i] for r in got] == pytest.approx([r[3] for r in expected])


@pytest.mark.parametrize("partition", ["k", None])
def test_long_windows_in_a_row_are_placed_once(spark, partition, monkeypatch):
    """The plan that places the rows is made by the first window and shared, also by a join of two results."""
    made = []
    placed = windows._placed
    monkeypatch.setattr(windows, "_placed", lambda *a: made.append(a) or placed(*a))
    df = spark.range(300).selectExpr("id % 2 AS k", "id AS t", "id AS v")
    call = {"rows": (-90, 3), "skew": tf.SkewPolicy(small_bytes=0, hot_rows=40), "col": "v"}
    one = tf.window(df, partition, "t", func="sum", **call)
    two = tf.window(one, partition, "t", func="max", **call)
    two = tf.window(two, partition, "t", func="count", **call)
    assert len(made) == 1
    both = one.withColumnRenamed("sum_v", "s").join(two, ["k", "t", "v"])
    assert both.count() == 300 and both.where("s <> sum_v").count() == 0


def test_windows_over_results_and_of_mixed_exactness(spark):
    """A window over another's result, and sums that can't be split beside others."""
    df = spark.range(60).selectExpr("id % 2 AS k", "id AS t", "id AS v", "CAST(id / 7 AS DECIMAL(38,12)) AS d")
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=10)
    call = {"rows": (Window.unboundedPreceding, 0), "skew": policy}
    out = tf.window(df, "k", "t", func="sum", col="d", alias="a", **call)
    out = tf.window(out, "k", "t", func="count", col="v", alias="b", **call)
    out = tf.window(out, "k", "t", func="sum", col="B", alias="c", **call)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("*", F.sum("d").over(w).alias("a"), F.count("v").over(w).alias("b"))
    plain = plain.withColumn("c", F.sum("b").over(w))
    assert out.schema == plain.schema and rows(out) == rows(plain)
