import pytest

import tabflow as tf
from catalog import SAMPLE_OPS

from conftest import DATA, rows


@pytest.fixture
def events(spark):
    df = tf.read_table(spark, str(DATA / "sf0.001" / "events.parquet"), "parquet")
    return tf.rename(df, {"value": "Score", "event_type": "Category"})


def test_sample_ops_equal_the_calls(events):
    df = tf.add_column(events, "stage", "raw")
    df = tf.add_column(df, "Time", "")
    df = tf.groupby_reduce(tf.filter_rows(df, "Score > 10"), "Category", "mean")
    assert sorted(tf.apply_ops(events, SAMPLE_OPS).collect()) == sorted(df.collect())


def test_every_op(spark, scores):
    other = spark.createDataFrame([("a", "A")], "Category string, label string")
    df = tf.apply_ops(
        scores,
        [
            {"op": "withColumnExpr", "name": "twice", "expr": "Score * 2"},
            {"op": "withLiteral", "name": "gone", "value": None, "dtype": "int"},
            {"op": "where", "name": "tier", "cond": "Score > 15", "a": "hi", "b": "lo"},
            {"op": "updateWhere", "mask": "n = 4", "name": "s", "value": "four"},
            {"op": "nanToNull"},
            {"op": "fillna", "value": 0, "subset": ["twice"]},
            {"op": "filter", "expr": "n IS NOT NULL"},
            {"op": "join", "target_alias": "names", "on": ["Category"], "how": "left"},
            {"op": "window", "partitionBy": ["Category"], "orderBy": ["n"],
             "frame": "rowsBetween(-1, 1)", "func": "sum", "col": "n", "alias": "near"},
            {"op": "drop", "columns": ["gone", "Score"]},
            {"op": "rename", "mapping": {"twice": "double"}},
            {"op": "orderBy", "cols": ["n"]},
            {"op": "limit", "n": 3},
            {"op": "select", "columns": ["n", "double", "tier", "s", "label", "near"]},
            {"op": "distinct"},
        ],
        {"names": other},
    )
    assert rows(df) == [
        (1, 22.0, "lo", "x", "A", 3),
        (2, 40.0, "hi", "y", "A", 3),
        (4, 0.0, "lo", "four", None, 4),
    ]


def test_union_ops(scores):
    again = scores.select(*reversed(scores.columns))
    df = tf.apply_ops(
        scores,
        [
            {"op": "union", "target_alias": "same"},
            {"op": "unionByName", "target_alias": "turned"},
            {"op": "groupByAgg", "group_cols": ["Category"], "aggs": {"n": ["count", "sum"]},
             "dropna": True},
        ],
        {"same": scores, "turned": again},
    )
    assert rows(df) == [("a", 6, 9), ("b", 3, 12)]


def test_order_of_ops_is_list_order(scores):
    double, keep = {"op": "withColumnExpr", "name": "n", "expr": "n * 2"}, {"op": "filter", "expr": "n > 2"}
    assert tf.apply_ops(scores, [double, keep]).count() == 2
    assert tf.apply_ops(scores, [keep, double]).count() == 1


@pytest.mark.parametrize(
    "ops, text",
    [
        ([{"op": "pivot"}], "Operation 1: unknown op 'pivot'"),
        ([{"op": "limit", "n": 1}, {"name": "x"}], "Operation 2: unknown op None"),
        ([{"op": "limit"}], r"Operation 1 \(limit\)"),
        ([{"op": "limit", "n": 1, "m": 2}], r"Operation 1 \(limit\)"),
        ([{"op": "union", "target_alias": "x"}], "Unknown table 'x'"),
        ([{"op": "window", "partitionBy": [], "orderBy": ["n"], "func": "sum", "col": "n",
           "frame": "rangeBetween(0, 1)"}], "Unknown frame"),
    ],
)
def test_refusals(scores, ops, text):
    with pytest.raises(ValueError, match=text):
        tf.apply_ops(scores, ops)


def test_required_columns(scores):
    assert tf.require_columns(scores, ["n", "s"]) is scores
    with pytest.raises(ValueError, match="absent"):
        tf.require_columns(scores, ["n", "absent"])


def test_sample_job(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("Category,Score,Note\na,5,x\na,20,NA\na,30,y\nb,NA,z\n,40,w\nc,50,\n")
    spec = {
        "input": {"path": str(source), "format": "csv"},
        "output": {"path": None, "format": "csv", "mode": "overwrite"},
        "operations": SAMPLE_OPS,
        "required_columns": ["Category", "Score"],
    }
    path = tf.run_job(spark, spec)
    assert path == str(tmp_path / "in_enriched.csv")
    out = tf.read_table(spark, path, "csv", "Category string, Score double")
    assert rows(out) == [(None, 40.0), ("a", 25.0), ("c", 50.0)]
    assert tf.run_job(spark, spec) == path


def test_job_with_schema_and_tables(spark, tmp_path, scores):
    tf.write_table(scores, str(tmp_path / "scores"), "csv")
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "Category string, label string")
    tf.write_table(names, str(tmp_path / "names"), "parquet")
    path = tf.run_job(
        spark,
        {
            "input": {"path": str(tmp_path / "scores"), "schema": "Category string, Score double, s string, n int"},
            "tables": {"names": {"path": str(tmp_path / "names"), "format": "parquet"}},
            "operations": [
                {"op": "join", "target_alias": "names", "on": "Category", "how": "inner"},
                {"op": "select", "columns": ["label", "n"]},
            ],
            "output": {"path": str(tmp_path / "out"), "format": "json"},
        },
    )
    assert rows(tf.read_table(spark, path, "json", "label string, n int")) == [("A", 1), ("A", 2), ("B", 4)]


@pytest.mark.parametrize(
    "change, text",
    [
        ({"input": {}}, "Missing input/output path"),
        ({"input": None}, "Missing input/output path"),
        ({"steps": []}, "steps"),
        ({"required_columns": ["absent"]}, "absent"),
        ({"operations": [{"op": "melt"}]}, "melt"),
    ],
)
def test_job_refusals(spark, tmp_path, change, text):
    spec = {
        "input": {"path": str(DATA / "sf0.001" / "region.parquet"), "format": "parquet"},
        "output": {"path": str(tmp_path / "out"), "format": "parquet"},
        **change,
    }
    with pytest.raises(ValueError, match=text):
        tf.run_job(spark, spec)
    assert not (tmp_path / "out").exists()


def test_job_writes_random_inputs_once(spark, tmp_path, monkeypatch):
    """A random column is the same for all parts of a split window, and of a median."""
    import glob

    from pyspark.sql import Window, functions as F

    from tabflow.plans import operations, staging

    tight = tf.SkewPolicy(small_bytes=0, hot_rows=100)
    monkeypatch.setattr(staging, "DEFAULT_SKEW", tight)
    for name in ("window", "groupby_agg"):
        plain = getattr(operations, name)
        monkeypatch.setattr(operations, name, lambda *a, plain=plain, **k: plain(*a, **k, skew=tight))
    spark.range(0, 3000, 1, 6).selectExpr("id", "id % 2 AS k").write.parquet(f"{tmp_path}/in")
    kept = []
    known = staging.Staging.before
    monkeypatch.setattr(staging.Staging, "before", lambda self, op, df: kept.append((self, known(self, op, df))) or kept[-1][1])
    path = tf.run_job(
        spark,
        {
            "input": {"path": f"{tmp_path}/in", "format": "parquet"},
            "operations": [
                {"op": "withColumnExpr", "name": "r", "expr": "rand()"},
                {"op": "window", "partitionBy": ["k"], "orderBy": ["r"], "func": "max", "col": "r",
                 "alias": "next", "frame": "rowsBetween(0, 1)"},
                {"op": "window", "partitionBy": ["k"], "orderBy": ["r"], "func": "count", "col": "r",
                 "alias": "near", "frame": "rowsBetween(-100, 100)"},
            ],
            "output": {"path": f"{tmp_path}/out", "format": "parquet"},
        },
    )
    out = spark.read.parquet(path)
    order = Window.partitionBy("k").orderBy("r")
    again = out.withColumns({
        "next2": F.max("r").over(order.rowsBetween(0, 1)), "near2": F.count("r").over(order.rowsBetween(-100, 100)),
    })
    assert out.count() == 3000 and again.where("next <> next2 OR near <> near2").count() == 0
    # Both windows' inputs were written, the first for its random column; nothing is left.
    assert len(kept) == 3 and kept[0][0].tables == 2 and kept[0][0].folder is None
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert glob.glob(f"{base}/job-*") == []


def test_plain_jobs_are_not_staged(spark, events):
    from tabflow.plans.staging import Staging, reads_again, steps

    assert steps(events)[1] and not steps(events.selectExpr("rand() AS r"))[1]
    assert not steps(events.limit(3))[1] and steps(tf.limit(tf.order_by(events, "ts"), 3))[1]
    assert not steps(events.sample(0.5))[1]
    assert reads_again({"op": "groupByAgg", "aggs": {"x": ["sum", "median"]}})
    assert not reads_again({"op": "groupByAgg", "aggs": {"x": ["sum"]}}) and not reads_again({"op": "filter"})
    staging = Staging(spark)
    op = {"op": "window"}
    assert staging.before(op, events) is events and staging.folder is None
