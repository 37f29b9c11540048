import datetime
import glob

import pandas as pd
import pytest
from pyspark.sql import functions as F

import tabflow as tf

from conftest import DATA, rows

NA_CSV = """Category,Score,Note,d
a,5,x,2024-01-01
a,20,NA,2024-01-02
b,NA,,2024-01-03
,30,"q,r",2024-01-04
"""


@pytest.fixture
def na_csv(tmp_path):
    path = tmp_path / "na.csv"
    path.write_text(NA_CSV)
    return str(path)


def types(df):
    return [f.dataType.simpleString() for f in df.schema.fields]


def test_csv_with_schema(spark, na_csv):
    df = tf.read_table(spark, na_csv, "csv", "Category string, Score double, Note string, d date")
    assert types(df) == ["string", "double", "string", "date"]
    assert rows(df) == [
        (None, 30.0, "q,r", datetime.date(2024, 1, 4)),
        ("a", 5.0, "x", datetime.date(2024, 1, 1)),
        ("a", 20.0, None, datetime.date(2024, 1, 2)),
        ("b", None, None, datetime.date(2024, 1, 3)),
    ]


def test_csv_types_as_a_dataframe_reader_finds_them(spark, na_csv):
    df = tf.read_table(spark, na_csv)
    assert types(df) == ["string", "bigint", "string", "string"]
    assert [r.Score for r in df.orderBy("d").collect()] == [5, 20, None, 30]


def test_csv_inference_with_one_token(spark, na_csv):
    df = tf.read_table(spark, na_csv, na_tokens="NA")
    assert types(df) == ["string", "bigint", "string", "string"]
    assert [r.Score for r in df.orderBy("d").collect()] == [5, 20, None, 30]


def test_csv_inferred_kinds_match_pandas(spark, tmp_path):
    text = (
        "i,f,b,s,none,big,mixed,suffix,exp\n"
        "1,1.5,True,x,,9223372036854775808,1,1d,1e3\n"
        "-2,2,FALSE,2,NaN,1,x,2f,-.5\n"
        "+3,inf,true,N/A,null,2,,3d,2.\n"
    )
    path = tmp_path / "k.csv"
    path.write_text(text)
    df = tf.read_table(spark, str(path))
    assert types(df) == [
        "bigint", "double", "boolean", "string", "double", "double", "string", "string", "double",
    ]
    kinds = {"bigint": "iu", "double": "fu", "boolean": "b", "string": "O"}
    frame = pd.read_csv(path)
    for ours, name in zip(types(df), frame.columns):
        assert frame[name].dtype.kind in kinds[ours], name
    assert df.agg(F.sum("i"), F.sum("exp")).first() == (2, 1001.5)


def test_csv_own_tokens_and_none(spark, na_csv):
    df = tf.read_table(spark, na_csv, "csv", "Category string, Score string, Note string, d date",
                       na_tokens=["x"])
    assert [r.Note for r in df.orderBy("d").collect()] == [None, "NA", None, "q,r"]
    df = tf.read_table(spark, na_csv, "csv", df.schema, na_tokens=[])
    assert [r.Note for r in df.orderBy("d").collect()] == ["x", "NA", None, "q,r"]


def test_csv_bad_cells(spark, na_csv):
    schema = "Category int, Score double, Note string, d date"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tf.read_table(spark, na_csv, "csv", schema).collect()
    lenient = tf.read_table(spark, na_csv, "csv", schema, lenient=True)
    assert lenient.select("Category").distinct().collect() == [(None,)]
    assert lenient.where("Score > 4").count() == 3


def test_csv_header_must_match_schema(spark, na_csv):
    with pytest.raises(Exception, match="header"):
        tf.read_table(spark, na_csv, "csv", "Score double, Category string, Note string, d date").collect()


def test_csv_reads_only_needed_columns_with_schema(spark, na_csv):
    df = tf.read_table(spark, na_csv, "csv", "Category string, Score double, Note string, d date")
    plan = df.select("Score")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv [Score" in plan and "ReadSchema: struct<Score:string>" in plan
    assert rows(df.select("Score")) == [(None,), (5.0,), (20.0,), (30.0,)]


def test_csv_cells_survive(spark, tmp_path):
    texts = ['say "hi", you', " padded ", "back\\slash", "\\", 'a\\"b', "comma,", "'", "ünï", '"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    path = tf.write_table(df, str(tmp_path / "out"), "csv")
    back = tf.read_table(spark, path, "csv", df.schema)
    assert rows(back) == rows(df)
    frame = pd.concat(pd.read_csv(f) for f in glob.glob(f"{path}/*.csv"))
    assert sorted(zip(frame.i, frame.t)) == rows(df)


def test_csv_cells_with_newlines(spark, tmp_path):
    df = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet"))
    df = df.withColumn("text", F.concat(F.lit("a\n\""), "text", F.lit("\n\nb")))
    path = tf.write_table(df, str(tmp_path / "out"), "csv")
    back = tf.read_table(
        spark, path, "csv", df.schema, na_tokens=[], options={"multiLine": True, "lineSep": "\n"}
    )
    assert back.exceptAll(df).count() == 0 and back.count() == df.count()


def test_csv_nulls_become_empty_cells(spark, tmp_path, scores):
    path = tf.write_table(scores.coalesce(1), str(tmp_path / "out"))
    (part,) = glob.glob(f"{path}/part-*")
    lines = open(part).read().splitlines()
    assert lines[0] == "Category,Score,s,n"
    assert ",30.0,," in lines and "b,,w,4" in lines


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_times_keep_microseconds(spark, tmp_path, fmt):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-01-02 03:04:05.678901' AS n, timestamp'2024-01-02 03:04:05.678901' AS t"
    )
    path = tf.write_table(df, str(tmp_path / "out"), fmt)
    assert tf.read_table(spark, path, fmt, df.schema).collect() == df.collect()


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_round_trips_and_modes(spark, tmp_path, scores, fmt):
    path = str(tmp_path / "out")
    assert tf.write_table(scores, path, fmt) == path
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tf.write_table(scores, path, fmt)
    assert rows(tf.read_table(spark, path, fmt, scores.schema)) == rows(scores)
    tf.write_table(scores, path, fmt, "append")
    assert tf.read_table(spark, path, fmt, scores.schema).count() == 8
    tf.write_table(scores.limit(1), path, fmt, "overwrite")
    assert tf.read_table(spark, path, fmt, scores.schema).count() == 1


def test_json_without_schema(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text('{"a": 1, "b": "x"}\n{"a": null, "b": "y"}\n')
    df = tf.read_table(spark, str(path), "json")
    assert rows(df) == [(None, "y"), (1, "x")] and types(df) == ["bigint", "string"]


@pytest.mark.parametrize("path", [None, "", "  "])
def test_missing_paths(spark, scores, path):
    with pytest.raises(ValueError, match="Missing input/output path"):
        tf.read_table(spark, path)
    with pytest.raises(ValueError, match="Missing input/output path"):
        tf.write_table(scores, path)


def test_unknown_format_and_mode(spark, scores, tmp_path):
    with pytest.raises(ValueError, match="orc"):
        tf.read_table(spark, "x", "orc")
    with pytest.raises(ValueError, match="orc"):
        tf.write_table(scores, str(tmp_path / "x"), "orc")
    with pytest.raises(ValueError, match="ignore"):
        tf.write_table(scores, str(tmp_path / "x"), "csv", "ignore")


def test_delta_without_connector(spark, scores, tmp_path):
    with pytest.raises(ValueError, match="Delta connector"):
        tf.read_table(spark, str(tmp_path), "delta")
    with pytest.raises(ValueError, match="Delta connector"):
        tf.write_table(scores, str(tmp_path / "x"), "delta")


@pytest.mark.parametrize(
    "given, expected",
    [
        ("in/file.csv", "in/file_enriched.csv"),
        ("file", "file_enriched.csv"),
        ("file.csv", "file_enriched.csv"),
        ("a\\b\\f.parquet", "a/b/f_enriched.parquet"),
        ("a.b/c", "a.b/c_enriched.csv"),
        ("data/parts/", "data/parts_enriched.csv"),
        (
            "abfss://c@a.dfs.core.windows.net/in/f.csv",
            "abfss://c@a.dfs.core.windows.net/in/f_enriched.csv",
        ),
    ],
)
def test_default_output_path(given, expected):
    assert tf.enriched_path(given) == expected


def test_object_store_uri():
    assert tf.object_store_uri("a", "c", "/p/q.csv") == "abfss://c@a.dfs.core.windows.net/p/q.csv"


def test_sink_beside_the_input(scores, tmp_path):
    path = tf.write_table(scores, input_path=str(tmp_path / "file.csv"))
    assert path == str(tmp_path / "file_enriched.csv")


@pytest.mark.parametrize("body", ["a,b,c\n1,2,3\n6,7,8,9\n", "a,b,c\n1,2,3\n4,5\n"])
def test_ragged_csv_fails_unless_lenient(spark, tmp_path, body):
    (tmp_path / "in.csv").write_text(body)
    schema = "a int, b int, c int"
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ"):
        tf.read_table(spark, str(tmp_path / "in.csv"), "csv", schema).collect()
    assert tf.read_table(spark, str(tmp_path / "in.csv"), "csv", schema, lenient=True).count() == 2


def test_bad_json_fails_unless_lenient(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ"):
        tf.read_table(spark, str(tmp_path / "in.json"), "json", "a int").collect()
    assert tf.read_table(spark, str(tmp_path / "in.json"), "json", "a int", lenient=True).count() == 2
