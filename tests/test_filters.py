import pytest
from pyspark.sql import functions as F

import tabflow as tf


@pytest.mark.parametrize("blank", [None, "", "   "])
def test_blank_keeps_all(scores, blank):
    assert tf.filter_rows(scores, blank) is scores


@pytest.mark.parametrize(
    "cond, count",
    [
        ("Score > 10", 3),
        ("Score = 11", 1),
        ("Score == 11", 1),
        ("Score != 20", 2),
        ("NOT (Score = 20)", 2),
        ("NOT (Score <=> 20)", 3),
        ("Score >= 11 and Category == 'a'", 2),
        ("Score < 12 OR n <= 2", 2),
        ("Category IN ('a', 'b')", 3),
        ("Category NOT IN ('a')", 1),
        ("Score BETWEEN 11 AND 20", 2),
        (lambda: tf.differs("Score", 20), 3),
        (lambda: tf.differs("Category", None), 3),
        (lambda: F.col("Score") > 10, 3),
        (lambda: (F.col("Score") > 10) & ~(F.col("s") == "x"), 1),
        (lambda: (F.col("Score") > 25) | (F.col("n") == 4), 2),
        (lambda: F.col("Category").isin("a"), 2),
    ],
)
def test_predicates(scores, cond, count):
    cond = cond if isinstance(cond, str) else cond()
    assert tf.filter_rows(scores, cond).count() == count


def test_worked_examples(spark):
    people = spark.createDataFrame(
        [(17, "active"), (18, "active"), (40, "idle")], "age bigint, status string"
    )
    assert tf.filter_rows(people, "age >= 18 and status == 'active'").count() == 1
    totals = spark.createDataFrame(
        [(1500.0, "NL"), (900.0, "BE"), (2000.0, "FR")], "`Total Amount` double, country string"
    )
    cond = "`Total Amount` > 1000 and country in ('NL', 'BE')"
    assert [r.country for r in tf.filter_rows(totals, cond).collect()] == ["NL"]
