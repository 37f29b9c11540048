import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

import tabflow as tf

from conftest import rows

KINDS = ["inner", "left", "right", "full", "left_semi", "left_anti"]


def brute(left, right, how):
    out, met = [], set()
    for a in left:
        hits = [i for i, b in enumerate(right) if None not in a[:2] and a[:2] == b[:2]]
        met.update(hits)
        if how == "left_semi":
            out += [a] if hits else []
        elif how == "left_anti":
            out += [] if hits else [a]
        else:
            out += [a + right[i][2:] for i in hits]
            if not hits and how in ("left", "full"):
                out.append(a + (None,))
    if how in ("right", "full"):
        out += [b[:2] + (None,) + b[2:] for i, b in enumerate(right) if i not in met]
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 2**32), st.integers(0, 60), st.integers(0, 60))
def test_salted_joins_by_brute_force(spark, seed, n_left, n_right):
    rng = random.Random(seed)
    keys = ["hot", "hot", "hot", None, "a", "b", "only" + str(seed % 3)]

    def side(n):
        return [(rng.choice(keys), rng.choice([1, 1, 1, 2, None]), rng.randrange(9)) for _ in range(n)]

    left, right = side(n_left), side(n_right)
    ldf = spark.createDataFrame(left, "k string, j int, x int").repartition(3)
    rdf = spark.createDataFrame(right, "k string, j bigint, y int").repartition(3)
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=rng.choice([1, 4, 12]), broadcast=False)
    for how in KINDS:
        out = tf.join(ldf, rdf, ["k", "j"], how, skew=policy)
        names = ["k", "j", "x"] if how.startswith("left_") else ["k", "j", "x", "y"]
        assert out.columns == names
        assert rows(out) == brute(left, right, how), how


@pytest.mark.parametrize("how", KINDS)
def test_plain_and_salted_have_one_schema(spark, how):
    left = spark.range(5).selectExpr("id AS k", "id AS x")
    right = spark.range(3, 9).selectExpr("id AS k", "id * 2 AS y")
    plain = tf.join(left, right, "k", how)
    salted = tf.join(
        left, right, "k", how, skew=tf.SkewPolicy(small_bytes=0, hot_rows=1, broadcast=False)
    )
    assert plain.columns == salted.columns
    assert rows(plain) == rows(salted)


def test_left_is_the_default(spark):
    left = spark.range(3).selectExpr("id AS k")
    right = spark.range(1).selectExpr("id AS k", "'x' AS y")
    assert rows(tf.join(left, right, "k")) == [(0, "x"), (1, None), (2, None)]


def test_refusals(spark):
    left = spark.range(3).selectExpr("id AS k", "id AS x")
    with pytest.raises(ValueError, match="Both tables have"):
        tf.join(left, left, "k")
    with pytest.raises(ValueError, match="Unknown join"):
        tf.join(left, left, "k", "cross")
    with pytest.raises(ValueError, match="at least one key"):
        tf.join(left, left, [])
    with pytest.raises(ValueError, match="Unknown column"):
        tf.join(left, left, "absent")
    assert tf.join(left, left, "k", "left_semi").count() == 3


def test_salted_join_with_odd_names(spark):
    left = spark.createDataFrame([(1, "x")] * 9 + [(2, "y")], "`a.b` int, `l l` string")
    right = spark.createDataFrame([(1, 5)] * 4, "`a.b` int, `r.r` int")
    policy = tf.SkewPolicy(small_bytes=0, hot_rows=2, broadcast=False)
    out = tf.join(left, right, ["a.b"], "full", skew=policy)
    assert out.columns == ["a.b", "l l", "r.r"]
    assert rows(out) == [(1, "x", 5)] * 36 + [(2, "y", None)]
