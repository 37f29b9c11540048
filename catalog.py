"""The checked queries: each a Spark plan over the test tables, most with its SQL.

``QUERIES`` maps a name to a function of (spark, folder of the tables), ``SQL``
to the same result written for DuckDB. The test tables hold no nulls, so some
queries make them with ``CASE WHEN`` on both sides.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

import tabflow as tf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Makes the operators split groups of over 500 rows, whatever the size of the input.
SPLIT = tf.SkewPolicy(small_bytes=0, hot_rows=500, max_hot=4096, broadcast=False)


def query(sql: str | None = None):
    """Register the function below under its name."""

    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = " ".join(sql.split())
        return build

    return register


@cache
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file once per session."""
    return tf.read_table(spark, f"{folder}/{name}.parquet", "parquet")


@cache
def _local_folder() -> tempfile.TemporaryDirectory:
    """For sessions on one machine; removed when Python ends."""
    return tempfile.TemporaryDirectory(prefix="tabflow-")


def scratch(spark: SparkSession) -> str:
    """A new folder name on storage that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or _local_folder().name}/tabflow-{uuid.uuid4().hex}"


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` under the column names of the sample job."""
    return tf.rename(
        table(spark, folder, "events"), {"event_type": "Category", "value": "Score"}
    )


def gappy(spark: SparkSession, folder: str) -> DataFrame:
    """``customer`` with a number and a text column that have nulls."""
    return tf.with_columns(
        table(spark, folder, "customer"),
        {
            "bal": "CASE WHEN c_acctbal >= 5000 THEN c_acctbal END",
            "seg": "CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END",
        },
    )


GAPPY = """(SELECT *, CASE WHEN c_acctbal >= 5000 THEN c_acctbal END AS bal,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS seg FROM customer)"""


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round float results, whose last digits depend on the order of summing."""
    return df.withColumns({name: F.round(tf.column(name), d) for name, d in digits.items()})


# --- the sample job ---------------------------------------------------------

SAMPLE_OPS = [
    {"op": "add_column", "name": "stage", "value": "raw"},
    {"op": "add_column", "name": "Time", "value": ""},
    {"op": "filter", "expr": "Score > 10"},
    {"op": "groupByReduce", "group_cols": ["Category"], "func": "mean"},
]

_SAMPLE_SQL = """SELECT event_type AS Category, round(avg(value), 4) AS Score,
    round(avg(user_id), 4) AS user_id, round(avg(event_id), 4) AS event_id
    FROM events WHERE value > 10 GROUP BY 1"""


@query(_SAMPLE_SQL)
def etl_flagship(spark, folder):
    df = tf.add_column(scores(spark, folder), "stage", "raw")
    df = tf.add_column(df, "Time", "")
    df = tf.filter_rows(df, "Score > 10")
    df = tf.groupby_reduce(df, "Category", "mean")
    return rounded(df, Score=4, user_id=4, event_id=4)


@query(_SAMPLE_SQL)
def etl_op_list(spark, folder):
    df = tf.apply_ops(scores(spark, folder), SAMPLE_OPS)
    return rounded(df, Score=4, user_id=4, event_id=4)


@query(
    """SELECT event_type AS Category, count(value) AS count_value,
    round(sum(value), 2) AS total FROM events WHERE value > 10 GROUP BY 1"""
)
def job_parquet_to_json(spark, folder):
    path = tf.run_job(
        spark,
        {
            "input": {"path": f"{folder}/events.parquet", "format": "parquet"},
            "output": {"path": scratch(spark), "format": "json", "mode": "overwrite"},
            "operations": [
                {"op": "rename", "mapping": {"event_type": "Category"}},
                {"op": "filter", "expr": "value > 10"},
                {
                    "op": "groupByAgg",
                    "group_cols": ["Category"],
                    "aggs": [
                        {"func": "count", "col": "value"},
                        {"func": "sum", "col": "value", "alias": "total"},
                    ],
                },
            ],
            "required_columns": ["Category", "total"],
        },
    )
    schema = "Category string, count_value bigint, total double"
    return rounded(tf.read_table(spark, path, "json", schema), total=2)


@query(
    """SELECT c_nationkey, count(o_orderkey) AS count_o_orderkey,
    round(sum(o_totalprice), 2) AS sum_o_totalprice
    FROM customer JOIN orders ON c_custkey = o_custkey
    WHERE o_orderstatus IN ('F', 'O') GROUP BY 1"""
)
def op_list_join(spark, folder):
    orders = tf.rename(table(spark, folder, "orders"), {"o_custkey": "c_custkey"})
    df = tf.apply_ops(
        table(spark, folder, "customer"),
        [
            {"op": "join", "target_alias": "orders", "on": ["c_custkey"], "how": "inner"},
            {"op": "filter", "expr": "o_orderstatus IN ('F', 'O')"},
            {
                "op": "groupByAgg",
                "group_cols": ["c_nationkey"],
                "aggs": {"o_orderkey": "count", "o_totalprice": ["sum"]},
            },
        ],
        {"orders": orders},
    )
    return rounded(df, sum_o_totalprice=2)


# --- columns ----------------------------------------------------------------


@query("SELECT *, 'raw' AS stage FROM customer")
def add_column(spark, folder):
    return tf.add_column(table(spark, folder, "customer"), "stage", "raw")


@query("SELECT c_custkey, true AS has_time FROM customer")
def add_time(spark, folder):
    df = tf.add_column(table(spark, folder, "customer"), "Time", None)
    return df.select("c_custkey", F.col("Time").isNotNull().alias("has_time"))


@query("SELECT c_custkey, '2024-05-06T07:08:09.000010+00:00' AS Time FROM customer")
def add_time_text(spark, folder):
    df = tf.select(table(spark, folder, "customer"), "c_custkey")
    return tf.add_column(df, "Time", "", now="2024-05-06T07:08:09.000010", as_string=True)


@query("SELECT *, CAST(NULL AS INTEGER) AS x, -1 AS y FROM customer")
def literal_null_negative(spark, folder):
    df = tf.with_literal(table(spark, folder, "customer"), "x", None, "int")
    return tf.with_literal(df, "y", -1)


@query(
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net
    FROM lineitem"""
)
def arith(spark, folder):
    df = tf.with_column(
        table(spark, folder, "lineitem"), "net", "round(l_extendedprice * (1 - l_discount), 4)"
    )
    return tf.select(df, ["l_orderkey", "l_linenumber", "net"])


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS tier
    FROM orders"""
)
def where_flag(spark, folder):
    df = tf.where(table(spark, folder, "orders"), "tier", "o_totalprice > 250000", "high", "low")
    return tf.select(df, ["o_orderkey", "tier"])


@query(
    f"""SELECT c_custkey, CASE WHEN bal > 7000 THEN 'high' ELSE 'low' END AS tier FROM {GAPPY}"""
)
def where_null_condition(spark, folder):
    df = tf.where(gappy(spark, folder), "tier", F.col("bal") > 7000, "high", "low")
    return tf.select(df, ["c_custkey", "tier"])


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE o_orderpriority END
    AS o_orderpriority FROM orders"""
)
def masked_update(spark, folder):
    df = tf.update_where(
        table(spark, folder, "orders"), "o_orderstatus = 'F'", "o_orderpriority", "DONE"
    )
    return tf.select(df, ["o_orderkey", "o_orderpriority"])


@query(
    "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'big' END AS note FROM orders"
)
def update_new_column(spark, folder):
    df = tf.update_where(
        table(spark, folder, "orders"), F.col("o_totalprice") > 400000, "note", "big"
    )
    return tf.select(df, ["o_orderkey", "note"])


@query("SELECT c_name AS name, c_acctbal AS c_custkey FROM customer")
def select_drop_rename(spark, folder):
    df = tf.select(table(spark, folder, "customer"), ["c_custkey", "c_name", "c_acctbal"])
    df = tf.drop(df, ["c_custkey", "no_such_column"])
    return tf.rename(df, {"c_name": "name", "c_acctbal": "c_custkey"})


@query(
    """SELECT o_custkey AS o_orderkey, o_orderkey AS o_custkey, o_orderstatus, o_totalprice,
    o_orderdate, o_orderpriority FROM orders"""
)
def rename_swap(spark, folder):
    return tf.rename(
        table(spark, folder, "orders"), {"o_orderkey": "o_custkey", "o_custkey": "o_orderkey"}
    )


@query(
    f"""SELECT c_custkey, coalesce(bal, 0.0) AS bal, coalesce(seg, 'none') AS seg FROM {GAPPY}"""
)
def fillna(spark, folder):
    df = tf.select(gappy(spark, folder), ["c_custkey", "bal", "seg"])
    return tf.fillna(tf.fillna(df, 0, "bal"), "none", ["seg"])


@query(f"SELECT c_custkey, coalesce(bal, -1.0) AS bal, seg FROM {GAPPY}")
def fillna_all_columns(spark, folder):
    return tf.fillna(tf.select(gappy(spark, folder), ["c_custkey", "bal", "seg"]), -1)


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x FROM customer")
def nan_to_null(spark, folder):
    df = tf.with_column(
        table(spark, folder, "customer"),
        "x",
        "CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE double('NaN') END",
    )
    return tf.select(tf.nan_to_null(df), ["c_custkey", "x"])


# --- filters ----------------------------------------------------------------


@query(
    """SELECT o_orderkey FROM orders WHERE (o_totalprice >= 100000
    AND o_orderstatus IN ('F', 'O')) OR NOT (o_orderpriority = '5-LOW')"""
)
def pred_mix(spark, folder):
    df = tf.filter_rows(
        table(spark, folder, "orders"),
        """(o_totalprice >= 100000 AND o_orderstatus IN ('F', 'O'))
        OR NOT (o_orderpriority == '5-LOW')""",
    )
    return tf.select(df, "o_orderkey")


@query(
    """SELECT o_orderkey FROM orders WHERE o_totalprice < 50000
    OR (o_totalprice <= 300000 AND o_orderstatus <> 'F' AND NOT o_orderpriority = '1-URGENT')"""
)
def filter_column_object(spark, folder):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    mask = (price < 50000) | (
        (price <= 300000) & (status != "F") & ~(F.col("o_orderpriority") == "1-URGENT")
    )
    return tf.select(tf.filter_rows(table(spark, folder, "orders"), mask), "o_orderkey")


@query("SELECT * FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def filter_not_in(spark, folder):
    return tf.filter_rows(
        table(spark, folder, "orders"), ~F.col("o_orderstatus").isin("F", "O")
    )


@query("SELECT * FROM customer")
def filter_blank(spark, folder):
    return tf.filter_rows(tf.filter_rows(table(spark, folder, "customer"), None), "  ")


@query(f"SELECT c_custkey, seg FROM {GAPPY} WHERE seg <> 'HOUSEHOLD'")
def ne_null(spark, folder):
    return tf.select(
        tf.filter_rows(gappy(spark, folder), "seg != 'HOUSEHOLD'"), ["c_custkey", "seg"]
    )


@query(f"SELECT c_custkey, seg FROM {GAPPY} WHERE seg IS DISTINCT FROM 'HOUSEHOLD'")
def ne_null_safe(spark, folder):
    df = tf.filter_rows(gappy(spark, folder), tf.differs("seg", "HOUSEHOLD"))
    return tf.select(df, ["c_custkey", "seg"])


@query(
    """SELECT o_orderkey, o_totalprice AS amount FROM orders
    WHERE o_totalprice > 300000 AND o_orderstatus IN ('F', 'O')"""
)
def backtick_in(spark, folder):
    df = tf.rename(table(spark, folder, "orders"), {"o_totalprice": "Total Amount"})
    df = tf.filter_rows(df, "`Total Amount` > 300000 and o_orderstatus in ('F', 'O')")
    return tf.rename(tf.select(df, ["o_orderkey", "Total Amount"]), {"Total Amount": "amount"})


# --- joins ------------------------------------------------------------------


def big_orders(spark, folder):
    df = tf.filter_rows(table(spark, folder, "orders"), "o_totalprice > 400000")
    df = tf.select(df, ["o_custkey", "o_orderkey"])
    return tf.rename(df, {"o_custkey": "c_custkey"})


def customer_names(spark, folder, cond=None):
    df = tf.filter_rows(table(spark, folder, "customer"), cond)
    return tf.select(df, ["c_custkey", "c_name"])


@query(
    """SELECT c_custkey, c_name, o_orderkey FROM customer
    LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey"""
)
def join_left(spark, folder):
    return tf.join(customer_names(spark, folder), big_orders(spark, folder), "c_custkey")


@query(
    """SELECT c_custkey, c_name, o_orderkey
    FROM (SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY')
    JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey"""
)
def join_inner(spark, folder):
    machinery = customer_names(spark, folder, "c_mktsegment = 'MACHINERY'")
    return tf.join(machinery, big_orders(spark, folder), ["c_custkey"], "inner")


@query(
    """SELECT o_custkey AS c_custkey, c_name, o_orderkey
    FROM (SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY')
    RIGHT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey"""
)
def join_right(spark, folder):
    machinery = customer_names(spark, folder, "c_mktsegment = 'MACHINERY'")
    return tf.join(machinery, big_orders(spark, folder), ["c_custkey"], "right")


@query(
    """SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, o_orderkey
    FROM (SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY')
    FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey"""
)
def join_full(spark, folder):
    machinery = customer_names(spark, folder, "c_mktsegment = 'MACHINERY'")
    return tf.join(machinery, big_orders(spark, folder), ["c_custkey"], "full")


@query(
    """SELECT c_custkey FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"""
)
def join_semi(spark, folder):
    customers = tf.select(table(spark, folder, "customer"), "c_custkey")
    return tf.join(customers, big_orders(spark, folder), "c_custkey", "left_semi")


@query(
    """SELECT c_custkey FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"""
)
def join_anti(spark, folder):
    customers = tf.select(table(spark, folder, "customer"), "c_custkey")
    return tf.join(customers, big_orders(spark, folder), "c_custkey", "left_anti")


# One key with a third of all orders, one null key with another third.
_SKEWED = """CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN o_custkey END"""


def skewed_orders(spark, folder):
    df = tf.with_column(table(spark, folder, "orders"), "c_custkey", _SKEWED)
    return tf.select(df, ["c_custkey", "o_orderkey"])


_SKEWED_FROM = f"""(SELECT * FROM customer WHERE c_custkey % 2 = 1) c
    {{}} JOIN (SELECT {_SKEWED} AS k, o_orderkey FROM orders) o ON c.c_custkey = o.k"""


def odd_customers(spark, folder):
    return customer_names(spark, folder, "c_custkey % 2 = 1")


@query(f"SELECT c_custkey, c_name, o_orderkey FROM {_SKEWED_FROM.format('LEFT')}")
def join_left_salted(spark, folder):
    left, right = odd_customers(spark, folder), skewed_orders(spark, folder)
    return tf.join(left, right, "c_custkey", "left", skew=SPLIT)


@query(
    f"""SELECT coalesce(c_custkey, k) AS c_custkey, c_name, o_orderkey
    FROM {_SKEWED_FROM.format('FULL')}"""
)
def join_full_salted(spark, folder):
    left, right = odd_customers(spark, folder), skewed_orders(spark, folder)
    return tf.join(left, right, "c_custkey", "full", skew=SPLIT)


@query(f"SELECT k AS c_custkey, c_name, o_orderkey FROM {_SKEWED_FROM.format('RIGHT')}")
def join_right_salted(spark, folder):
    left, right = odd_customers(spark, folder), skewed_orders(spark, folder)
    return tf.join(left, right, "c_custkey", "right", skew=SPLIT)


@query(f"SELECT c_custkey, c_name, o_orderkey FROM {_SKEWED_FROM.format('INNER')}")
def join_inner_salted(spark, folder):
    left, right = odd_customers(spark, folder), skewed_orders(spark, folder)
    return tf.join(left, right, "c_custkey", "inner", skew=SPLIT)


@query(
    f"""SELECT k AS c_custkey, o_orderkey FROM (SELECT {_SKEWED} AS k, o_orderkey FROM orders)
    WHERE k IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1)"""
)
def join_semi_salted(spark, folder):
    left, right = skewed_orders(spark, folder), odd_customers(spark, folder)
    return tf.join(left, right, "c_custkey", "left_semi", skew=SPLIT)


@query(
    f"""SELECT k AS c_custkey, o_orderkey FROM (SELECT {_SKEWED} AS k, o_orderkey FROM orders)
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 2 = 1 AND c_custkey = k)"""
)
def join_anti_salted(spark, folder):
    left, right = skewed_orders(spark, folder), odd_customers(spark, folder)
    return tf.join(left, right, "c_custkey", "left_anti", skew=SPLIT)


# --- aggregates -------------------------------------------------------------


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS sum_l_extendedprice,
    round(avg(l_extendedprice), 4) AS mean_l_extendedprice,
    count(l_orderkey) AS count_l_orderkey FROM lineitem GROUP BY 1, 2"""
)
def groupby_agg(spark, folder):
    df = tf.groupby_agg(
        table(spark, folder, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {"l_extendedprice": ["sum", "mean"], "l_orderkey": "count"},
    )
    return rounded(df, sum_l_extendedprice=2, mean_l_extendedprice=4)


@query(
    """SELECT l_returnflag, round(sum(l_quantity), 2) AS qty, round(avg(l_tax), 4) AS tax,
    max(l_shipdate) AS latest FROM lineitem GROUP BY 1"""
)
def groupby_aliased(spark, folder):
    df = tf.groupby_agg(
        table(spark, folder, "lineitem"),
        "l_returnflag",
        [
            {"func": "sum", "col": "l_quantity", "alias": "qty"},
            F.avg("l_tax").alias("tax"),
            {"func": "max", "col": "l_shipdate", "alias": "latest"},
        ],
    )
    return rounded(df, qty=2, tax=4)


@query(
    f"""SELECT seg, count(c_custkey) AS count_c_custkey, round(sum(bal), 2) AS sum_bal
    FROM {GAPPY} GROUP BY 1"""
)
def groupby_null_key(spark, folder):
    df = tf.groupby_agg(gappy(spark, folder), "seg", {"c_custkey": "count", "bal": "sum"})
    return rounded(df, sum_bal=2)


@query(f"SELECT seg, max(bal) AS bal FROM {GAPPY} WHERE seg IS NOT NULL GROUP BY 1")
def groupby_drop_null(spark, folder):
    df = tf.select(gappy(spark, folder), ["seg", "bal"])
    return tf.groupby_reduce(df, "seg", "max", dropna=True)


@query("SELECT * FROM supplier")
def groupby_no_keys(spark, folder):
    df = tf.groupby_agg(table(spark, folder, "supplier"), [], {"s_acctbal": "sum"})
    return tf.groupby_agg(df, "s_nationkey", {})


@query(
    """SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber
    FROM lineitem GROUP BY 1"""
)
def sum_int(spark, folder):
    return tf.groupby_agg(
        table(spark, folder, "lineitem"), "l_returnflag", {"l_linenumber": "sum"}
    )


@query(
    """SELECT c_nationkey, round(coalesce(sum(CASE WHEN c_acctbal > 9990 THEN c_acctbal END),
    0.0), 2) AS sum_bal FROM customer GROUP BY 1"""
)
def sum_min0(spark, folder):
    df = tf.with_column(
        table(spark, folder, "customer"), "bal", "CASE WHEN c_acctbal > 9990 THEN c_acctbal END"
    )
    df = tf.groupby_agg(df, "c_nationkey", {"bal": "sum"}, min_count0=True)
    return rounded(df, sum_bal=2)


@query(
    """SELECT o_orderstatus, round(stddev_samp(o_totalprice), 2) AS std_o_totalprice,
    round(var_samp(o_totalprice / 1000), 2) AS v,
    count(DISTINCT o_custkey) AS nunique_o_custkey FROM orders GROUP BY 1"""
)
def std_var_nunique(spark, folder):
    df = tf.with_column(table(spark, folder, "orders"), "thousands", "o_totalprice / 1000")
    df = tf.groupby_agg(
        df,
        "o_orderstatus",
        [
            {"func": "std", "col": "o_totalprice"},
            {"func": "var", "col": "thousands", "alias": "v"},
            {"func": "nunique", "col": "o_custkey"},
        ],
    )
    return rounded(df, std_o_totalprice=2, v=2)


@query(
    """SELECT o_orderstatus, count(*) AS size, min(o_totalprice) AS min_o_totalprice,
    max(o_orderdate) AS max_o_orderdate FROM orders GROUP BY 1"""
)
def size_min_max(spark, folder):
    return tf.groupby_agg(
        table(spark, folder, "orders"),
        "o_orderstatus",
        [
            {"func": "size", "col": "*", "alias": "size"},
            {"func": "min", "col": "o_totalprice"},
            {"func": "max", "col": "o_orderdate"},
        ],
    )


@query(
    """SELECT user_id, arg_min(event_type, ts) AS first_event_type,
    arg_max(event_type, ts) AS last_event_type FROM events GROUP BY 1"""
)
def first_last(spark, folder):
    return tf.groupby_agg(
        table(spark, folder, "events"),
        "user_id",
        {"event_type": ["first", "last"]},
        order_col="ts",
    )


@query(
    """SELECT user_id,
    arg_min(event_type, ts) FILTER (event_type <> 'click') AS first_kind,
    arg_max(event_type, ts) FILTER (event_type <> 'click') AS last_kind FROM events GROUP BY 1"""
)
def first_last_nulls(spark, folder):
    df = tf.with_column(
        table(spark, folder, "events"),
        "kind",
        "CASE WHEN event_type <> 'click' THEN event_type END",
    )
    return tf.groupby_agg(df, "user_id", {"kind": ["first", "last"]}, order_col="ts")


@query(
    """SELECT l_suppkey, min({'m': month(l_shipdate), 'v': l_extendedprice}).v AS first_l_extendedprice,
    max({'m': month(l_shipdate), 'v': l_extendedprice}).v AS last_l_extendedprice
    FROM lineitem GROUP BY 1"""
)
def first_last_ties(spark, folder):
    df = tf.with_column(table(spark, folder, "lineitem"), "m", "month(l_shipdate)")
    return tf.groupby_agg(df, "l_suppkey", {"l_extendedprice": ["first", "last"]}, order_col="m")


@query(
    """SELECT l_shipdate, round(median(l_quantity), 4) AS l_quantity FROM lineitem GROUP BY 1"""
)
def median(spark, folder):
    df = tf.select(table(spark, folder, "lineitem"), ["l_shipdate", "l_quantity"])
    return rounded(tf.groupby_reduce(df, "l_shipdate", "median"), l_quantity=4)


@query(
    """SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag,
    round(median(l_extendedprice), 4) AS median_l_extendedprice,
    round(median(l_partkey), 4) AS median_l_partkey,
    round(median(CASE WHEN l_linenumber > 2 THEN l_discount END), 4) AS median_disc,
    round(median(CASE WHEN l_linenumber > 9 THEN l_tax END), 4) AS median_none,
    count(l_orderkey) AS n FROM lineitem GROUP BY 1"""
)
def median_split(spark, folder):
    df = tf.with_columns(
        table(spark, folder, "lineitem"),
        {
            "flag": "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END",
            "disc": "CASE WHEN l_linenumber > 2 THEN l_discount END",
            "none": "CASE WHEN l_linenumber > 9 THEN l_tax END",
        },
    )
    df = tf.groupby_agg(
        df,
        "flag",
        [
            {"func": "median", "col": "l_extendedprice"},
            {"func": "median", "col": "l_partkey"},
            {"func": "count", "col": "l_orderkey", "alias": "n"},
            {"func": "median", "col": "disc"},
            {"func": "median", "col": "none"},
        ],
        skew=SPLIT,
    )
    names = ["median_l_extendedprice", "median_l_partkey", "median_disc", "median_none"]
    return rounded(df, **dict.fromkeys(names, 4))


@query(
    """SELECT user_id, round(median(value), 4) AS value, round(median(event_id), 4) AS event_id
    FROM (SELECT CASE WHEN event_id % 3 > 0 THEN 7 ELSE user_id END AS user_id, value, event_id
    FROM events) GROUP BY 1"""
)
def reduce_median_split(spark, folder):
    df = tf.with_column(
        table(spark, folder, "events"),
        "user_id",
        "CASE WHEN event_id % 3 > 0 THEN 7 ELSE user_id END",
    )
    df = tf.groupby_reduce(df, "user_id", "median", skew=SPLIT)
    return rounded(df, value=4, event_id=4)


def _reduced(spark, folder, func):
    df = tf.filter_rows(scores(spark, folder), "Score > 10")
    return tf.groupby_reduce(tf.drop(df, "event_id"), ["Category"], func)


_REDUCE_SQL = """SELECT event_type AS Category, {} AS Score, {} AS user_id
    FROM events WHERE value > 10 GROUP BY 1"""


@query(_REDUCE_SQL.format("round(sum(value), 2)", "CAST(sum(user_id) AS BIGINT)"))
def reduce_sum(spark, folder):
    return rounded(_reduced(spark, folder, "sum"), Score=2)


@query(_REDUCE_SQL.format("count(value)", "count(user_id)"))
def reduce_count(spark, folder):
    return _reduced(spark, folder, "count")


@query(_REDUCE_SQL.format("min(value)", "min(user_id)"))
def reduce_min(spark, folder):
    return _reduced(spark, folder, "min")


@query(_REDUCE_SQL.format("max(value)", "max(user_id)"))
def reduce_max(spark, folder):
    return _reduced(spark, folder, "max")


@query(_REDUCE_SQL.format("round(median(value), 4)", "round(median(user_id), 4)"))
def reduce_median(spark, folder):
    return rounded(_reduced(spark, folder, "median"), Score=4, user_id=4)


# --- windows ----------------------------------------------------------------


@query(
    """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS mean_value FROM events"""
)
def window_frame(spark, folder):
    df = tf.select(table(spark, folder, "events"), ["event_id", "user_id", "ts", "value"])
    df = tf.window(df, "user_id", ["ts", "event_id"], func="mean", col="value")
    return rounded(tf.select(df, ["event_id", "mean_value"]), mean_value=4)


@query(
    """SELECT event_id, round(sum(value) OVER w, 2) AS sum_value, min(value) OVER w AS min_value,
    max(value) OVER w AS max_value, count(value) OVER w AS count_value FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""
)
def window_functions(spark, folder):
    df = tf.select(table(spark, folder, "events"), ["event_id", "user_id", "ts", "value"])
    for func in ("sum", "min", "max", "count"):
        df = tf.window(df, "user_id", ["ts", "event_id"], func=func, col="value", rows=(-3, 0))
    return rounded(tf.drop(df, ["user_id", "ts", "value"]), sum_value=2)


@query(
    """SELECT event_id, u, round(avg(value) OVER (PARTITION BY u ORDER BY ts, event_id
    ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS mean_value
    FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN user_id WHEN event_id % 3 = 1 THEN 7 END AS u
    FROM events)"""
)
def window_frame_split(spark, folder):
    df = tf.with_column(
        table(spark, folder, "events"),
        "u",
        "CASE WHEN event_id % 3 = 0 THEN user_id WHEN event_id % 3 = 1 THEN 7 END",
    )
    df = tf.window(df, "u", ["ts", "event_id"], func="mean", col="value", skew=SPLIT)
    return rounded(tf.select(df, ["event_id", "u", "mean_value"]), mean_value=4)


@query(
    """SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id
    ROWS BETWEEN 70 PRECEDING AND 5 PRECEDING), 2) AS sum_value FROM events"""
)
def window_whole_table_split(spark, folder):
    df = tf.select(table(spark, folder, "events"), ["event_id", "ts", "value"])
    df = tf.window(
        df, None, ["ts", "event_id"], func="sum", col="value", rows=(-70, -5), skew=SPLIT
    )
    return rounded(tf.select(df, ["event_id", "sum_value"]), sum_value=2)


_LONG_FRAME = """SELECT event_id, round(sum(value) OVER w, 2) AS sum_value, max(value) OVER w AS max_value,
    count(value) OVER w AS count_value, round(avg(value) OVER w, 4) AS mean_value FROM events
    WINDOW w AS (PARTITION BY {} ORDER BY ts, event_id ROWS BETWEEN 30000 PRECEDING AND 19999 FOLLOWING)"""


def _long_frame(spark, folder, partition, **skew):
    df = tf.select(table(spark, folder, "events"), ["event_id", "event_type", "ts", "value"])
    for func in ("sum", "max", "count", "mean"):
        df = tf.window(
            df, partition, ["ts", "event_id"], func=func, col="value", rows=(-30000, 19999), **skew
        )
    return rounded(tf.drop(df, ["event_type", "ts", "value"]), sum_value=2, mean_value=4)


@query(_LONG_FRAME.format("event_type"))
def window_long_frame(spark, folder):
    return _long_frame(spark, folder, "event_type")


@query(_LONG_FRAME.format("1"))
def window_long_frame_split(spark, folder):
    return _long_frame(spark, folder, None, skew=SPLIT)


@query(
    """SELECT event_id, min(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
    ROWS BETWEEN 150 PRECEDING AND 60 PRECEDING) AS min_value FROM events"""
)
def window_block_frame(spark, folder):
    df = tf.select(table(spark, folder, "events"), ["event_id", "event_type", "ts", "value"])
    df = tf.window(df, "event_type", ["ts", "event_id"], func="min", col="value", rows=(-150, -60))
    return tf.select(df, ["event_id", "min_value"])


# --- order, limit, set operations -------------------------------------------


@query(
    """SELECT o_orderkey, o_totalprice FROM orders
    ORDER BY o_totalprice, o_orderkey LIMIT 10"""
)
def top_k(spark, folder):
    df = tf.select(table(spark, folder, "orders"), ["o_orderkey", "o_totalprice"])
    return tf.limit(tf.order_by(df, ["o_totalprice", "o_orderkey"]), 10)


@query("SELECT * FROM lineitem ORDER BY l_returnflag, l_orderkey, l_linenumber")
def order_by(spark, folder):
    return tf.order_by(
        table(spark, folder, "lineitem"), ["l_returnflag", "l_orderkey", "l_linenumber"]
    )


@query("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def union(spark, folder):
    names = tf.rename(tf.select(table(spark, folder, "customer"), "c_name"), {"c_name": "name"})
    return tf.union(names, tf.select(table(spark, folder, "supplier"), "s_name"))


@query(
    """SELECT c_name AS name, c_acctbal AS bal FROM customer
    UNION ALL BY NAME SELECT s_acctbal AS bal, s_name AS name FROM supplier"""
)
def union_by_name(spark, folder):
    left = tf.rename(
        tf.select(table(spark, folder, "customer"), ["c_name", "c_acctbal"]),
        {"c_name": "name", "c_acctbal": "bal"},
    )
    right = tf.rename(
        tf.select(table(spark, folder, "supplier"), ["s_acctbal", "s_name"]),
        {"s_name": "name", "s_acctbal": "bal"},
    )
    return tf.union_by_name(left, right)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, folder):
    return tf.distinct(
        tf.select(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])
    )


@query(
    """SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS sum_value FROM events"""
)
def window_running_sum_split(spark, folder):
    df = tf.select(table(spark, folder, "events"), ["event_id", "event_type", "ts", "value"])
    frame = (Window.unboundedPreceding, 0)
    df = tf.window(df, "event_type", ["ts", "event_id"], func="sum", col="value", rows=frame, skew=SPLIT)
    return rounded(tf.select(df, ["event_id", "sum_value"]), sum_value=2)


@query(
    """SELECT event_id, round(max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
    ROWS BETWEEN 1200 PRECEDING AND 700 PRECEDING), 4) AS max_value FROM events"""
)
def window_wide_frame_split(spark, folder):
    df = tf.select(table(spark, folder, "events"), ["event_id", "event_type", "ts", "value"])
    df = tf.window(
        df, "event_type", ["ts", "event_id"], func="max", col="value", rows=(-1200, -700), skew=SPLIT
    )
    return rounded(tf.select(df, ["event_id", "max_value"]), max_value=4)


@query(
    """SELECT c_custkey, (CASE WHEN c_acctbal >= 5000 THEN c_nationkey + 0.5 ELSE 0.25 END)::DOUBLE AS v
    FROM customer"""
)
def fillna_decimal(spark, folder):
    df = table(spark, folder, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_acctbal >= 5000 THEN CAST(c_nationkey + 0.5 AS DECIMAL(8,2)) END AS v"
    )
    return tf.with_column(tf.fillna(df, 0.25, "v"), "v", "double(v)")


# --- sources and sinks ------------------------------------------------------


def _round_trip(spark, df, fmt, schema=None, **settings):
    path = tf.write_table(df, scratch(spark), fmt, "overwrite")
    return tf.read_table(spark, path, fmt, schema, **settings)


@query("SELECT * FROM events")
def csv_round_trip(spark, folder):
    df = table(spark, folder, "events")
    return _round_trip(spark, df, "csv", df.schema)


@query("SELECT * FROM documents")
def csv_round_trip_line_breaks(spark, folder):
    df = table(spark, folder, "documents")
    return _round_trip(spark, df, "csv", df.schema, na_tokens=[])


@query("SELECT c_custkey, CAST(DATE '2024-01-01' + INTERVAL 1 DAY AS VARCHAR)[1:10] AS d FROM customer")
def csv_one_token(spark, folder):
    df = table(spark, folder, "customer").selectExpr("c_custkey", "date'2024-01-02' AS d")
    return _round_trip(spark, df, "csv", na_tokens="NA")


@query("SELECT * FROM customer")
def csv_inferred_types(spark, folder):
    df = _round_trip(spark, table(spark, folder, "customer"), "csv")
    return tf.with_column(df, "c_nationkey", "int(c_nationkey)")


@query(
    """SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment,
    CASE WHEN c_acctbal >= 5000 THEN c_acctbal END AS bal FROM customer"""
)
def csv_na_tokens(spark, folder):
    df = table(spark, folder, "customer").selectExpr(
        "c_custkey",
        "c_mktsegment",
        "CASE WHEN c_acctbal >= 5000 THEN string(c_acctbal) ELSE 'N/A' END AS bal",
    )
    schema = "c_custkey bigint, c_mktsegment string, bal double"
    return _round_trip(spark, df, "csv", schema, na_tokens=["N/A", "MACHINERY"])


@query("SELECT * FROM events")
def json_round_trip(spark, folder):
    df = table(spark, folder, "events")
    return _round_trip(spark, df, "json", df.schema)


@query("SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F'")
def parquet_append(spark, folder):
    df, path = table(spark, folder, "orders"), scratch(spark)
    tf.write_table(df, path, "parquet")
    tf.write_table(tf.filter_rows(df, "o_orderstatus = 'F'"), path, "parquet", "append")
    return tf.read_table(spark, path, "parquet")
