"""Intermediate tables of a job, for inputs that an operation reads several times."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.skew import DEFAULT_SKEW, is_small

#: Plan steps after which a second read would repeat a shuffle.
_SHUFFLES = {"Join", "Aggregate", "Window", "Sort", "RepartitionByExpression", "Repartition", "Generate"}


def reads_again(op: Mapping[str, Any]) -> bool:
    """Whether an operation on a large table reads it more than once."""
    if op["op"] in ("window", "join"):
        return True
    if op["op"] == "groupByReduce":
        return op.get("func") == "median"
    return op["op"] == "groupByAgg" and "median" in str(op.get("aggs"))


def steps(df: DataFrame) -> tuple[set[str], bool]:
    """The kinds of steps of a plan, and whether each run gives the same rows: no random
    values, no samples, and no limit but of sorted rows."""
    plan = df._jdf.queryExecution().analyzed()
    names, same, todo = set(), bool(plan.deterministic()), [plan]
    while todo:
        node = todo.pop()
        children = node.children()
        below = [children.apply(i) for i in range(children.size())]
        names.add(node.nodeName())
        if node.nodeName() in ("GlobalLimit", "LocalLimit"):
            same &= all(x.nodeName() in ("Sort", "LocalLimit") for x in below)
        same &= node.nodeName() != "Sample"
        todo += below
    return names, same


class Staging:
    """Writes tables to shared storage, and removes them when the job is over.

    The folder is below ``spark.checkpoint.dir``, which all executors share; without that
    setting a local session uses its warehouse, and any other raises.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, None, 0

    def _place(self) -> str:
        if self.folder is None:
            context = self.spark.sparkContext
            base = self.spark.conf.get("spark.checkpoint.dir", None)
            base = base or context.getConf().get("spark.checkpoint.dir")
            if not base:
                if not context.master.startswith("local"):
                    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
                base = self.spark.conf.get("spark.sql.warehouse.dir")
            self.folder = f"{base.rstrip('/')}/job-{uuid.uuid4().hex}"
        self.tables += 1
        return f"{self.folder}/{self.tables}"

    def before(self, op: Mapping[str, Any], df: DataFrame) -> DataFrame:
        """``df`` as ``op`` should read it: written once if it would otherwise be worked
        out several times, or differ from one time to the next."""
        if not reads_again(op) or is_small(df, DEFAULT_SKEW):
            return df
        names, same = steps(df)
        if same and not names & _SHUFFLES:
            return df
        path = self._place()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        if self.folder is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
            self.folder = None
