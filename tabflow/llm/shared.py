"""Helpers of several operators: shared storage, row keys, Arrow batches, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, storage that all executors share.

    Without that setting a local master gets a folder in the warehouse, and any
    other master an error, since files on one machine would be lost to the rest.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in shared storage and read back: its work is done
    once, and a lost executor costs no more than a new read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


@lru_cache(maxsize=4)
def ship(context: SparkContext) -> None:
    """Give the executors this package, for sessions that were started without it."""
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="tabflow-")) / "tabflow.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted((root / "tabflow").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(path))


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` by functions of this package."""
    ship(df.sparkSession.sparkContext)
    return df.mapInArrow(run, schema)


def map_batches(
    df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType
) -> DataFrame:
    """``per_batch`` over the Arrow batches of ``df``, each on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield per_batch(batch)

    return map_arrow(df, run, schema)


def extend(schema: StructType, ddl: str) -> StructType:
    """``schema`` with more fields, as a DDL text."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def arrow_schema(schema: str | StructType) -> pa.Schema:
    """The Arrow schema of a Spark schema; to be called on the driver."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return to_arrow_schema(kind)


def spare_name(taken: Sequence[str]) -> str:
    """A column name that is none of those, in upper or lower case."""
    return "text" + "_" * max((len(c) for c in taken), default=0)


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def components(edges: DataFrame) -> DataFrame:
    """The connected components of an undirected graph.

    ``edges`` has columns ``a`` and ``b`` of one integral type. Returns ``node``,
    ``root`` (the smallest node reachable), one row for each node that has an edge
    to another. Alternates large-star and small-star steps, which end after a
    number of rounds about logarithmic in the size of the largest component; each
    is a minimum per node and a join, and its result is written to shared storage.
    A node with very many neighbours is split by adaptive execution.
    """

    def starred(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select("u", "v")
        if large:
            both = both.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # Written, so that the join has shuffles as its inputs and a hot node can be split.
        least = materialise(least.select("u", F.least("u", "m").alias("m")))
        joined = both.join(least.hint("merge"), "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v"))
            )
        return out.where("u <> v").distinct()

    def mark(pairs: DataFrame):
        return pairs.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()

    pairs = materialise(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = mark(pairs)
    while before[0]:
        pairs = materialise(starred(starred(pairs, large=True), large=False))
        after = mark(pairs)
        if after == before:
            break
        before = after
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.unionByName(
        pairs.groupBy("v").agg(F.first("v").alias("root")).select(F.col("v").alias("node"), "root")
    )
