"""Typed sources."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from contextlib import contextmanager
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.expressions import as_list, column, quoted
from ..functions.skew import estimated_bytes
from .csv_records import record_texts
from .paths import require_path

FORMATS = ("csv", "json", "parquet", "delta")

# The cell texts a dataframe CSV reader takes as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Quotes inside a quoted cell are doubled, as in other CSV tools; Spark's own
# default is a backslash.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}

_INTEGER = r"^\s*[-+]?\d+\s*$"
_NUMBER = r"^\s*[-+]?((\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|[iI]nf(inity)?)\s*$"


def check_format(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"Unknown format {fmt!r}; known: {list(FORMATS)}")
    return fmt


@contextmanager
def connector_errors(fmt: str):
    """Say plainly when Spark lacks the connector of a format."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as error:
        if fmt == "delta" and "DATA_SOURCE_NOT_FOUND" in str(error):
            raise ValueError("Delta tables need the Delta connector on Spark's classpath") from error
        raise


def read_table(
    spark: SparkSession,
    path: str | None,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    *,
    na_tokens: str | Iterable[str] = NA_TOKENS,
    lenient: bool = False,
    multi_line: bool = True,
    options: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Read a CSV, JSON (one object per line), Parquet or Delta table.

    ``path`` is any URI that Spark's file systems know. CSV files have a header
    row; cells equal to one of ``na_tokens`` become null. Give a ``schema`` for
    large CSV or JSON inputs: without one, finding the types takes a pass over
    the data.

    Rows with more or fewer cells than the header, cells that do not fit their
    type, and lines that are no JSON object fail; ``lenient`` turns what is bad
    into nulls. Quoted CSV cells may hold line breaks. Files that are larger than
    ``spark.sql.files.maxPartitionBytes`` in all are read by many tasks all the same, see
    ``csv_records``, unless ``options`` holds more than a separator, a header and an
    encoding of UTF-8; then one task reads a file. ``multi_line=False`` saves looking
    for records in files without such cells. A torn cell then fails for its number of
    cells; in a table of one column, where it can't, ``multi_line`` stays on.
    """
    path = require_path(path)
    check_format(fmt)
    reader = spark.read.options(**dict(options or {}))
    if fmt == "csv":
        strict = {} if lenient else {"mode": "FAILFAST", "columnPruning": "false"}
        lines = {"multiLine": str(multi_line).lower()}
        chosen = {**CSV_OPTIONS, **strict, **lines, **dict(options or {})}
        return _read_csv(spark, chosen, path, schema, as_list(na_tokens), lenient)
    if fmt == "json" and not lenient:
        reader = reader.options(**{"mode": "FAILFAST", **dict(options or {})})
    if schema is not None:
        reader = reader.schema(schema)
    with connector_errors(fmt):
        return reader.format(fmt).load(path)


def _read_csv(
    spark: SparkSession, chosen: dict[str, Any], path: str, schema, tokens: list[str], lenient: bool
) -> DataFrame:
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    reader = spark.read.options(**chosen)
    names = reader.csv(path).columns if schema is None else schema.names
    if len(names) == 1 and "multiLine" in chosen:
        chosen = {**chosen, "multiLine": "true"}
    if _in_many_tasks(spark, chosen, path):
        texts = _split_texts(spark, chosen, path, names, schema is not None)
    else:
        # Compare the header with the schema rather than trust positions.
        as_text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        enforce = "true" if schema is None else "false"
        reader = spark.read.options(**chosen).option("enforceSchema", enforce)
        texts = reader.schema(as_text).csv(path)
    texts = _without_tokens(texts, tokens)
    types = _infer_types(texts) if schema is None else {f.name: f.dataType for f in schema.fields}
    return texts.select(*[_typed(n, types[n], lenient).alias(n) for n in texts.columns])


def _in_many_tasks(spark: SparkSession, chosen: dict[str, Any], path: str) -> bool:
    """Whether files with line breaks in cells are large, and of the plain kind whose
    records :mod:`csv_records` finds."""
    options = {k.lower(): str(v) for k, v in chosen.items()}
    plain = {"header", "quote", "escape", "mode", "columnpruning", "multiline", "sep", "delimiter", "encoding", "charset"}
    if options.get("multiline") != "true" or not options.keys() <= plain:
        return False
    if options["quote"] != '"' or options["escape"] != '"':
        return False
    if {options.get(k, "utf-8").lower() for k in ("encoding", "charset")} - {"utf-8", "utf8"}:
        return False
    size = estimated_bytes(spark.read.text(path))
    limit = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return size is not None and size > limit


def _split_texts(
    spark: SparkSession, chosen: dict[str, Any], path: str, names: list[str], check: bool
) -> DataFrame:
    options = {k.lower(): str(v) for k, v in chosen.items()}
    sep = options.get("sep", options.get("delimiter", ","))
    header = options.get("header") == "true"
    records = record_texts(spark, path, sep=sep, header=header, names=names if check else None)
    ddl = ", ".join(f"{quoted(n)} string" for n in names)
    parse = {k: str(v) for k, v in chosen.items() if k.lower() not in ("header", "encoding", "charset")}
    # Behind an explode, or the optimizer would parse only the columns that are used,
    # and no longer count the cells of a row.
    parsed = F.explode(F.array(F.from_csv("record", ddl, parse))).alias("r")
    return records.select(parsed).select(*[F.col("r")[n].alias(n) for n in names])


def _without_tokens(texts: DataFrame, tokens: list[str]) -> DataFrame:
    if not tokens:
        return texts
    return texts.select(
        *[F.when(~column(n).isin(tokens), column(n)).alias(n) for n in texts.columns]
    )


def _typed(name: str, dtype: T.DataType, lenient: bool) -> Column:
    if isinstance(dtype, T.StringType):
        return column(name)
    return column(name).try_cast(dtype) if lenient else column(name).cast(dtype)


def _infer_types(texts: DataFrame) -> dict[str, T.DataType]:
    """The narrowest of bigint, double, boolean and string that holds each column.

    One aggregate over the table, returning one row.
    """
    checks = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(texts.columns):
        c = column(name)
        whole = F.when(c.isNotNull(), c.rlike(_INTEGER) & c.try_cast("bigint").isNotNull())
        checks += [
            F.count(c).alias(f"n{i}"),
            F.bool_and(whole).alias(f"int{i}"),
            F.bool_and(c.rlike(_NUMBER)).alias(f"num{i}"),
            F.bool_and(F.lower(c).isin("true", "false")).alias(f"bool{i}"),
        ]
    found = texts.agg(*checks).first()
    types: dict[str, T.DataType] = {}
    for i, name in enumerate(texts.columns):
        if found[f"int{i}"]:
            types[name] = T.LongType()
        elif found[f"num{i}"] or (found["rows"] and not found[f"n{i}"]):
            # A column with nothing but missing cells counts as numeric.
            types[name] = T.DoubleType()
        elif found[f"bool{i}"]:
            types[name] = T.BooleanType()
        else:
            types[name] = T.StringType()
    return types
