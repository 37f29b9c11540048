"""Union and distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from ..functions.expressions import name_folder


def _family(dtype: T.DataType) -> object:
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return dtype


def _check_pair(left: T.StructField, right: T.StructField) -> None:
    loose = (T.NullType,)
    if isinstance(left.dataType, loose) or isinstance(right.dataType, loose):
        return
    if _family(left.dataType) != _family(right.dataType):
        raise TypeError(
            f"Cannot union {left.name!r} ({left.dataType.simpleString()}) with "
            f"{right.name!r} ({right.dataType.simpleString()}); cast one of them first"
        )


def union(df: DataFrame, other: DataFrame) -> DataFrame:
    """All rows of both tables, columns matched by position.

    Raises when columns of different kinds meet, which Spark would cast.
    """
    if len(df.columns) != len(other.columns):
        raise ValueError(f"Cannot union {len(df.columns)} columns with {len(other.columns)}")
    for left, right in zip(df.schema.fields, other.schema.fields):
        _check_pair(left, right)
    return df.union(other)


def union_by_name(df: DataFrame, other: DataFrame) -> DataFrame:
    """All rows of both tables, columns matched by name."""
    fold = name_folder(df)
    left = {fold(f.name): f for f in df.schema.fields}
    right = {fold(f.name): f for f in other.schema.fields}
    if left.keys() != right.keys():
        raise ValueError(
            f"Cannot union by name: only one side has {sorted(left.keys() ^ right.keys())}"
        )
    for name, field in left.items():
        _check_pair(field, right[name])
    return df.unionByName(other)


def distinct(df: DataFrame) -> DataFrame:
    """Rows without repeats. Copies are combined before the shuffle."""
    return df.distinct()
