"""Small helpers that build column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> str:
    """``name`` in backticks, so dots and spaces in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column called exactly ``name``."""
    return F.col(quoted(name))


def condition(cond: str | Column) -> Column:
    """A predicate given as Spark SQL text or as a ``Column``."""
    return F.expr(cond) if isinstance(cond, str) else cond


def literal(value: Any) -> Column:
    """``value`` as a constant; a ``Column`` passes through.

    A bare ``None`` is typed as string, since an untyped null column cannot be
    written to Parquet or CSV.
    """
    if isinstance(value, Column):
        return value
    return F.lit(None).cast("string") if value is None else F.lit(value)


def differs(left: str | Column, right: Any) -> Column:
    """Null-safe ``!=``: true when exactly one side is null, never null itself."""
    left = column(left) if isinstance(left, str) else left
    return ~left.eqNullSafe(right)


def as_list(names: str | Iterable[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def group_struct(names: Sequence[str]) -> Column:
    """All of ``names`` packed in one never-null column.

    Two such structs are equal when their fields are, nulls included, so it can
    be a join, grouping and window key that keeps null groups.
    """
    return F.struct(*[column(n) for n in names]) if names else F.struct(F.lit(0).alias("all"))


def hashable(df: DataFrame, names: Iterable[str] | None = None) -> list[Column]:
    """Columns of ``df`` that ``xxhash64`` accepts."""

    def has_map(dtype: T.DataType) -> bool:
        if isinstance(dtype, T.ArrayType):
            return has_map(dtype.elementType)
        if isinstance(dtype, T.StructType):
            return any(has_map(f.dataType) for f in dtype.fields)
        return isinstance(dtype, (T.MapType, T.VariantType))

    wanted = None if names is None else set(names)
    return [
        column(f.name)
        for f in df.schema.fields
        if (wanted is None or f.name in wanted) and not has_map(f.dataType)
    ]


def name_folder(df: DataFrame):
    """Maps a column name to the form in which Spark compares names."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    return (lambda n: n) if exact else str.lower


def actual_name(df: DataFrame, name: str) -> str:
    """The spelling ``df`` uses for ``name``; raises if there is no such column."""
    fold = name_folder(df)
    for candidate in df.columns:
        if fold(candidate) == fold(name):
            return candidate
    raise ValueError(f"Unknown column {name!r}; columns are {df.columns}")


def check_unique(df: DataFrame, names: Iterable[str], what: str) -> None:
    """Raise when two of ``names`` are the same column name to Spark."""
    fold = name_folder(df)
    seen: set[str] = set()
    for name in names:
        if fold(name) in seen:
            raise ValueError(f"{what} gives two columns named {name!r}")
        seen.add(fold(name))
