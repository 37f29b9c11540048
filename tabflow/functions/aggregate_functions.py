"""Aggregate functions by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "avg": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "median": F.median,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "nunique": F.count_distinct,
    "size": lambda _: F.count(F.lit(1)),
}

# Rows have no position in Spark, so these follow an ordering column. Like a
# dataframe's first and last they skip missing values.
POSITIONAL: dict[str, Callable[[Column, Column], Column]] = {
    "first": F.min_by,
    "last": F.max_by,
}

REDUCERS = ("sum", "mean", "avg", "count", "min", "max", "median")
WINDOWED = ("sum", "mean", "avg", "count", "min", "max")


def check_function(func: str, allowed=None) -> None:
    allowed = [*AGGREGATES, *POSITIONAL] if allowed is None else allowed
    if func not in allowed:
        raise ValueError(f"Unknown aggregate function {func!r}; known: {sorted(allowed)}")


def aggregate(
    func: str,
    col: Column,
    *,
    order_col: Column | None = None,
    tie: Column | None = None,
    min_count0: bool = False,
) -> Column:
    """The aggregate ``func`` over ``col``.

    ``min_count0`` makes the sum of no values 0 instead of null. ``first`` and ``last``
    go by ``order_col``, then ``tie`` (the value itself, unless given), so that rows of
    equal order give one result whatever their partitions; a null order takes no part.
    """
    check_function(func)
    if func in POSITIONAL:
        if order_col is None:
            raise ValueError(f"{func!r} needs order_col: Spark rows have no position")
        place = F.struct(order_col, col if tie is None else tie)
        present = col.isNotNull() & order_col.isNotNull()
        return POSITIONAL[func](col, F.when(present, place))
    result = AGGREGATES[func](col)
    if func == "sum" and min_count0:
        result = F.coalesce(result, F.lit(0))
    return result


def is_ordered(kind: T.DataType) -> bool:
    """Whether Spark can order values of a type."""
    if isinstance(kind, T.StructType):
        return all(is_ordered(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return is_ordered(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))
