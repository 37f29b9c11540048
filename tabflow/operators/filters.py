"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions.expressions import condition


def filter_rows(df: DataFrame, cond: str | Column | None) -> DataFrame:
    """Keep rows where ``cond`` is true; a missing or blank one keeps all.

    Text is a Spark SQL predicate: ``==`` works like ``=``, odd names go in
    backticks, lists are written ``IN (...)``. A comparison with null is null
    and drops the row; ``NOT (a <=> b)`` or ``differs(a, b)`` is the comparison
    that keeps it.
    """
    if cond is None or (isinstance(cond, str) and not cond.strip()):
        return df
    return df.filter(condition(cond))
