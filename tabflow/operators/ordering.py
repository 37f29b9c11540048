"""Sort and limit."""

from __future__ import annotations

import weakref
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.expressions import as_list, column, hashable
from ..functions.skew import DEFAULT_SKEW, SkewPolicy, is_small, likely_hot

#: Of a sorted table that counts equal rows, the same sorted without that.
_PLAIN: weakref.WeakKeyDictionary[DataFrame, DataFrame] = weakref.WeakKeyDictionary()


def order_by(
    df: DataFrame, cols: str | Iterable[str], *, skew: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """Sort ascending by ``cols``, nulls first.

    Rows that tie are ordered by a hash of the whole row. Spark range-partitions
    on all sort keys, so a value that a large share of the rows has is spread over
    many tasks. Rows that are equal in every column are counted in large inputs, and the
    copies of one that has very many are numbered, see :func:`_numbered_copies`. The hash
    reads all columns of ``df``; filters on the result still reach the scan.
    """
    names = as_list(cols)
    if not names:
        return df
    tie = [F.xxhash64(*hashable(df))] if hashable(df) else []
    keys = [*[column(n) for n in names], *tie]
    if is_small(df, skew) or not all(_groups(f.dataType) for f in df.schema.fields):
        return df.orderBy(*keys)
    out = _numbered_copies(df, tie[0], skew).orderBy(*keys, "__copy").select(*map(column, df.columns))
    _PLAIN[out] = df.orderBy(*keys)
    return out


def _groups(kind: T.DataType) -> bool:
    """Whether equal values of a type can be counted as one without changing them."""
    if isinstance(kind, (T.ArrayType, T.StructType)):
        parts = [kind.elementType] if isinstance(kind, T.ArrayType) else [f.dataType for f in kind.fields]
        return all(_groups(p) and not isinstance(p, (T.FloatType, T.DoubleType)) for p in parts)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _numbered_copies(df: DataFrame, row: Column, skew: SkewPolicy) -> DataFrame:
    """``df`` with ``__copy``, by which the sort can cut rows that are equal apart.

    Rows of a hash that very many have are counted, which combines them before the
    shuffle, and made again from their counts, a piece of them in a task. Numbers of
    both signs of zero stay apart, as they are grouped by their texts.
    """
    marked = df.withColumn("__h", row)
    hot = F.broadcast(likely_hot(marked.select("__h"), skew))
    columns = [*map(column, df.columns), "__copy"]
    rest = marked.join(hot, "__h", "left_anti").withColumn("__copy", F.lit(0).cast("long"))
    same = [
        column(f.name).cast("string") if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else column(f.name)
        for f in df.schema.fields
    ]
    counted = (
        marked.join(hot, "__h")
        .groupBy("__unit", *[c.alias(f"__k{i}") for i, c in enumerate(same)])
        .agg(F.any_value(F.struct(*map(column, df.columns))).alias("__row"), F.count(F.lit(1)).alias("__n"))
    )
    pieces = counted.select(
        "__row", "__unit", "__n", F.explode(F.expr("sequence(0L, (__n - 1) div __unit)")).alias("__piece")
    ).repartition("__piece")
    numbers = F.expr("sequence(__piece * __unit, least(__n, (__piece + 1) * __unit) - 1)")
    copies = pieces.select("__row.*", F.explode(numbers).alias("__copy"))
    return rest.select(*columns).unionByName(copies)


def limit(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows; after ``order_by`` Spark plans it as one top-n, for which
    equal rows need not be counted."""
    return _PLAIN.get(df, df).limit(n)
