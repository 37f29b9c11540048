"""Grouped aggregation."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.aggregate_functions import (
    POSITIONAL,
    REDUCERS,
    aggregate,
    check_function,
    is_ordered,
)
from ..functions.expressions import (
    actual_name,
    as_list,
    check_unique,
    column,
    group_struct,
    literal,
    name_folder,
)
from ..functions.skew import (
    DEFAULT_SKEW,
    SkewPolicy,
    bucket_starts,
    hot_of_counts,
    is_small,
    with_range_bucket,
)


def _expand(aggs: Any) -> list[Mapping[str, Any] | Column]:
    """The aggregates as a list of ``{"func", "col", "alias"}`` or columns."""
    if isinstance(aggs, Mapping):
        return [
            {"func": func, "col": col, "alias": f"{func}_{col}"}
            for col, funcs in aggs.items()
            for func in as_list(funcs)
        ]
    specs: list[Mapping[str, Any] | Column] = []
    for agg in aggs:
        if isinstance(agg, Column):
            specs.append(agg)
            continue
        unknown = set(agg) - {"func", "col", "alias", "order_col"}
        if unknown or not {"func", "col"} <= set(agg):
            raise ValueError(f"An aggregate needs func and col, and may have alias: {dict(agg)}")
        specs.append({**agg, "alias": agg.get("alias") or f"{agg['func']}_{agg['col']}"})
    return specs


def groupby_agg(
    df: DataFrame,
    keys: str | Iterable[str] | None,
    aggs: Mapping[str, str | Iterable[str]] | Iterable[Mapping[str, Any] | Column] | None,
    *,
    dropna: bool = False,
    min_count0: bool = False,
    order_col: str | None = None,
    skew: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Group by ``keys`` and aggregate, with flat names ``func_col``.

    ``aggs`` is ``{"amount": ["sum", "mean"], "id": "count"}``, or a list of
    ``{"func", "col", "alias"}`` and of aliased aggregate columns. Without keys
    or aggregates the table comes back as it is. Null keys form groups unless
    ``dropna``. ``min_count0`` makes an empty sum 0. ``first`` and ``last`` follow
    ``order_col``, which a list item may set for itself; of rows with equal order the
    first has the least value and the last the greatest, however rows are dealt out.
    The median of a column is split in large inputs also when given as a column; other
    columns with a median or percentile in them raise there.
    """
    keys = as_list(keys)
    if not keys or not aggs:
        return df
    specs = _expand(aggs)
    for spec in specs:
        if not isinstance(spec, Column):
            check_function(spec["func"])
    check_unique(
        df, keys + [s["alias"] for s in specs if not isinstance(s, Column)], "groupby_agg"
    )
    if dropna:
        df = df.dropna(subset=[f"`{k}`" for k in keys])

    if any(isinstance(s, Column) or s["func"] == "median" for s in specs):
        small = is_small(df, skew)
        specs = specs if small else _named_medians(df, specs)
        medians = [s for s in specs if not isinstance(s, Column) and s["func"] == "median"]
        _check_numeric(df, [s["col"] for s in medians])
        used = list(dict.fromkeys(s["col"] for s in medians))
        if medians and not small:
            return _with_split_medians(df, keys, specs, used, min_count0, order_col, skew)
    built = [_build(df, s, min_count0, order_col) for s in specs]
    return df.groupBy(*map(column, keys)).agg(*built)


def groupby_reduce(
    df: DataFrame,
    keys: str | Iterable[str] | None,
    func: str,
    *,
    dropna: bool = False,
    min_count0: bool = False,
    skew: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Apply one reducer to all numeric columns but the keys, keeping their names."""
    check_function(func, REDUCERS)
    keys = as_list(keys)
    if not keys:
        return df
    fold = name_folder(df)
    held = {fold(k) for k in keys}
    numeric = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and fold(f.name) not in held
    ]
    if not numeric:
        groups = df.select(*map(column, keys)).distinct()
        return groups.dropna(subset=[f"`{k}`" for k in keys]) if dropna else groups
    return groupby_agg(
        df,
        keys,
        [{"func": func, "col": c, "alias": c} for c in numeric],
        dropna=dropna,
        min_count0=min_count0,
        skew=skew,
    )


def _build(
    df: DataFrame, spec: Mapping[str, Any] | Column, min_count0: bool, order_col: str | None
) -> Column:
    if isinstance(spec, Column):
        return spec
    order = spec.get("order_col") or order_col
    tie = None
    if spec["func"] in POSITIONAL:
        kind = df.schema[actual_name(df, spec["col"])].dataType
        # Values that have no order among themselves are told apart as texts.
        tie = column(spec["col"]) if is_ordered(kind) else F.to_json(F.struct(column(spec["col"])))
    return aggregate(
        spec["func"],
        column(spec["col"]) if spec["func"] != "size" else literal(1),
        order_col=None if order is None else column(order),
        tie=tie,
        min_count0=min_count0,
    ).alias(spec["alias"])


def _check_numeric(df: DataFrame, names: Iterable[str]) -> None:
    for name in names:
        field = df.schema[actual_name(df, name)]
        if not isinstance(field.dataType, T.NumericType):
            raise TypeError(
                f"median needs a numeric column; {field.name!r} is {field.dataType.simpleString()}"
            )


def _with_split_medians(
    df: DataFrame,
    keys: list[str],
    specs: list[Mapping[str, Any] | Column],
    used: list[str],
    min_count0: bool,
    order_col: str | None,
    skew: SkewPolicy,
) -> DataFrame:
    """All of ``specs``, with the medians computed by :func:`_split_medians`."""
    others = [
        _build(df, s, min_count0, order_col)
        for s in specs
        if isinstance(s, Column) or s["func"] != "median"
    ]
    # Groups whose values are all missing are in base only.
    base = df.groupBy(group_struct(keys).alias("__g")).agg(
        F.count(F.lit(1)).alias("__rows"), *others
    )
    joined = base.join(_split_medians(df, keys, used, skew), "__g", "left")
    output = [F.col("__g")[k].alias(k) for k in keys]
    names = iter(base.columns[2:])
    for spec in specs:
        if not isinstance(spec, Column) and spec["func"] == "median":
            output.append(F.col(f"__m{used.index(spec['col'])}").alias(spec["alias"]))
        else:
            output.append(column(next(names)))
    return joined.select(*output)


def _split_medians(
    df: DataFrame, keys: list[str], cols: list[str], skew: SkewPolicy
) -> DataFrame:
    """Exact medians of ``cols`` per group, as ``__g, __m0, __m1, ...``.

    Spark's own median keeps all distinct values of a group in one buffer. Here the
    input is read once, to count the rows of each value of a group; all else is made
    from those counts, of which Spark keeps one shuffle. Groups with many values are
    cut into value ranges, and of these only the ranges that hold the middle one or
    two values are sorted: the rows of earlier ranges are added up.
    """
    values = F.array(
        *[
            F.struct(F.lit(i).alias("__i"), column(c).cast("double").alias("__v"))
            for i, c in enumerate(cols)
        ]
    )
    counted = (
        df.select(group_struct(keys).alias("__k"), F.explode(values).alias("__x"))
        .where("__x.__v IS NOT NULL")
        .groupBy(F.struct("__k", "__x.__i").alias("__g"), F.col("__x.__v").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    sizes = counted.groupBy("__g").agg(F.count(F.lit(1)).alias("__rows"))
    hot = F.broadcast(hot_of_counts(sizes, skew).drop("__rows"))
    # An outer join, as the optimizer would move an anti join below the counting, which
    # then were no longer the same for both.
    whole = counted.join(hot, "__g", "left").where("__unit IS NULL").drop("__unit")
    split = with_range_bucket(counted.join(hot, "__g"), [F.col("__v")], skew).drop("__unit")
    starts = bucket_starts(split, F.sum("__c"))
    middle = "__start + __n > (__total - 1) div 2 AND __start <= __total div 2"
    # Two buckets of a hot group at most.
    near = split.join(F.broadcast(starts.where(middle).drop("__n")), ["__g", "__bucket"])
    rows = whole.withColumns(
        {"__bucket": F.lit(-1), "__start": F.lit(0).cast("long"), "__total": F.lit(None).cast("long")}
    ).unionByName(near)

    part = Window.partitionBy("__g", "__bucket")
    upto = F.sum("__c").over(part.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumns({"__upto": upto, "__in_part": F.sum("__c").over(part)}).withColumns(
        {"__end": F.col("__start") + F.col("__upto"), "__all": F.coalesce("__total", "__in_part")}
    )

    def covers(position: Column) -> Column:
        return (F.col("__end") - F.col("__c") <= position) & (position < F.col("__end"))

    low, high = covers(F.expr("(__all - 1) div 2")), covers(F.expr("__all div 2"))
    middle = placed.where(low | high).select(
        F.col("__g")["__k"].alias("__k"),
        F.col("__g")["__i"].alias("__i"),
        F.when(low, F.col("__v")).alias("__low"),
        F.when(high, F.col("__v")).alias("__high"),
    )
    return middle.groupBy(F.col("__k").alias("__g")).agg(
        *[
            (
                F.max(F.when(F.col("__i") == i, F.col("__low"))) * 0.5
                + F.max(F.when(F.col("__i") == i, F.col("__high"))) * 0.5
            ).alias(f"__m{i}")
            for i in range(len(cols))
        ]
    )


def _named_medians(df: DataFrame, specs: list) -> list:
    """``specs`` with each aggregate column that is the median of a column of ``df`` as an
    item of the list; columns with other medians or percentiles in them raise, as Spark
    holds all values of a group for them in one buffer."""
    out = []
    for spec in specs:
        if not isinstance(spec, Column):
            out.append(spec)
            continue
        text = str(spec._jc.toString())
        plain = re.fullmatch(r"median\(`?([^`()]+)`?\)(?: AS `?([^`]+)`?)?", text, re.IGNORECASE)
        if plain and name_folder(df)(plain[1]) in map(name_folder(df), df.columns):
            out.append({"func": "median", "col": plain[1], "alias": plain[2] or f"median({plain[1]})"})
        elif re.search(r"\b(median|percentile|percentile_cont|percentile_disc|mode)\(", text, re.IGNORECASE):
            raise ValueError(f"Give the median of a large input as func and col, not as {text}")
        else:
            out.append(spec)
    return out
