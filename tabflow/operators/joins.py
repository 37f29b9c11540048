"""Equi-joins."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import actual_name, as_list, column, name_folder
from ..functions.skew import DEFAULT_SKEW, SkewPolicy, fits, hot_groups, is_small

KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")

# The sides Spark can broadcast for each kind of join.
_BROADCASTABLE = {
    "inner": ("left", "right"),
    "left": ("right",),
    "right": ("left",),
    "full": (),
    "left_semi": ("right",),
    "left_anti": ("right",),
}


def join(
    df: DataFrame,
    other: DataFrame,
    on: str | Iterable[str],
    how: str = "left",
    *,
    skew: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Join on equally named keys; each key is in the result once.

    Null keys match nothing. Raises if the tables share a name that is no key.

    Small inputs, and joins in which Spark can broadcast a side, go to Catalyst
    as they are. So do large inner, semi and anti joins, of which adaptive
    execution splits hot keys from one read of each side. It can't split the right
    side of a left join, the left side of a right join, or a full join; hot keys
    there are joined apart, see :func:`_split_join`.
    """
    on = as_list(on)
    if how not in KINDS:
        raise ValueError(f"Unknown join {how!r}; known: {list(KINDS)}")
    if not on:
        raise ValueError("join needs at least one key")
    for key in on:
        actual_name(df, key), actual_name(other, key)
    half = how in ("left_semi", "left_anti")
    if not half:
        fold = name_folder(df)
        keys = {fold(k) for k in on}
        clash = ({fold(c) for c in df.columns} & {fold(c) for c in other.columns}) - keys
        if clash:
            raise ValueError(f"Both tables have {sorted(clash)}; rename or drop one of them")
    if half:
        other = other.select(*map(column, on))

    sides = {"left": df, "right": other}
    limit = _broadcast_limit(df) if skew.broadcast else -1
    if all(is_small(side, skew) for side in sides.values()) or any(
        fits(sides[s], limit) for s in _BROADCASTABLE[how]
    ):
        return df.join(other, on, how)
    if half:
        # A key's repeats on the right add nothing, and are combined before the shuffle.
        return df.join(other.distinct(), on, how)
    if how == "inner":
        return df.join(other, on, how)
    return _split_join(df, other, on, how, skew)


def _broadcast_limit(df: DataFrame) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes; -1 is never."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    digits = text.rstrip("bkmgtp")
    unit = text[len(digits) :].rstrip("b")
    return int(digits) * 1024 ** " kmgtp".index(unit or " ")


def _split_join(
    df: DataFrame, other: DataFrame, on: list[str], how: str, skew: SkewPolicy
) -> DataFrame:
    """Outer joins in which no task gets all rows of a hot key.

    Adaptive execution splits both sides of an inner join, but not the side of an outer
    join that may stay unmatched. Keys that are hot there are joined apart. Such a key
    does have rows on that side, so in a left or right join the rows of the other
    side all find partners, and an inner join of the two hot parts is the whole result.
    In a full join the hot keys are counted on both sides: those on one side alone are
    unmatched as they are, and so are null keys. All parts are plain joins that filters
    and column choices pass through.
    """
    result = df.join(other, on, how).schema

    def part(joined: DataFrame) -> DataFrame:
        fold = name_folder(joined)
        there = {fold(c): c for c in joined.columns}
        nothing = F.lit(None)
        return joined.select(
            *[
                (column(there[fold(f.name)]) if fold(f.name) in there else nothing)
                .cast(f.dataType)
                .alias(f.name)
                for f in result.fields
            ]
        )

    if how != "full":
        first, second = (df, other) if how == "left" else (other, df)
        hot = F.broadcast(_hot_keys(second, on, skew))
        cold = [side.join(hot, on, "left_anti") for side in (first, second)]
        of_hot = [side.join(hot, on, "left_semi") for side in (first, second)]
        return part(cold[0].join(cold[1], on, "left")).unionByName(part(of_hot[0].join(of_hot[1], on)))

    hot = _hot_keys_of_both(df, other, on, skew)
    shared = F.broadcast(hot.where("__left > 0 AND __right > 0").select(*map(column, on)))
    known = [_with_keys(side, on) for side in (df, other)]
    cold = [side.join(F.broadcast(hot.select(*map(column, on))), on, "left_anti") for side in known]
    of_hot = [side.join(shared, on, "left_semi") for side in known]
    no_key = functools.reduce(operator.or_, [column(k).isNull() for k in on])
    alone = []
    for side, partners in ((df, "__right"), (other, "__left")):
        lone = hot.where(f"{partners} = 0").select(*map(column, on), F.lit(True).alias("__lone"))
        rows = side.join(F.broadcast(lone), on, "left").where(no_key | F.col("__lone"))
        alone.append(part(rows.drop("__lone")))
    parts = [part(cold[0].join(cold[1], on, "full")), part(of_hot[0].join(of_hot[1], on)), *alone]
    return functools.reduce(DataFrame.unionByName, parts)


def _with_keys(df: DataFrame, on: list[str]) -> DataFrame:
    return df.where(functools.reduce(operator.and_, [column(k).isNotNull() for k in on]))


def _hot_keys(df: DataFrame, on: list[str], skew: SkewPolicy) -> DataFrame:
    """The keys that are hot in ``df``, for broadcasting."""
    keys = F.struct(*[column(k).alias(k) for k in on])
    return hot_groups(_with_keys(df, on), keys, skew).select("__g.*")


def _hot_keys_of_both(
    df: DataFrame, other: DataFrame, on: list[str], skew: SkewPolicy
) -> DataFrame:
    """The keys that are hot in one of the tables, with their rows in each, ``__left``
    and ``__right``; fewer than twice ``max_hot``."""
    hot = _hot_keys(df, on, skew).unionByName(_hot_keys(other, on, skew)).distinct()
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    names = [column(k).alias(k) for k in on]
    tagged = df.select(*names, one.alias("__left"), none.alias("__right")).unionByName(
        other.select(*names, none.alias("__left"), one.alias("__right"))
    )
    return (
        tagged.join(F.broadcast(hot), on, "left_semi")
        .groupBy(*map(column, on))
        .agg(F.sum("__left").alias("__left"), F.sum("__right").alias("__right"))
    )
