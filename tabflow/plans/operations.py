"""Applying an ordered list of operations to a table.

An operation is a dict: its name under ``"op"``, the rest its arguments.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame

from ..operators.aggregates import groupby_agg, groupby_reduce
from ..operators.columns import (
    add_column,
    drop,
    fillna,
    nan_to_null,
    rename,
    select,
    update_where,
    where,
    with_column,
    with_literal,
)
from ..operators.filters import filter_rows
from ..operators.joins import join
from ..operators.ordering import limit, order_by
from ..operators.setops import distinct, union, union_by_name
from ..operators.windows import window
from .staging import Staging

Tables = Mapping[str, DataFrame]


def _table(tables: Tables, alias: str) -> DataFrame:
    if alias not in tables:
        raise ValueError(f"Unknown table {alias!r}; known: {sorted(tables)}")
    return tables[alias]


def _frame(frame: str | Iterable[int]) -> tuple[int, int]:
    """Bounds given as two numbers or as ``"rowsBetween(-1, 1)"``."""
    if isinstance(frame, str):
        found = re.fullmatch(r"\s*rowsBetween\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)\s*", frame)
        if not found:
            raise ValueError(f"Unknown frame {frame!r}; expected rowsBetween(low, high)")
        return int(found[1]), int(found[2])
    low, high = frame
    return low, high


# Each takes the table, the other tables, and the operation's arguments.
OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "add_column": lambda df, _, name, value=None, now=None, as_string=False: add_column(
        df, name, value, now=now, as_string=as_string
    ),
    "withLiteral": lambda df, _, name, value, dtype=None: with_literal(df, name, value, dtype),
    "withColumnExpr": lambda df, _, name, expr: with_column(df, name, expr),
    "where": lambda df, _, name, cond, a, b: where(df, name, cond, a, b),
    "updateWhere": lambda df, _, mask, name, value: update_where(df, mask, name, value),
    "filter": lambda df, _, expr=None: filter_rows(df, expr),
    "select": lambda df, _, columns: select(df, columns),
    "drop": lambda df, _, columns: drop(df, columns),
    "rename": lambda df, _, mapping: rename(df, mapping),
    "fillna": lambda df, _, value, subset=None: fillna(df, value, subset),
    "nanToNull": lambda df, _, subset=None: nan_to_null(df, subset),
    "groupByAgg": lambda df, _, group_cols, aggs, **settings: groupby_agg(
        df, group_cols, aggs, **settings
    ),
    "groupByReduce": lambda df, _, group_cols, func, **settings: groupby_reduce(
        df, group_cols, func, **settings
    ),
    "orderBy": lambda df, _, cols: order_by(df, cols),
    "limit": lambda df, _, n: limit(df, n),
    "distinct": lambda df, _: distinct(df),
    "window": lambda df, _, partitionBy, orderBy, func, col, alias=None, frame=(-1, 1): window(
        df, partitionBy, orderBy, func=func, col=col, alias=alias, rows=_frame(frame)
    ),
    "join": lambda df, tables, target_alias, on, how="left": join(
        df, _table(tables, target_alias), on, how
    ),
    "union": lambda df, tables, target_alias: union(df, _table(tables, target_alias)),
    "unionByName": lambda df, tables, target_alias: union_by_name(
        df, _table(tables, target_alias)
    ),
}


def _check(number: int, op: Mapping[str, Any]) -> None:
    name = op.get("op")
    if name not in OPERATIONS:
        raise ValueError(f"Operation {number}: unknown op {name!r}; known: {sorted(OPERATIONS)}")
    arguments = {k: v for k, v in op.items() if k != "op"}
    try:
        inspect.signature(OPERATIONS[name]).bind(None, None, **arguments)
    except TypeError as error:
        raise ValueError(f"Operation {number} ({name}): {error}") from error


def apply_ops(
    df: DataFrame,
    ops: Iterable[Mapping[str, Any]],
    tables: Tables | None = None,
    *,
    staging: Staging | None = None,
) -> DataFrame:
    """Apply ``ops`` in list order; ``tables`` holds second inputs by alias.

    The whole list is checked before the first operation is applied, and the
    result is one lazy plan. With ``staging`` the inputs of operations that would read
    a shuffled or random table several times are written once; the caller removes
    them after the result was used.
    """
    ops, tables = list(ops), dict(tables or {})
    for number, op in enumerate(ops, 1):
        _check(number, op)
        if "target_alias" in op:
            _table(tables, op["target_alias"])
    for op in ops:
        arguments = {k: v for k, v in op.items() if k != "op"}
        if staging is not None:
            df = staging.before(op, df)
            if op["op"] == "join":
                other = op["target_alias"]
                tables[other] = staging.before(op, tables[other])
        df = OPERATIONS[op["op"]](df, tables, **arguments)
    return df


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """``df`` itself; raises if it lacks one of ``cols``."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns {missing}; columns are {df.columns}")
    return df
