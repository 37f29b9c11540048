"""Adding, computing, updating, choosing, renaming and filling columns."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from datetime import datetime, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.expressions import (
    actual_name,
    as_list,
    check_unique,
    column,
    condition,
    literal,
    name_folder,
    quoted,
)

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _time_column(now: datetime | str | None, as_string: bool) -> Column:
    if now is None:
        if not as_string:
            return F.current_timestamp()
        utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
        return F.concat(F.date_format(utc, ISO_MICROS), F.lit("+00:00"))
    moment = datetime.fromisoformat(now) if isinstance(now, str) else now
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    moment = moment.astimezone(timezone.utc)
    if as_string:
        return F.lit(moment.isoformat(timespec="microseconds"))
    return F.timestamp_micros(F.lit(_epoch_micros(moment)))


def _epoch_micros(moment: datetime) -> int:
    delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def add_column(
    df: DataFrame,
    name: str,
    value: Any = None,
    *,
    now: datetime | str | None = None,
    as_string: bool = False,
) -> DataFrame:
    """Add a constant column; a ``None`` or empty value means the current time.

    ``now`` pins that time (a naive one counts as UTC). ``as_string`` gives it as
    ISO-8601 text in UTC instead of a timestamp.
    """
    if value is None or (isinstance(value, str) and value == ""):
        return df.withColumn(name, _time_column(now, as_string))
    return df.withColumn(name, F.lit(value))


def with_literal(df: DataFrame, name: str, value: Any, dtype: str | None = None) -> DataFrame:
    """Set ``name`` to a constant, null and negative ones included."""
    constant = literal(value)
    return df.withColumn(name, constant if dtype is None else constant.cast(dtype))


def with_column(df: DataFrame, name: str, expr: str | Column) -> DataFrame:
    """Set ``name`` to an expression, given as Spark SQL text or as a ``Column``."""
    return df.withColumn(name, condition(expr))


def with_columns(df: DataFrame, exprs: Mapping[str, str | Column]) -> DataFrame:
    """Set several columns in one projection, all from the input's values."""
    return df.withColumns({name: condition(e) for name, e in exprs.items()})


def where(df: DataFrame, name: str, cond: str | Column, a: Any, b: Any) -> DataFrame:
    """Set ``name`` to ``a`` where ``cond`` holds, else (also if null) to ``b``."""
    return df.withColumn(name, F.when(condition(cond), literal(a)).otherwise(literal(b)))


def update_where(df: DataFrame, mask: str | Column, name: str, value: Any) -> DataFrame:
    """Overwrite ``name`` with ``value`` where ``mask`` holds.

    A column that does not exist yet is null elsewhere.
    """
    fold = name_folder(df)
    fields = {fold(f.name): f for f in df.schema.fields}
    field = fields.get(fold(name))
    updated = F.when(condition(mask), literal(value))
    if field is not None:
        if not isinstance(value, Column) and value is not None:
            is_text = isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType))
            plain_number = isinstance(field.dataType, (T.NumericType, T.BooleanType))
            if (is_text and not isinstance(value, str)) or (
                plain_number and isinstance(value, str)
            ):
                raise TypeError(
                    f"Cannot put {value!r} into column {field.name!r} of type "
                    f"{field.dataType.simpleString()}; cast one of them first"
                )
        if value is None:
            updated = F.when(condition(mask), F.lit(None))
        updated = updated.otherwise(column(field.name))
    return df.withColumn(field.name if field is not None else name, updated)


def select(df: DataFrame, columns: str | Iterable[str | Column]) -> DataFrame:
    """Keep ``columns``, in that order."""
    wanted = [columns] if isinstance(columns, (str, Column)) else list(columns)
    return df.select(*[column(c) if isinstance(c, str) else c for c in wanted])


def drop(df: DataFrame, columns: str | Iterable[str]) -> DataFrame:
    """Remove ``columns``; names the table lacks are ignored."""
    return df.drop(*as_list(columns))


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename all of ``mapping`` at once, so names may be swapped.

    Names the table lacks are ignored. Raises if two columns would end up with
    one name.
    """
    fold = name_folder(df)
    targets = {fold(old): new for old, new in mapping.items()}
    renamed = [targets.get(fold(c), c) for c in df.columns]
    check_unique(df, renamed, "rename")
    return df.toDF(*renamed)


_LARGEST_FLOAT = (2 - 2**-23) * 2.0**127
# Bits of each integral type, sign included.
_INTEGRAL_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _fill_problem(value: Any, dtype: T.DataType) -> str | None:
    """Why ``value`` cannot fill a ``dtype`` column, "type" if of another kind."""
    if isinstance(value, bool):
        return None if isinstance(dtype, T.BooleanType) else "type"
    if isinstance(value, str):
        return None if isinstance(dtype, T.StringType) else "type"
    if not isinstance(dtype, T.NumericType):
        return "type"
    if isinstance(dtype, T.DecimalType):
        if isinstance(value, float) and not math.isfinite(value):
            return "is out of range"
        exact = Decimal(str(value))
        if abs(exact) >= Decimal(10) ** (dtype.precision - dtype.scale):
            return "is out of range"
        return None if exact == round(exact, dtype.scale) else "would be truncated"
    if isinstance(dtype, T.FloatType):
        fits = not math.isfinite(value) or abs(value) <= _LARGEST_FLOAT
        return None if fits else "is out of range"
    bits = _INTEGRAL_BITS.get(type(dtype))
    if bits is None:
        return None
    if isinstance(value, float) and (not math.isfinite(value) or value != int(value)):
        return "would be truncated"
    if not -(2 ** (bits - 1)) <= value < 2 ** (bits - 1):
        return "is out of range"
    return None


def fillna(
    df: DataFrame,
    value: str | int | float | bool | None,
    subset: str | Iterable[str] | None = None,
) -> DataFrame:
    """Replace missing values (null and NaN) in ``subset``, or in all columns.

    ``None`` changes nothing. Only columns of the value's kind are filled. Raises
    when a named column is of another kind or absent, and whenever the value does
    not fit a column it would fill.
    """
    if value is None:
        return df
    if not isinstance(value, (str, int, float, bool)):
        raise TypeError(f"Cannot fill with {value!r}")
    named = [actual_name(df, n) for n in as_list(subset)]
    targets = []
    for field in df.schema.fields:
        if named and field.name not in named:
            continue
        problem = _fill_problem(value, field.dataType)
        if problem == "type" and not named:
            continue
        if problem:
            reason = "is of another type" if problem == "type" else problem
            raise ValueError(
                f"Fill value {value!r} {reason} for column {field.name!r} "
                f"({field.dataType.simpleString()})"
            )
        targets.append(field.name)
    return df.fillna(value, subset=[quoted(t) for t in targets]) if targets else df


def nan_to_null(df: DataFrame, subset: str | Iterable[str] | None = None) -> DataFrame:
    """Make NaN in float and double columns a null, so it counts as missing."""
    named = {actual_name(df, n) for n in as_list(subset)}
    floats = {
        f.name: F.when(~F.isnan(column(f.name)), column(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (not named or f.name in named)
    }
    return df.withColumns(floats) if floats else df
