"""Aggregates over a moving frame of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.aggregate_functions import WINDOWED, aggregate, check_function
from ..functions.expressions import as_list, check_unique, column, group_struct, hashable, name_folder
from ..functions.skew import (
    DEFAULT_SKEW,
    SkewPolicy,
    bucket_starts,
    is_small,
    likely_hot,
    whole_table_unit,
    with_range_bucket,
)

#: A frame's end from here on has no bound.
NO_BOUND = Window.unboundedFollowing
#: The frame of all rows of a partition.
EVERYTHING = (Window.unboundedPreceding, Window.unboundedFollowing)
#: Rows of a frame from which it is put together from the aggregates of blocks.
WIDE = 64


@dataclass(frozen=True)
class _Added:
    """A column that a window adds: ``func`` of ``col``, under the name ``alias``."""

    func: str
    col: str
    alias: str
    kind: T.DataType
    exact: bool
    """See :func:`_adds_exactly`."""
    to_double: bool
    """Whether a mean adds up doubles that the column's values have to be made first."""

    def result(self) -> Column:
        return aggregate(self.func, column(self.col))


#: Adds columns over one frame to a share of a table's rows.
_Share = Callable[[list[_Added]], DataFrame]


@dataclass(frozen=True)
class _Chain:
    """Windows that follow each other over one frame: the input of the first, and what they add."""

    source: DataFrame
    frame: tuple
    added: tuple[_Added, ...]
    shares: dict[bool, list[_Share]]
    """The shares of ``source`` for exact columns and for others, made once for all windows."""


#: The chains whose results are still in use.
_CHAINS: WeakKeyDictionary[DataFrame, _Chain] = WeakKeyDictionary()


def window(
    df: DataFrame,
    partition_by: str | Iterable[str] | None,
    order_by: str | Iterable[str],
    *,
    func: str,
    col: str,
    alias: str | None = None,
    rows: tuple[int, int] = (-1, 1),
    skew: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Add ``func`` of ``col`` over the frame ``rowsBetween(*rows)``.

    ``order_by`` should be unique within a partition: Spark orders tied rows
    arbitrarily, and only a total order can be cut anywhere. Partitions too
    large for one task are cut into blocks, see :func:`_split_frames`,
    :func:`_block_frames` for long frames, and :func:`_split_open_frames`. In frames
    without an end only sums and means of decimals with 38 digits and many of them after
    the point are not: adding partial sums could round them, see :func:`_adds_exactly`.
    Column names that begin with two underscores raise.

    A window over the result of another one with the same partitions, order, frame and
    skew is computed together with it from the input of both: the plan reads that as
    often as for one of them, and places and sorts the rows once for all. That part of
    the plan is made by the first window and taken over by the others.
    """
    check_function(func, WINDOWED)
    parts, order = as_list(partition_by), as_list(order_by)
    if not order:
        raise ValueError("window needs order_by columns")
    low, high = (int(r) for r in rows)
    if low > high:
        raise ValueError(f"Empty frame: {rows}")
    alias = alias or f"{func}_{col}"
    check_unique(df, [c for c in df.columns] + [alias], "window")
    reserved = [c for c in (*df.columns, alias) if c.startswith("__")]
    if reserved:
        raise ValueError(f"Reserved column names: {reserved}")

    frame = (tuple(parts), tuple(order), low, high, skew)
    chain = _CHAINS.get(df)
    fold = name_folder(df)
    if chain is None or chain.frame != frame or fold(col) in (fold(x.alias) for x in chain.added):
        chain = _Chain(df, frame, (), {})
    added = (*chain.added, _added(df, func, col, alias))
    result = chain.source
    # Sums that must stay in one task are computed after the others.
    for exact in (True, False):
        some = [x for x in added if x.exact == exact]
        if some:
            first = result is chain.source
            shares = chain.shares.get(exact) if first else None
            if shares is None:
                shares = _shares(result, parts, order, exact, low, high, skew)
                if first:
                    chain.shares[exact] = shares
            output = [*map(column, result.columns), *[column(x.alias) for x in some]]
            result = reduce(DataFrame.union, [share(some).select(*output) for share in shares])
    if result.columns != [*df.columns, alias]:
        result = result.select(*map(column, df.columns), column(alias))
    _CHAINS[result] = _Chain(chain.source, frame, added, chain.shares)
    return result


def _added(df: DataFrame, func: str, col: str, alias: str) -> _Added:
    value = df.select(column(col)).schema[0].dataType
    kind = df.select(aggregate(func, column(col)).alias(alias)).schema[0].dataType
    to_double = func in ("mean", "avg") and isinstance(kind, T.DoubleType) and not isinstance(value, T.DoubleType)
    return _Added(func, col, alias, kind, _adds_exactly(df, func, col), to_double)


def _shares(
    df: DataFrame,
    parts: list[str],
    order: list[str],
    exact: bool,
    low: int,
    high: int,
    skew: SkewPolicy,
) -> list[_Share]:
    """The shares of the rows of ``df`` that a frame's columns are added to apart.

    All of these columns are ``exact`` or none, see :func:`_adds_exactly`. What doesn't
    depend on them, such as the rows' positions, is planned here.
    """
    sort = [column(o) for o in order]
    plain = Window.partitionBy(*map(column, parts)).orderBy(*sort).rowsBetween(low, high)
    unbounded = low <= -NO_BOUND or high >= NO_BOUND
    wide = not unbounded and high - low >= WIDE and exact

    def whole_partitions(rows: DataFrame) -> _Share:
        if not wide:
            return lambda added: rows.withColumns({x.alias: x.result().over(plain) for x in added})
        by = Window.partitionBy(*map(column, parts))
        ordered = by.orderBy(*sort)
        placed = rows.withColumns(
            {
                "__pos": F.row_number().over(ordered) - F.lit(1).cast("long"),
                "__last": F.count(F.lit(1)).over(ordered.rowsBetween(*EVERYTHING)) - 1,
            }
        )
        return lambda added: _block_frames(placed, parts, added, low, high)

    if is_small(df, skew) or unbounded and not exact:
        return [whole_partitions(df)]

    grouped = df.withColumn("__g", group_struct(parts))
    tie = F.xxhash64(*hashable(df)) if hashable(df) else F.lit(0)

    def split(rows: DataFrame) -> _Share:
        if low <= -NO_BOUND and high >= NO_BOUND:
            totals = rows.groupBy("__g")
            return lambda added: rows.join(totals.agg(*[x.result().alias(x.alias) for x in added]), "__g")
        placed = _placed(rows, sort, tie, skew)
        if unbounded:
            return lambda added: _split_open_frames(placed, added, low, high)
        if not wide:
            copied = _copied(placed, low, high)
            return lambda added: _split_frames(copied, added, low, high)
        unit = F.greatest("__unit", F.lit(4 * (max(high, 0) + max(-low, 0))).cast("long"))
        copied = _copied(placed.withColumn("__unit", unit), low, high)
        # The last position that has been copied to the block, as in _copied.
        copied = copied.withColumn("__last", F.expr(f"least(__total, (__block + 1) * __unit + {max(high, 0)}L) - 1"))
        # Without partitions __g is a literal, which Catalyst leaves out of some of these keys.
        by = ["__g", "__block"] if parts else ["__block"]
        copied = copied.repartition(*by)
        own = "__block = __pos div __unit"
        return lambda added: _block_frames(copied, by, added, low, high).where(own)

    if not parts:
        return [split(grouped.withColumn("__unit", whole_table_unit(df, skew)))]
    grouped = grouped.withColumn("__h", F.xxhash64("__g"))
    hot = F.broadcast(likely_hot(grouped.select("__h"), skew))
    whole = whole_partitions(grouped.join(hot, "__h", "left_anti"))
    return [whole, split(grouped.join(hot, "__h").drop("__h"))]


def _adds_exactly(df: DataFrame, func: str, col: str) -> bool:
    """Whether the aggregates of two parts of ``col`` give that of both without rounding.

    Two decimals of 38 digits add to one that keeps no more than six of them after the
    point, and their sum divided by a count has six.
    """
    if func not in ("sum", "mean", "avg"):
        return True
    kind = df.select(F.sum(column(col)).alias("s")).schema[0].dataType
    if not isinstance(kind, T.DecimalType) or kind.precision < 38:
        return True
    return kind.scale <= (6 if func == "sum" else 2)


def _placed(rows: DataFrame, sort: list[Column], tie: Column, skew: SkewPolicy) -> DataFrame:
    """Add each row's position in its partition, ``__pos``, and the partition's
    ``__total``, from the row counts of the ranges before its own. Tied rows are told
    apart by ``tie``, a hash of the row; only rows equal in all columns can't be cut
    apart.
    """
    keys = {f"__o{i}": s for i, s in enumerate(sort)} | {"__o": tie}
    names = [F.col(k) for k in keys]
    bucketed = with_range_bucket(rows.withColumns(keys), names, skew)
    nth = F.row_number().over(Window.partitionBy("__g", "__bucket").orderBy(*names))
    return (
        bucketed.withColumn("__nth", nth)
        .join(bucket_starts(bucketed).drop("__n"), ["__g", "__bucket"])
        .withColumn("__pos", F.col("__start") + F.col("__nth") - 1)
        .drop("__bucket", "__nth", "__start", *keys)
    )


def _split_frames(copied: DataFrame, added: list[_Added], low: int, high: int) -> DataFrame:
    """The frame aggregates for hot partitions, each cut into blocks of rows.

    Blocks of ``__unit`` positions are windowed apart; a row has been copied to the
    blocks in whose frames it takes part, and each block returns only its own rows.
    """
    frame = Window.partitionBy("__g", "__block").orderBy("__pos").rowsBetween(low, high)
    framed = copied.withColumns({x.alias: x.result().over(frame) for x in added})
    return framed.where("__block = __pos div __unit")


def _copied(placed: DataFrame, low: int, high: int) -> DataFrame:
    """A row for each ``__block`` of ``__unit`` positions in whose frames it takes part."""
    before, after = max(high, 0), max(-low, 0)
    # No further than the partition's first and last block, however wide the frame is.
    first = F.expr(f"greatest(0L, __pos - {before}L) div __unit")
    last = F.expr(f"least(__total - 1, __pos + {after}L) div __unit")
    return placed.withColumn("__block", F.explode(F.sequence(first, last)))


@dataclass(frozen=True)
class _Part:
    """What is aggregated of a part of a frame; a mean has two of them."""

    func: str
    col: str
    to_double: bool = False

    def result(self) -> Column:
        value = column(self.col)
        return aggregate(self.func, value.cast("double") if self.to_double else value)

    @property
    def merge(self) -> str:
        """How the aggregates of two parts become one."""
        return "sum" if self.func == "count" else self.func


def _parts_of(x: _Added) -> list[_Part]:
    if x.func in ("mean", "avg"):
        return [_Part("sum", x.col, x.to_double), _Part("count", x.col)]
    return [_Part(x.func, x.col)]


def _partials(added: list[_Added]) -> dict[str, _Part]:
    """The parts of all ``added`` columns, each once, by the name of its column."""
    return {f"__a{i}": p for i, p in enumerate(dict.fromkeys(p for x in added for p in _parts_of(x)))}


def _results(added: list[_Added], parts: dict[str, _Part], total: Callable[[str], str]) -> dict[str, Column]:
    """The ``added`` columns from the totals of their parts, which are SQL."""
    names = {p: c for c, p in parts.items()}

    def found(x: _Added) -> Column:
        a, *n = (total(names[p]) for p in _parts_of(x))
        return F.expr(f"CASE WHEN {n[0]} > 0 THEN {a} / {n[0]} END" if n else a).cast(x.kind)

    return {x.alias: found(x) for x in added}


def _merged(how: str, a: str, b: str) -> str:
    """The aggregate of two parts of a frame, either of which may have none."""
    if how in ("min", "max"):
        return f"{'least' if how == 'min' else 'greatest'}({a}, {b})"
    return f"coalesce({a} + {b}, {a}, {b})"


def _block_frames(
    rows: DataFrame, by: list[str], added: list[_Added], low: int, high: int
) -> DataFrame:
    """Frames of many rows with as much work per row as frames of a few.

    ``rows`` has positions without gaps, ``__pos``, within the groups of ``by``, the last of
    them as ``__last``, and has been shuffled by ``by``, which all windows here use. They are
    cut into blocks as long as a frame, so a frame is the end of one block and the
    beginning of the next; both come from running aggregates of the blocks, forwards
    and backwards, of the rows at the frame's ends. It takes two sorts: blocks are numbered
    downwards, so that rows sorted backwards within their blocks are so in the whole group.
    """
    width = high - low + 1
    parts = _partials(added)
    group = Window.partitionBy(*map(column, by))
    block = Window.partitionBy(*map(column, by), "__part")
    running = (Window.unboundedPreceding, Window.currentRow)
    down = F.col("__pos").desc()
    rows = rows.withColumn("__part", F.expr(f"-(__pos div {width}L)"))
    forwards = block.orderBy("__pos").rowsBetween(*running)
    backwards = block.orderBy(down).rowsBetween(*running)
    rows = rows.withColumns({f"__to{c}": p.result().over(forwards) for c, p in parts.items()})
    rows = rows.withColumns({f"__from{c}": p.result().over(backwards) for c, p in parts.items()})

    order = group.orderBy("__part", down)
    found = {}
    for c in parts:
        found[f"__begin{c}"] = F.lag(f"__from{c}", low).over(order)
        found[f"__end{c}"] = F.lag(f"__to{c}", high).over(order)
        found[f"__close{c}"] = F.first(f"__to{c}").over(order.rowsBetween(*EVERYTHING))
    a, b = f"(__pos + {low}L)", f"(__pos + {high}L)"

    def total(c: str) -> str:
        begin, end = f"__begin{c}", f"CASE WHEN {b} > __last THEN __close{c} ELSE __end{c} END"
        return f"""CASE WHEN {a} > __last OR {b} < 0 THEN {"0L" if parts[c].func == "count" else "NULL"}
            WHEN {a} < 0 THEN {end}
            WHEN {a} div {width}L = least({b}, __last) div {width}L THEN {begin}
            ELSE {_merged(parts[c].merge, begin, end)} END"""

    return rows.withColumns(found).withColumns(_results(added, parts, total))


def _split_open_frames(placed: DataFrame, added: list[_Added], low: int, high: int) -> DataFrame:
    """Frames from a partition's first row on, or up to its last, for hot partitions.

    A block's own window starts at the block, or, for frames that end before their
    row, so many whole blocks earlier that it reaches their end. What lies before it
    is the aggregate of whole blocks, one row for each, which is joined and added.
    """
    if high >= NO_BOUND:  # the same from the other side
        placed = placed.withColumn("__pos", F.col("__total") - 1 - F.col("__pos"))
        high = -low
    parts = _partials(added)
    cut = placed.withColumns(
        {
            "__own": F.expr("__pos div __unit"),
            "__back": F.expr(f"({max(-high, 0)}L + __unit - 1) div __unit"),
        }
    )
    first = F.expr(f"greatest(0L, __pos - {max(high, 0)}L) div __unit")
    last = F.expr("least((__total - 1) div __unit, __own + __back)")
    copied = cut.withColumn("__block", F.explode(F.sequence(first, last)))
    frame = Window.partitionBy("__g", "__block").orderBy("__pos")
    frame = frame.rowsBetween(Window.unboundedPreceding, high)
    near = copied.withColumns({c: p.result().over(frame) for c, p in parts.items()})
    near = near.where("__block = __own")

    blocks = cut.groupBy("__g", "__own", "__back").agg(
        *[p.result().alias(c) for c, p in parts.items()]
    )
    before = Window.partitionBy("__g").orderBy("__own").rowsBetween(Window.unboundedPreceding, -1)
    far = blocks.select(
        "__g",
        (F.col("__own") + F.col("__back")).alias("__block"),
        *[aggregate(p.merge, F.col(c)).over(before).alias(f"__far{c}") for c, p in parts.items()],
    )

    kinds = {x.name: x.dataType.simpleString() for x in near.schema}

    def total(c: str) -> str:
        return _merged(parts[c].merge, c, f"CAST(__far{c} AS {kinds[c]})")

    joined = near.join(far, ["__g", "__block"], "left")
    return joined.withColumns(_results(added, parts, total))
