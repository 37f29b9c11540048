"""Finding groups that hold too many rows for one task, and cutting them up.

Everything here stays lazy. A group is *hot* when it has more rows than
``unit = max(hot_rows, all rows / max_hot)``. Fewer than ``max_hot`` groups can
pass that mark, whatever the data, so the table of hot groups is always small
enough to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .expressions import column


@dataclass(frozen=True)
class SkewPolicy:
    """When and how finely an operator splits large groups."""

    small_bytes: int = 64 * 1024 * 1024
    """Files of at most this size run the plain operator, see :func:`is_small`."""
    hot_rows: int = 250_000
    """A group of at most this many rows is never split."""
    max_hot: int = 16_384
    """Bound on hot groups, and on range boundaries over all of them; up to 190,000."""
    broadcast: bool = True
    """Leave joins to Catalyst when it can broadcast a side."""


DEFAULT_SKEW = SkewPolicy()


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate for ``df``, or None where it cannot be read."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def fits(df: DataFrame, limit: int) -> bool:
    size = estimated_bytes(df)
    return size is not None and size <= limit


#: Steps of a plan that give no more rows than they read.
_NO_MORE_ROWS = {
    "Project", "Filter", "Sort", "Window", "Aggregate", "Distinct", "Deduplicate", "GlobalLimit",
    "LocalLimit", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Union", "Sample",
    "CollectMetrics",
}


def is_small(df: DataFrame, policy: SkewPolicy) -> bool:
    """Whether no group of ``df`` can be hot, so that the plain operator may run.

    Catalyst's size estimate says nothing of the rows that an explode, a join or a
    function makes, so it isn't asked: a plan is small if Catalyst has proved a bound of
    ``hot_rows`` on its rows, or if it only takes rows away from files of
    ``small_bytes`` or less. The groups of any other input are counted as it runs,
    and without a hot one among them adaptive execution leaves the plain operator.
    """
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        bound = plan.maxRows()
        if bound.isDefined() and int(str(bound.get())) <= policy.hot_rows:
            return policy.small_bytes > 0
        total, todo = 0, [plan]
        while todo:
            node = todo.pop()
            children = node.children()
            if children.isEmpty():
                if node.nodeName() != "LogicalRelation" and not node.nodeName().startswith("Relation"):
                    return False
                total += int(str(node.relation().sizeInBytes()))
            elif node.nodeName() not in _NO_MORE_ROWS:
                return False
            todo += [children.apply(i) for i in range(children.size())]
        return total <= policy.small_bytes
    except AttributeError:
        return False


#: In how many parts the sketches of tasks are merged before they become one.
_MERGED = 256


def likely_hot(keyed: DataFrame, policy: SkewPolicy) -> DataFrame:
    """Hashes ``__h`` of ``keyed`` that all hot groups are among, and ``__unit``.

    Each task keeps a frequent-items sketch of a size that depends on ``max_hot`` alone,
    so no more than that is shuffled however many groups there are. The sketch tracks
    so many items that what it may miss of a count is under half a ``unit``; it adds
    that to its estimates, so that no hot group is left out, and what is named besides
    has over half a unit of rows.
    """
    # The error is at most 3.5 rows in so many as the sketch has places, of which three
    # quarters are filled.
    tracked = min(-(-21 * policy.max_hot // 4) + 1, 1_000_000)
    parts = keyed.groupBy(F.pmod(F.spark_partition_id(), F.lit(_MERGED)).alias("__part")).agg(
        F.expr(f"approx_top_k_accumulate(__h, {tracked})").alias("__s"), F.count(F.lit(1)).alias("__n")
    )
    # By a key, if only one: without any, a task that has no sketch can't write its share.
    whole = parts.groupBy(F.pmod("__part", F.lit(1)).alias("__all")).agg(
        F.expr(f"approx_top_k_combine(__s, {tracked})").alias("__s"), F.sum("__n").alias("__n")
    )
    return (
        whole.select(
            _unit(F.col("__n"), policy).alias("__unit"),
            F.explode(F.expr(f"approx_top_k_estimate(__s, {min(2 * policy.max_hot, tracked)})")).alias("__x"),
        )
        .where("__x.count > __unit")
        .select(F.col("__x.item").alias("__h"), "__unit")
    )


def hot_groups(df: DataFrame, group: Column, policy: SkewPolicy) -> DataFrame:
    """Hot groups of ``df``: ``__g`` (the group), ``__rows`` and ``__unit``.

    Only the groups that a sketch names are counted, see :func:`likely_hot`.
    """
    keyed = df.select(group.alias("__g")).withColumn("__h", F.xxhash64("__g"))
    counted = keyed.join(F.broadcast(likely_hot(keyed, policy)), "__h").groupBy("__g", "__unit")
    return counted.agg(F.count(F.lit(1)).alias("__rows")).where("__rows > __unit").select("__g", "__rows", "__unit")


def hot_of_counts(sizes: DataFrame, policy: SkewPolicy) -> DataFrame:
    """The rows of ``sizes`` (``__g``, ``__rows``) that are hot, with ``__unit``."""
    unit = sizes.agg(F.sum("__rows").alias("n")).select(_unit(F.col("n"), policy)).scalar()
    return sizes.withColumn("__unit", unit).where("__rows > __unit")


def whole_table_unit(df: DataFrame, policy: SkewPolicy) -> Column:
    """``unit`` for a table that is a single group."""
    return df.agg(F.count(F.lit(1)).alias("n")).select(_unit(F.col("n"), policy)).scalar()


def _unit(rows: Column, policy: SkewPolicy) -> Column:
    return F.greatest(F.lit(policy.hot_rows).cast("long"), F.ceil(rows / policy.max_hot))


def with_range_bucket(rows: DataFrame, order: list[Column], policy: SkewPolicy) -> DataFrame:
    """Add ``__bucket``: a number that grows with ``order``.

    ``rows`` holds hot groups only, with ``__g`` and ``__unit``. Boundaries are
    the order keys whose hash falls under 1/unit: about one per ``unit`` rows, so
    a bucket, over all groups, comes out near that size, and there are some
    ``max_hot`` boundaries at most. A key is a boundary because of its own hash
    alone, so every evaluation of the plan, also after a lost executor, cuts at
    the same places. Boundaries only steer the work: all rows get a bucket.
    """
    key = order[0] if len(order) == 1 else F.struct(*order)
    keyed = rows.withColumn("__key", key)
    chance = F.shiftrightunsigned(F.xxhash64("__g", "__key"), 11) / F.lit(2.0**53)
    bounds = (
        keyed.where(chance * F.col("__unit") < 1)
        .select("__key")
        .distinct()
        .agg(F.sort_array(F.collect_list("__key")))
        .scalar()
    )
    # Binary search for the number of boundaries below the key, one column per
    # halving. As a chain of projections it stays in generated code, where the
    # array is a reference.
    steps = [2**p for p in range((2 * policy.max_hot).bit_length() - 1, -1, -1)]
    search = [F.lit(0).alias("__at0")]
    for i, step in enumerate(steps):
        at = F.col(f"__at{i}")
        below = F.get(F.col("__bounds"), at + (step - 1)) < F.col("__key")
        search.append((at + F.when(below, step).otherwise(0)).alias(f"__at{i + 1}"))
    found = keyed.withColumn("__bounds", bounds).select("*", *search)
    # The optimizer traces join keys back through projections, which doubles the
    # expression at each halving; it does not look behind an explode.
    bucket = F.explode(F.array(f"__at{len(steps)}")).alias("__bucket")
    return found.select(*map(column, rows.columns), bucket)


def bucket_starts(bucketed: DataFrame, size: Column | None = None) -> DataFrame:
    """Per (``__g``, ``__bucket``): its rows ``__n``, those of the group before it, and in
    all. ``size`` is an aggregate that counts them, if rows stand for several."""
    size = F.count(F.lit(1)) if size is None else size
    sizes = bucketed.groupBy("__g", "__bucket").agg(size.alias("__n"))
    group = Window.partitionBy("__g")
    before = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        "__g",
        "__bucket",
        "__n",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
        F.sum("__n").over(group).alias("__total"),
    )
