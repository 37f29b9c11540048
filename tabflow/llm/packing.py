"""Variable-capacity best-fit packing of token sequences into training sequences.

Bins may have any of several permitted lengths, each with a cost. Longest pieces
come first; each goes to the open bin that it fills best, or opens the bin size that
costs least for it, and at the end each bin shrinks to the smallest length that
holds its contents. As pieces of one length are alike, all this is decided on the
counts of lengths, which are as many as the longest permitted length however large
the corpus is; rows are then dealt to the places by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabflow.llm.shared import arrow_schema, column, extend, map_arrow, materialise

CAPACITIES = (512, 1024, 2048, 4096)
#: Rows of one length are ranked in so many parts, so a common length isn't one task's work.
PARTS = 256


def cost(capacity: int, whole: int) -> float:
    """Of running a sequence of that length: linear work, a share that is quadratic
    (attention), and a fixed part for each sequence."""
    return capacity * (1 + 0.25 * capacity / whole) + 16


def best_fit(
    counts: dict[int, int], capacities: Sequence[int], opening: dict[int, int]
) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best fit decreasing over counts of lengths: (number of bins, their contents) where
    contents are (length, number) pairs. ``opening`` has the capacity that a piece
    of each length opens. Same bins as placing pieces one by one."""
    free: list[int] = []  # the residual capacities in use, ascending
    bins: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}

    def keep(residual: int, number: int, contents: tuple) -> None:
        if residual not in bins:
            bins[residual] = []
            insort(free, residual)
        bins[residual].append((number, contents))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                residual = free[at]
                number, contents = bins[residual].pop()
                if not bins[residual]:
                    del bins[residual], free[at]
            else:
                residual, number, contents = opening[length], left, ()
            # A bin takes pieces until it is full; then comes the next of the same kind.
            each = residual // length
            full = min(number, left // each)
            if full:
                keep(residual - each * length, full, (*contents, (length, each)))
                left -= full * each
            used = full
            if used < number and left and left < each:
                keep(residual - left * length, 1, (*contents, (length, left)))
                left, used = 0, used + 1
            if used < number and contents:
                keep(residual, number - used, contents)
    return [x for found in bins.values() for x in found]


def plan(
    counts: dict[int, int], capacities: Sequence[int]
) -> list[tuple[int, int, tuple[tuple[int, int], ...]]]:
    """The cheapest of several ways to open bins: (bins, final capacity, contents).

    A piece may open the capacity with the least cost per token that it holds when
    full, or the smallest that it fits, or the smallest that is at least some
    multiple of its length; all are tried on the counts, and costs compared after each
    bin has shrunk to its contents.
    """
    sizes = sorted(capacities)
    whole = sizes[-1]
    ways = []
    for multiple in (1, 1.5, 2, 3, 4, 8):
        ways.append({n: next((c for c in sizes if c >= multiple * n), whole) for n in counts})
    ways.append({n: min((c for c in sizes if c >= n), key=lambda c: cost(c, whole) / (c // n * n)) for n in counts})
    ways += [{n: max(c, next(s for s in sizes if s >= n)) for n in counts} for c in sizes]
    best, least = [], None
    for opening in ways:
        shrunk = [
            (number, next(c for c in sizes if c >= sum(a * b for a, b in contents)), contents)
            for number, contents in best_fit(counts, sizes, opening)
        ]
        total = sum(number * cost(c, whole) for number, c, _ in shrunk)
        if least is None or total < least:
            best, least = shrunk, total
    return best


def pieces(
    df: DataFrame, length_col: str, id_col: str = "doc_id", longest: int = CAPACITIES[-1]
) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``: sequences cut to ``longest`` tokens.

    Null and non-positive lengths have no tokens and so no piece.
    """
    cut = df.select(column(id_col).alias("id"), column(length_col).cast("bigint").alias("n"))
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {longest}")))
    return cut.where("n > 0").select("id", "n", at.alias("piece")).select(
        "id",
        "piece",
        (F.col("piece") * longest).alias("start"),
        F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("int").alias("length"),
    )


def pack(
    df: DataFrame, length_col: str = "n_tokens", id_col: str = "doc_id",
    capacities: Sequence[int] = CAPACITIES,
) -> DataFrame:
    """Deal each row's tokens to bins.

    Returns ``id``, ``piece``, ``start``, ``length`` (a row longer than the largest
    capacity is cut into pieces of it), ``bin_id``, ``capacity`` (of the bin, one of
    ``capacities``), ``offset`` (where in the bin the piece lies). Each token of each
    row is in one bin, once; rows without tokens have none; repeated rows are packed
    like others, and no rows give no bins.

    The driver gets the counts of lengths, at most one per token of the largest
    capacity. Ranks come from counts per length and part, so even if all rows have
    one length the work is in ``PARTS`` parts. They are ordered by id, so the result
    is the same each time for ids that are unique.
    """
    longest = max(capacities)
    cut = pieces(df, length_col, id_col, longest)
    cut = materialise(cut.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(PARTS)).cast("int")))
    sizes = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    # Of each length: rank from which on a place holds, bin, pieces per bin, offset in it.
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    taken = dict.fromkeys(counts, 0)
    final: list[tuple[int, int]] = []
    number = 0
    for many, capacity, contents in plan(counts, capacities):
        at = 0
        for length, each in contents:
            found.setdefault(length, []).append((taken[length], number, each, at))
            taken[length] += many * each
            at += length * each
        final.append((number, capacity))
        number += many
    places = {n: np.array(x, np.int64).T for n, x in found.items()}
    firsts, capacity_of = (np.array(x, np.int64) for x in (zip(*final) if final else ((), ())))

    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece")) - 1
    # Both are dealt out by length and part, so a merge join needs no more exchange for the
    # pieces; the offsets are as many as there are lengths times PARTS, too many to broadcast.
    ranked = cut.withColumn("rank", rank).join(offsets.hint("merge"), ["length", "part"]).select(
        "id", "piece", "start", "length", (F.col("rank") + F.col("before")).cast("bigint").alias("rank")
    )
    out = extend(ranked.drop("rank").schema, "bin_id bigint, capacity int, offset int")
    schema = arrow_schema(out)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3).to_numpy(zero_copy_only=False)
            ranks = batch.column(4).to_numpy(zero_copy_only=False)
            bins, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int32)
            for n in np.unique(lengths):
                here = np.flatnonzero(lengths == n)
                starts, first, each, at = places[int(n)]
                k = np.searchsorted(starts, ranks[here], "right") - 1
                within = ranks[here] - starts[k]
                bins[here] = first[k] + within // each[k]
                offset[here] = at[k] + within % each[k] * n
            sizes = capacity_of[np.searchsorted(firsts, bins, "right") - 1].astype(np.int32)
            columns = [*batch.columns[:4], pa.array(bins), pa.array(sizes), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_arrow(ranked, deal, out)
