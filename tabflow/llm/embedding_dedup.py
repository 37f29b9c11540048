"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors of length 1 with a cosine of at least c are at most t = 2 - 2c apart in
squared distance. After a rotation they are cut into blocks of dimensions; if two
vectors are within t, then in some block of share s of the dimensions they are
within s * t. So each block is range-joined under its own budget, in the cells of a
grid over its first dimensions, and what any block finds is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabflow.llm.shared import arrow_schema, column, components, map_arrow, materialise

BLOCK = 16
GRID = 2
#: Rows of a cell that one task compares: those at home in it, and those that visit.
HOME, VISIT = 16_384, 65_536
#: Rows at home and visitors compared at a time, so few that their distances stay in a processor's cache.
ROWS, OTHERS = 256, 2048
SLACK = 1e-9


@lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([5, size]).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to length 1; largest component first, so that no square overflows."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def blocks(size: int, cosine: float) -> list[tuple[slice, float]]:
    """Dimensions of each block and its squared-distance budget."""
    whole = 2 - 2 * cosine
    cuts = [slice(low, min(low + BLOCK, size)) for low in range(0, size, BLOCK)]
    return [(c, whole * (c.stop - c.start) / size + SLACK) for c in cuts]


def cells(rotated: np.ndarray, block: slice, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells of a block's grid: (rows, cell number, whether the row is at home in it).

    A cell is twice as wide as the block's range, so a row visits one neighbour at most in
    each dimension of the grid.
    """
    reach = budget**0.5
    x = rotated[:, block][:, :GRID]
    home = np.floor(x / (2 * reach)).astype(np.int64)
    inside = x / (2 * reach) - home
    side = np.where(inside < 0.5, -1, 1)
    number = lambda c: (c + (1 << 20)) @ (1 << (21 * np.arange(c.shape[1])))
    everyone = np.arange(len(x))
    for moves in range(1 << x.shape[1]):
        moved = np.array([moves >> k & 1 for k in range(x.shape[1])])
        yield everyone, number(home + side * moved), np.full(len(x), moves == 0)


def compare(nodes, vectors, weights, homes, size: int, cosine: float, block: int):
    """All links of the rows at home, which come first, with the visitors after them
    that this block finds first.

    Returns the weight linked to each row at home, and links that connect them.
    """
    v = unit(vectors)
    rotated = v @ rotation(size)
    parts = blocks(size, cosine)
    dims, budget = parts[block]
    low = rotated[:, dims].astype(np.float32)
    norms = (low * low).sum(axis=1)
    # One product gives squared distances less the norm of the row at home.
    ours = np.column_stack([-2 * low, np.ones_like(norms)])
    theirs = np.ascontiguousarray(np.column_stack([low, norms]).T)
    within = np.float32(budget + 1e-5) - norms
    here = np.flatnonzero(homes)
    linked = np.zeros(len(nodes))
    label = np.arange(len(nodes))
    edges: list[tuple[int, int]] = []
    for a in range(0, len(here), ROWS):
        rows = here[a : a + ROWS]
        for b in range(len(here), len(nodes), OTHERS):
            apart = ours[rows] @ theirs[:, b : b + OTHERS]
            hits = np.flatnonzero(apart <= within[rows, None])
            i, j = np.divmod(hits, apart.shape[1])
            i, j = rows[i], j + b
            keep = nodes[i] != nodes[j]
            i, j = i[keep], j[keep]
            for c in range(0, len(i), 100_000):
                x, y = i[c : c + 100_000], j[c : c + 100_000]
                near = np.einsum("ij,ij->i", v[x], v[y]) >= cosine
                x, y = x[near], y[near]
                square = (rotated[x] - rotated[y]) ** 2
                first = square[:, dims].sum(axis=1) <= budget
                for d, t in parts[:block]:
                    first &= square[:, d].sum(axis=1) > t
                x, y = x[first], y[first]
                np.add.at(linked, x, weights[y])
                p, q = label[x], label[y]
                if (p != q).any():
                    roots: dict[int, int] = {}

                    def root(k: int) -> int:
                        while (up := roots.get(k, k)) != k:
                            k = up
                        return k

                    for s, t in np.unique(np.stack([p, q], axis=1)[p != q], axis=0).tolist():
                        s, t = root(s), root(t)
                        if s != t:
                            roots[max(s, t)] = min(s, t)
                            edges.append((s, t))
                    moved = np.array([root(k) for k in range(len(label))]) if roots else None
                    if moved is not None:
                        label = moved[label]
    return here, linked[here], [(int(nodes[s]), int(nodes[t])) for s, t in edges]


def embedding_components(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95
) -> DataFrame:
    """Direct links and connected groups of vectors with at least this cosine (0 < cosine < 1).

    Returns ``id``, ``n_links`` (other rows linked directly), ``component_id``
    (smallest id reachable, itself included), ``kept`` (``id`` is it), a row for
    each row of ``df``. Vectors that are null, empty, zero, or hold a null or
    non-finite component link with nothing and keep their own id; vectors of
    different sizes don't link. Repeated rows are other rows and link; null ids are
    counted, but are no component's id unless it has no other.

    Equal vectors become one node with a weight first, so that copies cost nothing.
    Cells are split by the counts of their rows, so a task compares a bounded number
    of rows; it hands on sums and spanning links, never pairs. In as far as vectors
    are spread evenly over all dimensions, the rows of a cell grow with their number
    and so does the work for each.
    """
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    number = "float" if kind == "float" else "double"
    vector = F.col("v")
    rows = df.select(column(id_col).alias("id"), column(vector_col).cast(f"array<{number}>").alias("v"))
    # Adding zero makes one zero of both; a null component makes the check null.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast(number)))
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(fit, vector))
    keyed = rows.select(
        "id", "v", F.when(fit, F.xxhash64("v")).alias("h1"), F.when(fit, F.xxhash64(F.lit(1), "v")).alias("h2")
    )
    nodes = (
        keyed.where("h1 IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("v").alias("v"))
    )
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))

    def placed(batch: pa.RecordBatch, sliced: dict | None):
        """Of a batch of nodes: key columns and the rows that they belong to."""
        values = batch.column("v")
        sizes = np.array([len(x) for x in values])
        ids = batch.column("node").to_numpy(zero_copy_only=False)
        for size in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == size)
            rotated = unit(np.array(values.take(pa.array(which)).to_pylist(), np.float64)) @ rotation(size)
            for b, (dims, budget) in enumerate(blocks(size, cosine)):
                for part, cell, home in cells(rotated, dims, budget):
                    cell = cell ^ np.int64(b << 44) ^ np.int64(size << 50) if len(part) else cell
                    yield which[part], size, b, cell, home, ids[which[part]]

    count_schema = "cell bigint, size int, block int, homes bigint, visits bigint"
    count_kind = arrow_schema(count_schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, list[int]] = {}
        for batch in batches:
            for _, size, b, cell, home, _ in placed(batch, None):
                distinct, many = np.unique(cell, return_counts=True)
                for c, n in zip(distinct.tolist(), many.tolist()):
                    entry = totals.setdefault((c, size, b), [0, 0])
                    entry[0] += n if home[0] else 0
                    entry[1] += n
        if totals:
            columns = [*zip(*totals), *zip(*totals.values())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, count_kind)], schema=count_kind
            )

    picked = nodes.select("node", "n", "v")
    large = (
        map_arrow(picked, count, count_schema)
        .groupBy("cell", "size", "block")
        .agg(F.sum("homes").alias("homes"), F.sum("visits").alias("visits"))
        .where((F.col("homes") > HOME) | (F.col("visits") > VISIT))
    )
    # No more cells than a grid over [-1, 1] has: a number that doesn't grow with the rows.
    sliced = {
        (r["cell"], r["size"], r["block"]): (-(-r["homes"] // HOME) or 1, -(-r["visits"] // VISIT))
        for r in large.collect()
    }
    deal_schema = f"cell bigint, i int, j int, size int, block int, home boolean, node bigint, n bigint, v array<{number}>"
    deal_kind = arrow_schema(deal_schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                batch = whole.slice(low, 2000)
                for which, size, b, cell, home, ids in placed(batch, sliced):
                    ways = np.array([sliced.get((c, size, b), (1, 1)) for c in cell.tolist()])
                    for as_home in (True, False) if home[0] else (False,):
                        # A row at home meets each slice of visitors, a visitor each slice at home.
                        many = ways[:, 1] if as_home else ways[:, 0]
                        row = np.repeat(np.arange(len(cell)), many)
                        turn = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                        own = ids[row] % (ways[row, 0] if as_home else ways[row, 1])
                        i, j = (own, turn) if as_home else (turn, own)
                        take = pa.array(which[row])
                        columns = [
                            pa.array(cell[row]), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                            pa.array(np.full(len(row), size, np.int32)), pa.array(np.full(len(row), b, np.int32)),
                            pa.array(np.full(len(row), as_home)), batch.column("node").take(take),
                            batch.column("n").take(take), batch.column("v").take(take),
                        ]
                        yield pa.RecordBatch.from_arrays(
                            [c.cast(f.type) for c, f in zip(columns, deal_kind)], schema=deal_kind
                        )

    found_schema = "node bigint, links double, a bigint, b bigint"
    found_kind = arrow_schema(found_schema)

    def meet(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done():
            table = pa.Table.from_batches(held).combine_chunks()
            homes = table["home"].to_numpy()
            if not homes.any():
                return
            size, block = table["size"][0].as_py(), table["block"][0].as_py()
            flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            vectors = flat.astype(np.float64).reshape(-1, size)
            nodes = table["node"].to_numpy()
            # A row that is at home in the cell is there as a visitor too.
            order = np.concatenate([np.flatnonzero(homes), np.flatnonzero(~homes)])
            here, linked, edges = compare(
                nodes[order], vectors[order], table["n"].to_numpy()[order], homes[order], size, cosine, block
            )
            part = nodes[order][here]
            none = np.zeros(len(edges))
            hit = linked > 0
            if hit.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[hit]), pa.array(linked[hit]), pa.nulls(hit.sum(), pa.int64()), pa.nulls(hit.sum(), pa.int64())],
                    schema=found_kind,
                )
            if edges:
                a, b = np.array(edges, np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(none), pa.array(a), pa.array(b)], schema=found_kind
                )

        for batch in groups:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(5))))
            starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for s, e in zip(starts, [*starts[1:], len(keys)]):
                if keys[s] != last:
                    if held:
                        yield from done()
                    held, last = [], keys[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield from done()

    keys = ["cell", "i", "j", "size", "block"]
    found = map_arrow(picked, deal, deal_schema).repartition(*keys).sortWithinPartitions(*keys)
    found = materialise(map_arrow(found, meet, found_schema))
    linked = found.groupBy("node").agg(F.sum("links").cast("bigint").alias("links"))
    member = components(found.where("a IS NOT NULL").select("a", "b"))
    joined = (
        nodes.select("node", "h1", "h2", "n", "least")
        .join(linked, "node", "left")
        .join(member.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
        .select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "least",
                F.coalesce("root", "node").alias("root"))
    )
    joined = materialise(joined)
    smallest = joined.groupBy("root").agg(F.min("least").alias("component"))
    named = joined.join(smallest, "root").select(
        F.col("h1").alias("k1"), F.col("h2").alias("k2"), "links", "component"
    )
    ids = keyed.select("id", "h1", "h2")
    out = ids.join(named.hint("merge"), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.coalesce("component", "id")
    return out.select(
        "id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
