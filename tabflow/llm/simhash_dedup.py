"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has the bits that are set in over half of the hashes of its
word shingles. Two fingerprints that differ in at most tau bits, cut into m segments
that form a ring, have a segment from which on each chain of l consecutive segments
differs in at most l * tau / m bits. With three segments and tau = 2 these budgets
are 0, 1 and 2 bits: one segment is equal, the next differs in a bit at most. So a
fingerprint is looked up under its own chains of two segments and those with one bit
of the second switched on, and what meets there is checked over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tabflow.llm.shared import arrow_schema, column, components, map_arrow, map_batches, materialise

#: Bits of the three segments, from the highest down.
SEGMENTS = (22, 21, 21)
DISTANCE = 2
#: Fingerprints under one key that are compared with each other directly.
DIRECT = 512


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text as an unsigned 64-bit integer; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        hash_of, join = xxhash.xxh64_intdigest, b" ".join
        shifted = (words[k:] for k in range(shingle))
        hashes = [hash_of(join(x), seed) for x in zip(*shifted)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint as a signed bigint) of each row."""
    picked = df.select(column(id_col).alias("id"), column(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)], np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"]
        )

    return map_batches(picked, run, f"id {kind}, fp bigint")


def chain_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of two-segment chains and, for each, the place of its fingerprint.

    A key is the number of the chain and its bits. Of two fingerprints that differ
    in one bit of the second segment only the one without that bit looks for the
    other, so a link shows once in a chain.
    """
    keys, owners = [], []
    everyone = np.arange(len(fps))
    lows = np.cumsum((0, *SEGMENTS[::-1]))[::-1]  # of each segment its lowest bit, after the top
    for i in range(3):
        j = (i + 1) % 3
        mask = 0
        for s in (i, j):
            mask |= ((1 << SEGMENTS[s]) - 1) << int(lows[s + 1])
        # 64 - 43 or 42 bits are free under the mask; the chain's number is mixed into them.
        tag = np.uint64(int(np.uint64(i + 1)) << int(lows[(i + 2) % 3 + 1]))
        own = (fps & np.uint64(mask)) | tag
        keys.append(own)
        owners.append(everyone)
        for bit in range(int(lows[j + 1]), int(lows[j + 1]) + SEGMENTS[j]):
            without = everyone[(fps >> np.uint64(bit)) & np.uint64(1) == 0]
            keys.append(own[without] | np.uint64(1 << bit))
            owners.append(without)
    return np.concatenate(keys), np.concatenate(owners)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is within the distance; enough for components, and
    fewer than there are fingerprints."""
    fps = np.unique(fps)
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []

    def join(a: int, b: int) -> None:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((a, b))

    if len(fps) <= DIRECT:
        for i in range(len(fps) - 1):
            near = np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= DISTANCE
            for k in np.flatnonzero(near):
                join(i, i + 1 + int(k))
    else:
        # More are found by switching up to two of the bits in which any two differ.
        differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
        bits = [np.uint64(1 << b) for b in range(64) if differ >> b & 1]
        flips = bits + [a | b for k, a in enumerate(bits) for b in bits[k + 1 :]]
        for flip in flips:
            other = fps ^ flip
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            for i in np.flatnonzero((fps[at] == other) & (other > fps)):
                join(int(i), int(at[i]))
    return [(int(fps[a]), int(fps[b])) for a, b in links]


def links(distinct: DataFrame, fp_col: str = "fp") -> DataFrame:
    """Links ``a``, ``b`` between different fingerprints at most two bits apart,
    with which all such pairs are connected.

    Each fingerprint is dealt out under about 36 keys, so the work grows with the
    number of fingerprints. Those under one key differ in the remaining segment and
    one bit, so their number is bounded however many texts there are; a task gives
    back fewer links than it has read fingerprints.
    """

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, owners = chain_keys(fps)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(fps[owners].view(np.int64))], names=["key", "fp"]
        )

    schema = "a bigint, b bigint"
    kind = arrow_schema(schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last key's fingerprints, which may go on in the next batch
        last = None
        found: list[tuple[int, int]] = []

        def give():
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], schema=kind
            )

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ends = np.append(starts[1:], len(keys))
            if last is not None and keys[0] == last:
                held.append(fps[: ends[0]])
                starts, ends = starts[1:], ends[1:]
            if len(starts):
                if held:
                    found += forest(np.concatenate(held)) if sum(map(len, held)) > 1 else []
                # The last run may go on; of the others only those of two or more matter.
                for s, e in zip(starts[:-1], ends[:-1]):
                    if e - s > 1:
                        found += forest(fps[s:e])
                held, last = [fps[starts[-1] : ends[-1]]], keys[starts[-1]]
            if len(found) > 100_000:
                yield give()
        if sum(map(len, held)) > 1:
            found += forest(np.concatenate(held))
        if found:
            yield give()

    keyed = map_batches(distinct.select(column(fp_col).alias("fp")), deal, "key bigint, fp bigint")
    return map_arrow(keyed.repartition("key").sortWithinPartitions("key"), meet, schema)


def simhash_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """Groups of near-duplicate texts: fingerprints at most two bits apart, transitively.

    Returns ``id``, ``fp``, ``component_id`` (the smallest id of the group), a row
    for each row of ``df``. Null texts and texts without words have fingerprint 0,
    which links like any other. Null ids are in their group but not its smallest
    id, unless all are null. Equal fingerprints are one node from the start, so a
    group of exact copies costs one lookup, and the joins back to the rows are on
    narrow tables in which adaptive execution splits a hot fingerprint.
    """
    marked = materialise(fingerprints(df, id_col, text_col, shingle, seed))
    nodes = materialise(marked.groupBy("fp").agg(F.min("id").alias("least")))
    member = components(links(nodes))
    rooted = nodes.join(member.hint("merge"), F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest.hint("merge"), "root").select("fp", "component_id")
    return marked.join(named.hint("merge"), "fp").select("id", "fp", "component_id")
