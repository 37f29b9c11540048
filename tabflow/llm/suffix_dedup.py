"""Removal of long byte strings that occur more than once, by suffix sorting.

A string of ``length`` bytes is repeated if it starts at two places of the corpus.
Sorting all suffixes would find each such string as two neighbours. So that no
machine needs all suffixes, they are dealt out by an anchor: of the short grams in a
string, the one with the smallest hash. Equal strings have the same anchor at the
same place, and only anchors that occur twice matter. Where all surroundings of an
anchor are the same, they are repeated as a whole; the others are suffix-sorted by
the deep-shallow method: multikey quicksort to a shallow depth, blind tries for
groups that agree beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tabflow.llm.shared import arrow_schema, column, extend, map_arrow, map_batches, materialise

GRAM = 24
SHALLOW = 24
#: Bytes of a text whose anchors are found at a time; places in it must fit in 24 bits.
CHUNK = 1 << 16
#: An anchor with more occurrences than this is dealt out in smaller groups.
HOT = 4096
#: Copies of one context are looked for in so many parts.
PARTS = 16
#: Starts of such an anchor that go together.
RUN = 16
#: Suffixes sorted together in a task.
SUFFIXES = 400_000

_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)
_B = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the gram that starts at each place."""
    power = {k: np.uint64(pow(_B, k, 1 << 64)) for k in (1, 2, 4, 8)}
    h = {1: _TABLE[data]}
    for k in (1, 2, 4, 8):
        h[2 * k] = h[k][:-k] * power[k] + h[k][k:]
    out = h[16][: len(data) - GRAM + 1] * power[8] + h[8][16:]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def anchors(data: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor of a text: first and last start of the strings that it stands
    for, its place, its hash. Each start of a whole string is in one range."""
    if len(data) < length:
        return
    window = length - GRAM + 1
    for base in range(0, len(data) - length + 1, CHUNK):
        part = np.frombuffer(data, np.uint8, min(CHUNK + length - 1, len(data) - base), base)
        hashes = gram_hashes(part)
        least = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        size = 1
        while 2 * size <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
        at = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        yield first + base, last + base, at[first] + base, hashes[at[first]]


def deep_shallow(text: bytes, starts: np.ndarray, buckets: np.ndarray, length: int):
    """Sort strings of ``length`` bytes by bucket and content.

    Returns the order (indices into ``starts``) and, for each place in it, whether
    the string equals the one before it in the same bucket.
    """
    n = len(starts)
    order = np.argsort(buckets, kind="stable")
    if not n:
        return order, np.zeros(0, bool)
    padded = text + bytes(16)
    letters = np.empty(len(text) + 8, ">u8")  # eight bytes from each place as one letter
    for k in range(8):
        part = np.frombuffer(padded, ">u8", (len(padded) - k) // 8, k)
        out = letters[k::8]
        out[:] = part[: len(out)]
    letters = letters.astype(np.uint64)

    # Multikey quicksort of all segments at once: each round splits each segment in
    # three about a pivot, and those equal to it go on to the next letter.
    new = np.concatenate([[True], np.diff(buckets[order]) != 0])
    depth = np.zeros(n, np.int64)  # of the segment that a place is in
    while True:
        segment = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, n))
        active = np.flatnonzero((sizes[segment] > 1) & (depth < min(SHALLOW, length)))
        if not len(active):
            break
        seg = segment[active]
        at = starts[order[active]] + depth[active]
        keys = letters[at]
        over = 8 - (length - depth[active])
        if (over > 0).any():  # what lies behind the string doesn't count
            shift = (8 * np.maximum(over, 0)).astype(np.uint64)
            keys = keys >> shift << shift
        middle = first[seg] + sizes[seg] // 2
        pivot = keys[np.searchsorted(active, middle)]
        side = np.where(keys < pivot, 0, np.where(keys == pivot, 1, 2))
        where = np.argsort(seg * 3 + side, kind="stable")
        order[active] = order[active][where]
        seg, side = seg[where], side[where]
        depth[active] = depth[active][where] + 8 * (side == 1)
        cut = np.concatenate([[True], (np.diff(seg) != 0) | (np.diff(side) != 0)])
        new[active] |= cut
    same = np.zeros(n, bool)
    first = np.flatnonzero(new)
    for a, b in zip(first.tolist(), np.append(first[1:], n).tolist()):
        if b - a > 1:
            order[a:b], same[a:b] = blind_trie(text, starts, order[a:b].tolist(), length)
    return order, same


def blind_trie(text: bytes, starts: np.ndarray, members: list[int], length: int):
    """Sort a group of strings that agree at their beginning, by a blind trie.

    A branch knows only at which byte its strings part. A string goes down by these
    bytes alone, is compared once with the leaf that it meets, and is put in where
    the two part. A leaf holds all equal strings.
    """
    root: list | None = None  # a leaf [content, members] or a branch [depth, {byte: child}, a leaf below]
    for i in members:
        s = int(starts[i])
        w = text[s : s + length]
        if root is None:
            root = [w, [i]]
            continue
        node = root
        while len(node) == 3:
            node = node[1].get(w[node[0]]) or node[2]
        if node[0] == w:
            node[1].append(i)
            continue
        bits = (int.from_bytes(node[0], "big") ^ int.from_bytes(w, "big")).bit_length()
        part = length - (bits + 7) // 8
        leaf, above, node = [w, [i]], None, root
        while len(node) == 3 and node[0] < part:
            above, node = node, node[1][w[node[0]]]
        if len(node) == 3 and node[0] == part:
            node[1][w[part]] = leaf
            continue
        below = node[2] if len(node) == 3 else node
        branch = [part, {below[0][part]: node, w[part]: leaf}, leaf]
        if above is None:
            root = branch
        else:
            above[1][w[above[0]]] = branch
    order, same, todo = [], [], [root]
    while todo:
        node = todo.pop()
        if len(node) == 3:
            todo += [node[1][k] for k in sorted(node[1], reverse=True)]
        else:
            order += node[1]
            same += [False] + [True] * (len(node[1]) - 1)
    return order, same


# A row of the tables below names a range of starts in one number: the first start,
# then 10 bits for how many follow, then 10 bits for how far the anchor is behind it.
def _pack(first, last, at):
    return (first << 20) | ((last - first) << 10) | (at - first)


def occurrences(texts: DataFrame, length: int) -> DataFrame:
    """``id``, ``th``, ``place``, ``anchor``, ``context`` (hash of the bytes that an anchor stands for)."""
    schema = extend(texts.select("id", "th").schema, "place bigint, anchor bigint, context bigint")
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, places, hashes, contexts, size = [], [], [], [], 0

            def give():
                where = pa.array(np.concatenate(owner))
                columns = [batch.column(0).take(where), batch.column(1).take(where)]
                columns += [pa.array(np.concatenate(x).astype(np.int64)) for x in (places, hashes, contexts)]
                return pa.RecordBatch.from_arrays(columns, schema=kind)

            for i, text in enumerate(batch.column(2)):
                data = (text.as_py() or "").encode("utf-8", "replace")
                for first, last, at, hashed in anchors(data, length):
                    owner.append(np.full(len(first), i, np.int64))
                    places.append(_pack(first, last, at))
                    hashes.append(hashed.view(np.int64))
                    spans = zip(first.tolist(), (last + length).tolist())
                    found = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in spans], np.uint64)
                    contexts.append((found ^ (at - first).astype(np.uint64)).view(np.int64))
                    size += len(first)
                if size > 200_000:
                    yield give()
                    owner, places, hashes, contexts, size = [], [], [], [], 0
            if owner:
                yield give()

    return map_arrow(texts, run, schema)


def sort_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """Spans ``id``, ``th``, ``start``, ``stop`` of strings that occur in two contexts of an anchor."""
    schema = extend(contexts.select("id", "th").schema, "start bigint, stop bigint")
    kind = arrow_schema(schema)

    def spans(rows: list[tuple]) -> list[tuple]:
        # Contexts (anchor, id, th, place, bytes) in the order of their anchors.
        text = b"".join(r[4] for r in rows)
        base = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])])
        anchor = np.array([r[0] for r in rows], np.int64)
        place = np.array([r[3] for r in rows], np.int64)
        many = ((place >> 10) & 1023) + 1
        owner = np.repeat(np.arange(len(rows)), many)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        # Equal strings have their anchor at the same place.
        group = np.cumsum(np.concatenate([[0], np.diff(anchor) != 0]))
        bucket = group[owner] * 1024 + ((place & 1023)[owner] - step)
        order, same = deep_shallow(text, base[:-1][owner] + step, bucket, length)
        twice = same.copy()
        twice[:-1] |= same[1:]
        hit = np.sort(order[twice])
        if not len(hit):
            return []
        cut = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)])
        a, b = hit[cut], hit[np.append(np.flatnonzero(cut)[1:], len(hit)) - 1]
        starts = (place >> 20)[owner[a]] + step[a]
        stops = (place >> 20)[owner[b]] + step[b] + length
        return [(*rows[o][1:3], x, y) for o, x, y in zip(owner[a].tolist(), starts.tolist(), stops.tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SUFFIXES and row[0] != held[-1][0]:
                    if found := spans(held):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*found), kind)], schema=kind
                        )
                    held, size = [], 0
                held.append(row)
                size += ((row[3] >> 10) & 1023) + 1
        if held and (found := spans(held)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*found), kind)], schema=kind
            )

    picked = contexts.select("anchor", "id", "th", "place", "bytes")
    return map_arrow(picked.repartition("anchor").sortWithinPartitions("anchor"), run, schema)


def smaller_groups(contexts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of anchors that have very many, as groups that a task can sort.

    A context is cut into runs of at most ``RUN`` starts, aligned at the anchor. Equal runs
    are repeated as a whole; they are the first result, as spans. One of each kind goes
    on with those that have the same core, the bytes which all strings of a run have in
    common: only such runs can share a string. A core with very many kinds is taken apart
    into strings, which go on with their equals, in as many parts as they need. The second
    result is of the form that :func:`sort_contexts` takes, with those groups as anchors.
    """
    ids = contexts.select("id", "th").schema
    run_schema = extend(ids, "place bigint, h1 bigint, h2 bigint, core bigint, bytes binary")
    run_kind = arrow_schema(run_schema)
    string_schema = extend(ids, "place bigint, key bigint, bytes binary")
    string_kind = arrow_schema(string_schema)
    common = max(length - RUN + 1, 0)

    def cut_runs(id_, th, place, data):
        many, behind = ((place >> 10) & 1023) + 1, place & 1023
        k = 0
        while k < many:
            # Up to the next start whose distance to the anchor is a multiple of RUN.
            size = min(many - k, (behind - k) % RUN + 1)
            part = data[k : k + size - 1 + length]
            h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(part), "<i8").tolist()
            step = (behind - k) // RUN
            at = behind - step * RUN
            core = xxhash.xxh3_64_intdigest(data[at : at + common], step) - (1 << 63)
            first = (place >> 20) + k
            yield id_, th, _pack(first, first + size - 1, first + behind - k), h1, h2, core, part
            k += size

    def cut_strings(id_, th, place, core, data):
        many, behind = ((place >> 10) & 1023) + 1, place & 1023
        for k in range(many):
            part, first = data[k : k + length], (place >> 20) + k
            key = xxhash.xxh3_64_intdigest(part, (core + behind - k) & 0xFFFFFFFF) - (1 << 63)
            yield id_, th, _pack(first, first, first + behind - k), key, part

    def over(step, kind: pa.Schema):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 2000):
                    rows = zip(*(c.to_pylist() for c in batch.slice(low, 2000).columns))
                    out = [x for row in rows for x in step(*row)]
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind
                        )

        return run

    picked = contexts.select("id", "th", "place", "bytes")
    runs = materialise(map_arrow(picked, over(cut_runs, run_kind), run_schema))
    kinds = materialise(
        runs.groupBy("h1", "h2").agg(
            F.count("*").alias("n"), F.min(F.struct("id", "th", "place", "core", "bytes")).alias("of")
        )
    )
    twice = kinds.where("n > 1").select("h1", "h2")
    whole = _whole(runs.join(twice.hint("merge"), ["h1", "h2"]), length)

    one = kinds.select("of.*")
    shared = materialise(one.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"))
    grouped = materialise(one.join(shared.hint("merge"), "core"))
    near = grouped.where(F.col("n") <= HOT).withColumnRenamed("core", "anchor")
    far = grouped.where(F.col("n") > HOT).select("id", "th", "place", "core", "bytes")
    strings = materialise(map_arrow(far, over(cut_strings, string_kind), string_schema))
    # The equals of a string are sorted in parts, to each of which one of them is added, so
    # that none is alone among others in its part.
    parts = F.greatest(F.lit(1).cast("bigint"), F.expr(f"n div {HOT}"))
    equal = materialise(
        strings.groupBy("key")
        .agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "place", "bytes")).alias("one"))
        .where("n > 1")
        .withColumn("parts", parts)
    )
    own = F.pmod(F.xxhash64("id", "th", "place"), F.col("parts"))
    members = strings.join(equal.select("key", "parts").hint("merge"), "key").withColumn("part", own)
    added = equal.where("parts > 1").select("key", "parts", "one.*").withColumn("own", own)
    added = added.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    dealt = members.select("key", "part", "id", "th", "place", "bytes").unionByName(
        added.where("part <> own").select("key", "part", "id", "th", "place", "bytes")
    )
    dealt = dealt.withColumn("anchor", F.xxhash64("key", "part"))
    columns = ["anchor", "id", "th", "place", "bytes"]
    return whole, near.select(columns).unionByName(dealt.select(columns))


def _whole(rows: DataFrame, length: int) -> DataFrame:
    """The spans of rows of which all strings are repeated."""
    first = F.shiftright("place", 20)
    last = first + F.shiftright("place", 10).bitwiseAND(1023)
    return rows.select("id", "th", first.alias("start"), (last + length).alias("stop"))


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """Spans ``id``, ``th``, ``start``, ``stop`` that cover exactly the bytes of
    repeated strings. ``texts`` has ``id``, ``th`` (a hash of the text), ``text``."""
    found = occurrences(texts, length)
    counted = found.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi")
    )
    twice = counted.where("n > 1").select(
        "anchor", (F.col("lo") == F.col("hi")).alias("alike"), (F.col("n") > HOT).alias("hot")
    )
    # Written first: adaptive execution splits a hot anchor only if nothing but a
    # shuffle stands between the join and its inputs.
    kept = materialise(found.join(materialise(twice).hint("merge"), "anchor"))

    # Copies of a context are found in parts first, so that a context that a large
    # share of all texts has goes on as one row for each part.
    part = F.pmod(F.xxhash64("id", "th"), F.lit(PARTS))
    same_part = Window.partitionBy("anchor", "context", "part")
    unlike = kept.where(~F.col("alike")).withColumn("part", part)
    unlike = unlike.withColumns(
        {
            "nth": F.row_number().over(same_part.orderBy("id", "th", "place")),
            "many": F.count("*").over(same_part),
        }
    )
    unlike = materialise(unlike)
    rest = unlike.where("nth = 1")
    contexts = materialise(
        rest.groupBy("anchor", "context", "hot").agg(
            F.sum("many").alias("n"), F.min(F.struct("id", "th", "place")).alias("of")
        )
    )
    copied = contexts.where("n > 1").select("anchor", "context")
    scattered = rest.where("many = 1").join(copied.hint("merge"), ["anchor", "context"])

    # One context of each kind is looked up in its text.
    wanted = contexts.groupBy("of.id", "of.th").agg(
        F.collect_list(F.struct("anchor", "of.place", "hot")).alias("wanted")
    )
    wanted = wanted.withColumnsRenamed({"id": "w_id", "th": "w_th"})
    schema = extend(
        texts.select("id", "th").schema, "anchor bigint, place bigint, hot boolean, bytes binary"
    )
    kind = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for id_, th, text, asked in zip(*batch.columns):
                data = text.as_py().encode("utf-8", "replace")
                for x in asked.as_py():
                    first = x["place"] >> 20
                    part = data[first : first + ((x["place"] >> 10) & 1023) + length]
                    out.append((id_.as_py(), th.as_py(), x["anchor"], x["place"], x["hot"], part))
                    size += len(part)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind
                    )
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind
                )

    # Rows that repeat in full would give their contexts twice, which changes nothing:
    # such texts are whole copies of each other.
    same = F.col("id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))
    asked = texts.hint("merge").join(wanted, same).select("id", "th", "text", "wanted")
    cuts = materialise(map_arrow(asked, cut, schema))
    columns = ["anchor", "id", "th", "place", "bytes"]
    of_runs, smaller = smaller_groups(cuts.where("hot"), length)
    return (
        _whole(kept.where("alike"), length)
        .unionByName(_whole(unlike.where("many > 1"), length))
        .unionByName(_whole(scattered, length))
        .unionByName(of_runs)
        .unionByName(sort_contexts(cuts.where("NOT hot").select(columns).unionByName(smaller), length))
    )


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts elsewhere.

    Texts are taken as UTF-8; strings don't cross rows, may overlap, and are judged
    on the input. Returns ``id``, ``n_bytes``, ``n_removed``, ``spans`` (array of
    start and stop of the maximal removed runs), ``kept`` (binary, what remains),
    ``text`` (the same without characters that a cut goes through) and the columns
    named in ``keep``, a row for each row of ``df``. Null texts are
    empty; shorter texts than ``length`` stay as they are; rows that repeat in full
    are copies of each other and lose what reaches ``length``; null ids are allowed.
    """
    rows = df.select(
        column(id_col).alias("id"),
        F.xxhash64(column(text_col)).alias("th"),
        F.coalesce(column(text_col), F.lit("")).alias("text"),
        F.struct(F.lit(1).alias("_"), *[column(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("kept_columns"),
    )
    texts = rows.select("id", "th", "text")
    spans = repeated_spans(texts, length)
    spans = spans.groupBy("id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    spans = spans.withColumnsRenamed({"id": "s_id", "th": "s_th"})
    same = F.col("id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th"))
    joined = rows.hint("merge").join(spans, same, "left").select("id", "text", "found", "kept_columns")
    out = extend(
        joined.select("id", "kept_columns").schema,
        "n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary, text string",
    )
    kind = arrow_schema(out)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, runs, remains, whole = [], [], [], [], []
        for text, found in zip(batch.column(1), batch.column(2)):
            data = text.as_py().encode("utf-8", "replace")
            merged: list[list[int]] = []
            for x in sorted((x["start"], x["stop"]) for x in found.as_py() or ()):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append([*x])
            cuts = [0, *(x for run in merged for x in run), len(data)]
            parts = [data[a:b] for a, b in zip(cuts[::2], cuts[1::2])]
            sizes.append(len(data))
            removed.append(sum(b - a for a, b in merged))
            runs.append([{"start": a, "stop": b} for a, b in merged])
            remains.append(b"".join(parts))
            whole.append("".join(x.decode("utf-8", "ignore") for x in parts))
        columns = [batch.column(0), batch.column(3)]
        columns += [pa.array(x, f.type) for x, f in zip((sizes, removed, runs, remains, whole), list(kind)[2:])]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kind)], schema=kind)

    done = map_batches(joined, cut, out)
    return done.select(
        "id", *[F.col("kept_columns")[f"c{i}"].alias(c) for i, c in enumerate(keep)], "n_bytes", "n_removed", "spans", "kept", "text"
    )
