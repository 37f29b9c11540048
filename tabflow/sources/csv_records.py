"""Records of large CSV files whose quoted cells may hold line breaks, found by many tasks.

Spark splits a text file at line ends wherever it likes, so a task can't know whether its
first line is inside a quoted cell. Each task works out, for both cases, whether its
byte range ends inside one; put together in the order of a file, that tells of
each range in which case it is. With that known, tasks join the lines of their records
on their own. A record that goes on in the next range is put together apart, of
which a range has two pieces at most. Spark's own parser then reads the records.

Three reads of the files in many tasks take the place of one read in one task.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.shipping import ship


def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a line ends inside a quoted cell, given whether it begins in one.

    A quote opens a cell only as its first character, and within it two quotes stand
    for one; any other quote is an ordinary character.
    """
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside and line.startswith('"', at):
            inside, at = True, at + 1
        while inside:
            at = line.find('"', at) + 1
            if not at:
                return True
            if line.startswith('"', at):
                at += 1
            else:
                inside = False
        at = line.find(sep, at) + len(sep)
        if at < len(sep):
            return False


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; the last column is the one that may be long."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[-1]) if isinstance(row[-1], str) else 8
        if size > 1 << 23 or len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
            )
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
        )


def _runner(step, ddl: str, **settings):
    """``step`` over rows, for ``mapInArrow``."""
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
    return lambda batches: _batches(step(_rows(batches), **settings), schema)


def _range_ends(rows, sep: str):
    """(file, at, line or null) to one row per range: whether it ends inside a quoted cell
    if it begins outside and if it begins inside one."""
    now, ends = None, (False, True)
    for file, at, line in rows:
        if now != (file, at):
            if now:
                yield (*now, *ends)
            now, ends = (file, at), (False, True)
        if line is not None:
            ends = tuple(inside_after(line, x, sep) for x in ends)
    if now:
        yield (*now, *ends)


def _states(rows):
    """The ranges of files in order: whether each begins and ends inside a quoted cell."""
    file, inside = None, False
    for this, at, if_outside, if_inside in rows:
        if this != file:
            file, inside = this, False
        begins, inside = inside, if_inside if inside else if_outside
        yield this, at, begins, inside


def _check_header(text: str, names: list[str] | None) -> None:
    found = next(csv.reader([text.lstrip("\ufeff")]), [])
    if names is not None and [c.casefold() for c in found] != [n.casefold() for n in names]:
        raise ValueError(f"CSV header {found} does not conform to the schema's columns {names}")


def _pieces(rows, sep: str):
    """(file, at, begins inside, line) to pieces (file, at, kind, closed, text): the end of
    a record begun before the range (kind 0), whole records (1), and the beginning of
    one that goes on after it (2)."""
    now, lines, kind, inside = None, [], 1, False
    for file, at, begins, line in rows:
        if now != (file, at):
            if lines:
                yield (*now, 0 if kind == 0 else 2, False, "\n".join(lines))
            now, lines, inside, kind = (file, at), [], bool(begins), 0 if begins else 1
        lines.append(line)
        inside = inside_after(line, inside, sep)
        if not inside:
            yield file, at, kind, True, "\n".join(lines)
            lines, kind = [], 1
    if lines:
        yield (*now, 0 if kind == 0 else 2, False, "\n".join(lines))


def _records(rows, sep: str, header: bool, names: list[str] | None):
    """The whole records of ranges, without header rows and empty ones."""
    top = None
    for file, at, kind, _, text in _pieces(rows, sep):
        if kind != 1:
            continue
        text = text.removesuffix("\r")
        if header and at == 0 and top != file and text:
            top = file
            _check_header(text, names)
        elif text:
            yield (text,)


def _loose(rows, sep: str):
    """The pieces of records that a range holds in part."""
    return (piece for piece in _pieces(rows, sep) if piece[2] != 1)


def _joined(rows):
    """Records from their pieces in order."""
    file, parts = None, []
    for this, _, kind, closed, text in rows:
        if parts and (this != file or kind == 2):
            yield ("\n".join(parts),)  # the file ended inside a quoted cell
            parts = []
        file = this
        parts.append(text)
        if closed:
            yield ("\n".join(parts).removesuffix("\r"),)
            parts = []
    if parts:
        yield ("\n".join(parts),)


def record_texts(
    spark: SparkSession,
    path: str,
    *,
    sep: str = ",",
    header: bool = True,
    names: list[str] | None = None,
) -> DataFrame:
    """``record``: the text of each record of CSV files, read by as many tasks as Spark
    splits the files into. Header rows are left out, and compared with ``names`` if
    given; empty lines between records are left out too."""
    ship(spark.sparkContext)
    place = [F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*place, "value")
    quoted = lines.select("f", "at", F.when(F.col("value").contains('"'), F.col("value")).alias("value"))
    ends = "f bigint, at bigint, if_outside boolean, if_inside boolean"
    ranges = quoted.mapInArrow(_runner(_range_ends, ends, sep=sep), ends)
    known = "f bigint, at bigint, begins boolean, ends boolean"
    ordered = ranges.repartition("f").sortWithinPartitions("f", "at")
    states = ordered.mapInArrow(_runner(_states, known), known)
    # One row per byte range, of which there is one per spark.sql.files.maxPartitionBytes.
    placed = lines.join(F.broadcast(states), ["f", "at"]).select("f", "at", "begins", "ends", "value")

    settings = {"sep": sep, "header": header, "names": names}
    records = placed.drop("ends").mapInArrow(_runner(_records, "record string", **settings), "record string")
    piece = "f bigint, at bigint, kind int, closed boolean, text string"
    loose = placed.where("begins OR ends").drop("ends").mapInArrow(_runner(_loose, piece, sep=sep), piece)
    loose = loose.repartition("f").sortWithinPartitions("f", "at", "kind")
    return records.unionByName(loose.mapInArrow(_runner(_joined, "record string"), "record string"))
