"""WARC archives compressed record by record with a dictionary of their own.

Each archive begins with a skippable Zstandard frame that holds a dictionary built
from the archive's own records; each record is a frame of its own compressed with
it, so that a reader can start at any record. Equal payloads are stored once: one
record is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabflow.llm.shared import arrow_schema, column, map_arrow, materialise, shared_folder

#: Fixed values of the format: a skippable frame for dictionaries, and a data frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: The dictionary learns from the first records of an archive, up to so many bytes.
LEARN_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
#: An archive is closed when it has reached so many bytes.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; a revisit has no payload."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: text/html; charset=utf-8",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {0 if revisit else len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%0A" for c in url))
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't match its header")
    return fields, rest[:size]


def learn_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records; None when there is too little to learn from."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:  # samples that have nothing in common
        return None


class Archive:
    """An archive being written. It counts only once its row is in the manifest."""

    def __init__(self, target: fs.FileSystem, path: str, level: int):
        self.target, self.path, self.level = target, path, level
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.records = self.bytes = 0
        self.stream = target.open_output_stream(path)
        self.compressor = None

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def start(self) -> None:
        learned = learn_dictionary(self.waiting)
        content = learned.as_bytes() if learned else b""
        self.put(struct.pack("<II", SKIPPABLE, len(content)) + content)
        self.compressor = zstandard.ZstdCompressor(self.level, dict_data=learned, write_checksum=True)
        for x in self.waiting:
            self.put(self.compressor.compress(x))
        self.waiting = []

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compressor:
            self.put(self.compressor.compress(data))
            return
        self.waiting.append(data)
        self.waiting_bytes += len(data)
        if self.waiting_bytes >= LEARN_BYTES:
            self.start()

    def close(self) -> tuple[str, int, int]:
        if not self.compressor:
            self.start()
        self.stream.close()
        return self.path, self.records, self.bytes


def plan_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = 1000,
) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (binary), ``digest``, ``refers_to``.

    Of the rows whose equal payload has ``least_bytes`` or more, that with the
    largest id is the response (rows that repeat this id too) and the others refer
    to it. Null payloads are empty; null ids refer to the largest id, and are
    responses where there is none. Only digests that occur twice are joined back,
    so adaptive execution can split a hot payload or broadcast a short list.
    """
    rows = pages.select(
        column(id_col).alias("page_id"),
        column(url_col).cast("string").alias("url"),
        F.coalesce(column(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= least_bytes
    repeated = (
        rows.where(large)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("last"))
        .where("n > 1 AND last IS NOT NULL")
        .select(F.col("digest").alias("d"), "last")
    )
    joined = rows.join(repeated, F.col("digest") == F.col("d"), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("last")), F.col("last"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(
    planned: DataFrame, folder: str, level: int = 6, date: str = "2000-01-01T00:00:00Z"
) -> DataFrame:
    """Write the planned records below ``folder``; the manifest of what was written.

    Each task writes archives of about ``ARCHIVE_BYTES`` under names of its own and
    returns ``path``, ``records``, ``bytes`` of each. A task that is run again
    leaves its former files unlisted, so a lost executor neither loses nor repeats
    a record. ``folder`` is a URI that Arrow's file systems open on all executors.
    """
    schema = "path string, records bigint, bytes bigint"
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        done, archive = [], None
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None:
                    archive = Archive(target, f"{base}/{uuid.uuid4().hex}.warc.zst", level)
                archive.add(record(page_id, url, payload, digest, refers_to, date))
                if archive.bytes >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], schema=kind)

    return materialise(map_arrow(planned, run, schema))


def frames(stream) -> Iterator[bytes]:
    """The records of an open archive one by one."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    content = stream.read(size)
    learned = zstandard.ZstdCompressionDict(content) if size else None
    decompressor = zstandard.ZstdDecompressor(dict_data=learned)
    data, parts, frame = b"", [], decompressor.decompressobj()
    while True:
        if not data:
            data = stream.read(READ_BYTES)
            if not data:
                break
        parts.append(frame.decompress(data))
        data = b""
        if frame.eof:
            yield b"".join(parts)
            data, parts, frame = frame.unused_data, [], decompressor.decompressobj()
    if any(parts):
        raise ValueError("the archive ends within a record")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of all archives of a manifest.

    Returns ``page_id`` (text), ``record_type``, ``refers_to`` (text),
    ``payload_bytes``, ``payload_digest`` (hexadecimal), ``payload`` (null for a
    revisit). A response whose block doesn't have the length and digest of its header
    raises, as does an archive that doesn't have as many records as the manifest says.
    """
    schema = (
        "page_id string, record_type string, refers_to string, payload_bytes bigint, "
        "payload_digest string, payload binary"
    )
    kind = arrow_schema(schema)

    def rows(path: str, records: int):
        target, _ = fs.FileSystem.from_uri(folder)
        seen = 0
        with target.open_input_stream(path) as stream:
            for data in frames(stream):
                seen += 1
                head, block = parse(data)
                which = head["warc-type"]
                digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                size = int(head["x-payload-length"])
                if which == "response" and (len(block) != size or hashlib.sha1(block).hexdigest() != digest):
                    raise ValueError(f"{path}: payload and header disagree")
                bare = [
                    head[k].removeprefix("<urn:page:").removesuffix(">") if k in head else None
                    for k in ("warc-record-id", "warc-refers-to")
                ]
                yield bare[0] or None, which, bare[1], size, digest, block if which == "response" else None
        if seen != records:
            raise ValueError(f"{path}: {seen} records, the manifest has {records}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, size = [], 0
                for row in rows(path, records):
                    held.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind
                        )
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*held), kind)], schema=kind
                    )

    # A number of partitions is asked for, since adaptive execution would merge the few
    # bytes of a manifest, and one task would read all archives.
    conf = manifest.sparkSession.conf
    tasks = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    tasks = int(tasks or conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(manifest.select("path", "records").repartition(tasks, "path"), run, schema)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI. A path without a scheme is on the default file system of the
    cluster, where Spark puts its own tables, and not on each machine's disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    uri = store.makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if re.match("file:/[^/]", uri) else uri


def archive_pages(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html", least_bytes: int = 1000,
) -> DataFrame:
    """Write all rows as archives and read them back, in the form of :func:`read_archives`.

    A record for each row, repeated rows included; no rows give no archive.
    """
    target = qualified(pages.sparkSession, folder or f"{shared_folder(pages.sparkSession)}/warc")
    manifest = write_archives(plan_records(pages, id_col, url_col, payload_col, least_bytes), target)
    return read_archives(manifest, target)
