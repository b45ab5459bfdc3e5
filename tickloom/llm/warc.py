"""WARC archives as a PySpark data source, and deduplicated writing of them.

Reading plans a partition for each stretch of an archive file: gzipped archives have a member for each record, and the
writer leaves an index of where every n-th member begins, so that large files are cut into stretches. Predicates on record
type and on header fields are pushed down: a record's headers are parsed first, and the payload of a record that is
filtered out, or whose payload no column asks for, is passed over without being decoded.

Writing gives each task files of its own, moved to their final names when the job commits; a lost executor's task is
written again under another name, and what it left is not listed in the archive's manifest, which readers follow.

Defined cases. Null payload: empty. Null page_id: never that of a response that others refer to, unless all are null.
Repeated rows of the largest page_id: each is a response. Null url: no target header. Empty archive: an empty table.
Files that stop within a record raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .common import BATCH_BYTES, BATCH_ROWS, cut, small_enough

#: Payloads of fewer bytes are written anew each time.
LEAST_REVISIT_BYTES = 1000
#: An archive file is closed beyond so many compressed bytes.
FILE_BYTES = 256 << 20
#: Stretches of about so many compressed bytes become partitions.
STRETCH_BYTES = 16 << 20
MANIFEST = "_warc_manifest.json"

WRITE_SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
READ_SCHEMA = WRITE_SCHEMA + ", computed_digest string"
#: Columns that headers give, and those headers.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to"}
DATE = "2024-01-01T00:00:00Z"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Of a path or URI: local, or any that pyarrow knows."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def hex_digest(field: str | None) -> str | None:
    """Of a header like sha1:<base32>, the bare lower-case hex digest."""
    if not field:
        return None
    value = field.partition(":")[2] or field
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def record(row: dict) -> bytes:
    """A WARC/1.1 record. A revisit's block has the HTTP header alone."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", DATE), ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()),
        ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if row["record_type"] == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    # a line end within a field would end it
    head = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int, stretch_bytes: int, level: int):
        self.path, self.file_bytes, self.stretch_bytes, self.level = path, file_bytes, stretch_bytes, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = filesystem(self.path)
        fs.create_dir(base, recursive=True)
        files, out, at, marks = [], None, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                files[-1] |= {"bytes": at, "marks": marks}
                out = None

        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, at, marks = fs.open_output_stream(posixpath.join(base, name), compression=None), 0, [0]
                    files.append({"file": name})
                packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                member = packer.compress(record(row)) + packer.flush()
                if at - marks[-1] >= self.stretch_bytes:
                    marks.append(at)
                out.write(member)
                at += len(member)
                if at >= self.file_bytes:
                    close()
        close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = filesystem(self.path)
        fs.create_dir(base, recursive=True)
        listed = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(posixpath.join(base, MANIFEST)) as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = filesystem(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(posixpath.join(base, f["file"]))


@dataclass
class Stretch(InputPartition):
    file: str
    start: int
    end: int | None

    def __init__(self, file: str, start: int, end: int | None):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


class Members:
    """A file from one offset to another as a stream of decoded bytes that can be passed over."""

    def __init__(self, raw, start: int, end: int | None, gzipped: bool):
        raw.seek(start)
        self.raw, self.left, self.gzipped = raw, None if end is None else end - start, gzipped
        self.buffer, self.packed, self.unpacker = bytearray(), b"", None

    def _more(self) -> bool:
        if not self.packed:
            n = 1 << 18 if self.left is None else min(1 << 18, self.left)
            self.packed = self.raw.read(n) if n else b""
            if self.left is not None:
                self.left -= len(self.packed)
        if not self.packed:
            if self.unpacker is not None:
                raise ValueError("the archive ends within a gzip member")
            return False
        if not self.gzipped:
            self.buffer += self.packed
            self.packed = b""
            return True
        self.unpacker = self.unpacker or zlib.decompressobj(31)
        self.buffer += self.unpacker.decompress(self.packed)
        if self.unpacker.eof:
            self.packed, self.unpacker = self.unpacker.unused_data, None
        else:
            self.packed = b""
        return True

    def pass_line_ends(self) -> None:
        """Those that part records."""
        while True:
            n = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
            del self.buffer[:n]
            if self.buffer or not self._more():
                return

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with a mark; None at the end."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends within a record's header")
                return None
        found = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return found

    def take(self, n: int, wanted: bool = True) -> bytes:
        """The next n bytes; nothing is gathered if they are not wanted."""
        found = bytearray()
        while n:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends within a record")
            part = min(n, len(self.buffer))
            if wanted:
                found += self.buffer[:part]
            del self.buffer[:part]
            n -= part
        return bytes(found)


def records(members: Members, keep, payload: bool) -> Iterator[dict]:
    """Records that keep(headers) wants: their headers, in lower case, with http_length and payload where asked for."""
    while True:
        members.pass_line_ends()
        if (head := members.until(b"\r\n\r\n")) is None:
            return
        lines = head.decode("utf-8", "replace").strip().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers.get("content-length", 0))
        if not keep(headers):
            members.take(length, wanted=False)
            continue
        is_http = headers.get("content-type", "").startswith("application/http")
        body, http = length, b""
        if is_http and length:
            http = members.until(b"\r\n\r\n") or b""
            body -= len(http)
        for line in http.split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                headers["http_length"] = int(line.split(b":")[1])
        headers["payload"] = members.take(body, wanted=payload)
        headers["payload_read"] = body
        yield headers


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, stretch_bytes: int):
        self.path, self.names, self.stretch_bytes = path, schema.fieldNames(), stretch_bytes
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((HEADERS[column], "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((HEADERS[column], "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((HEADERS[column], "prefix", (f.value,)))
            else:
                yield f

    def keeps(self, headers: dict) -> bool:
        for name, how, values in self.tests:
            value = headers.get(name)
            if value is None or not (value in values if how == "in" else value.startswith(values)):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        fs, base = filesystem(self.path)
        found: list[InputPartition] = []
        info = fs.get_file_info(base)
        if info.type == pafs.FileType.File:
            return [Stretch(base, 0, None)]
        manifest = posixpath.join(base, MANIFEST)
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                for x in json.loads(f.read()):
                    ends = [*x["marks"][1:], x["bytes"]]
                    found += [Stretch(posixpath.join(base, x["file"]), a, b) for a, b in zip(x["marks"], ends)]
        else:
            selected = pafs.FileSelector(base, recursive=True)
            found = [Stretch(x.path, 0, None) for x in fs.get_file_info(selected) if x.path.endswith((".warc", ".warc.gz"))]
        return found or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for row in self._rows(partition) if partition.file else ():
            rows.append(row)
            size += sum(len(v) for v in row if isinstance(v, bytes))
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        columns = [pa.array(c, kinds.get(n, pa.string())) for n, c in zip(self.names, zip(*rows))]
        return pa.RecordBatch.from_arrays(columns, names=self.names)

    def _rows(self, partition: Stretch) -> Iterator[tuple]:
        fs, _ = filesystem(self.path)
        asked = set(self.names)
        payload = bool({"payload", "computed_digest"} & asked)
        with fs.open_input_file(partition.file) as raw:
            members = Members(raw, partition.start, partition.end, partition.file.endswith(".gz"))
            for h in records(members, self.keeps, payload):
                held = payload and h.get("warc-type") != "revisit"
                values = {c: h.get(name) for c, name in HEADERS.items()} | {
                    "payload_digest": hex_digest(h.get("warc-payload-digest")), "payload_bytes": h.get("http_length", h["payload_read"]),
                    "payload": h["payload"] if held else None,
                    "computed_digest": hashlib.sha1(h["payload"]).hexdigest() if held and "computed_digest" in asked else None,
                }
                yield tuple(values[n] for n in self.names)


class WarcDataSource(DataSource):
    """Options: path; file_bytes, stretch_bytes, level (gzip) for writing; a schema of some of READ_SCHEMA's columns for reading."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("stretch_bytes", STRETCH_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        path = self.options["path"]
        fs, base = filesystem(path)
        if overwrite and fs.get_file_info(base).type == pafs.FileType.Directory:
            fs.delete_dir_contents(base)
        return WarcWriter(path, int(self.options.get("file_bytes", FILE_BYTES)), int(self.options.get("stretch_bytes", STRETCH_BYTES)), int(self.options.get("level", 6)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def record_rows(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """pages(page_id, url, html) as rows of WRITE_SCHEMA: of equal payloads of least_bytes and more the largest page_id's
    is a response, the others revisit it."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    # of payloads that occur once nothing need be looked up
    twice = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("of"), F.count("*").alias("n"))
    twice = cut(twice.where("n > 1 and of is not null").select(F.col("digest").alias("again"), "of"))
    if small_enough(twice, 64):
        twice = F.broadcast(twice)
    rows = rows.join(twice, (F.col("digest") == F.col("again")) & (F.col("payload_bytes") >= least_bytes), "left")
    revisits = F.col("of").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("of")))
    ident = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.coalesce(ident(F.col("page_id")), F.lit("<urn:page:>")).alias("record_id"),
        F.col("url").alias("target_uri"), F.when(revisits, ident(F.col("of"))).alias("refers_to"), F.col("digest").alias("payload_digest"),
        "payload_bytes", F.when(~revisits, F.col("payload")).alias("payload"),
    )


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_REVISIT_BYTES, **options) -> None:
    register(pages.sparkSession)
    record_rows(pages, least_bytes).write.format("warc").mode("overwrite").options(**options).save(path)


def read_archive(spark: SparkSession, path: str, columns: str = READ_SCHEMA) -> DataFrame:
    """columns: those of READ_SCHEMA that are wanted; without payload and computed_digest no payload is gathered."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def page_number(ident: Column) -> Column:
    return F.nullif(F.regexp_extract(ident, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
