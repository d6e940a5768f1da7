"""WARC archives as a Spark data source, written and read in Python.

Writing makes one archive per task under a name of its own attempt; the commit lists the archives
of the attempts that count in a manifest, so what a lost or repeated task left is never read. Every commit adds a
manifest of its own, and an overwriting one takes the earlier ones and their archives away. Every record is
a gzip member whose extra field states its compressed size.

Reading plans partitions from the manifests: a file is cut at record boundaries noted while
writing (archives without a manifest are one partition each). Predicates on record type and header
fields are pushed down. A record's headers are inflated first; if the predicates
refuse it, or payloads are not asked for, the reader seeks past the rest of the member without inflating it.

Paths are opened by pyarrow's file systems, so they may lie on any store these know.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from cubegraph.llm.base import join_on, read, register, store
from cubegraph.session import shared_path

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_length long, payload binary"
)
#: Column -> header field.
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
#: Every commit leaves a manifest of its own, so archives written before stay known.
MANIFEST = "_manifest-{}.json"
SPLIT_BYTES = 8 << 20
ROTATE_BYTES = 1 << 30
HEAD_BYTES = 2048
BATCH_BYTES = 16 << 20
DEFAULT_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_HEAD = struct.Struct("<4BIBBH2sHII")


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is a local one."""
    if re.match(r"file:/(?!//)", path):
        path = path[len("file:") :]
    return pafs.FileSystem.from_uri(path)


def member(data: bytes) -> bytes:
    """A gzip member; its extra field 'sl' holds the compressed and the plain size."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = GZIP_HEAD.size + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if size >= 1 << 32 or len(data) >= 1 << 32:  # sizes that the field can't hold: a plain member
        return struct.pack("<4BIBB", 31, 139, 8, 0, 0, 0, 255) + body + tail
    return GZIP_HEAD.pack(31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(data)) + body + tail


def safe(value: str) -> str:
    """A header value without control characters, which would end the field."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict) -> bytes:
    """One record: WARC headers, then a block of HTTP headers and the payload (none for a revisit)."""
    kind, payload = row["record_type"] or "resource", row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    block = b""
    if kind in ("response", "revisit"):
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
        block = http.encode()
    if kind != "revisit":
        block += payload
    lines = ["WARC/1.1"]
    for column, field in FIELDS.items():
        value = row.get(column)
        if value is None and column in ("record_type", "date"):
            value = kind if column == "record_type" else DEFAULT_DATE
        if value is not None:
            text = safe(value)
            lines.append(f"{field}: <{text}>" if column in ("record_id", "refers_to") else f"{field}: {text}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    if block.startswith(b"HTTP/"):
        lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    #: (file name, offsets at which a reader may begin, size)
    files: list[tuple[str, list[int], int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files, out, at = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or at >= ROTATE_BYTES:
                        if out is not None:
                            out.close()
                            files[-1] = (*files[-1][:2], at)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        files.append((name, [0], 0))
                        out, at = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                    if at - files[-1][1][-1] >= SPLIT_BYTES:
                        files[-1][1].append(at)
                    data = member(record(row))
                    out.write(data)
                    at += len(data)
        finally:
            if out is not None:
                out.close()
        if files:
            files[-1] = (*files[-1][:2], at)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        before = [f.path for f in manifests(fs, root)] if self.overwrite else []
        with fs.open_output_stream(f"{root}/{MANIFEST.format(uuid.uuid4().hex)}", compression=None) as out:
            out.write(json.dumps(files).encode())
        for old in before:
            names = listed(fs, old)
            fs.delete_file(old)
            for name, _, _ in names:
                fs.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            for name, _, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


def manifests(fs: pafs.FileSystem, root: str) -> list[pafs.FileInfo]:
    """The manifests of all commits to a folder, in the order of their names."""
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((f for f in found if re.fullmatch(r"_manifest-\w+\.json", f.base_name)), key=lambda f: f.path)


def listed(fs: pafs.FileSystem, manifest: str) -> list[tuple[str, list[int], int]]:
    with fs.open_input_stream(manifest, compression=None) as f:
        return json.loads(f.read())


class Source:
    """A buffered file that can pass over bytes without reading them."""

    def __init__(self, fs: pafs.FileSystem, path: str, begin: int, end: int | None):
        self.file = io.BufferedReader(fs.open_input_file(path), 1 << 18)
        self.file.seek(begin)
        self.end = end

    def ahead(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer only at the end of the file; a buffer may end within them."""
        found = self.file.peek(n)[:n]
        if len(found) < n:
            at = self.file.tell()
            found = self.file.read(n)
            self.file.seek(at)
        return found

    def done(self) -> bool:
        if self.end is not None and self.file.tell() >= self.end:
            return True
        return not self.file.peek(1)


class Inflated:
    """The plain bytes of one member: read in parts, or passed over."""

    def __init__(self, source: Source):
        self.file = source.file
        self.at = self.file.tell()
        head = source.ahead(GZIP_HEAD.size)
        self.size = None
        if len(head) == GZIP_HEAD.size and head[3] & 4 and head[12:14] == b"sl":
            self.size = GZIP_HEAD.unpack(head)[10]
        self.engine = zlib.decompressobj(31)

    def read(self, most: int) -> bytes:
        """Up to ``most`` plain bytes; fewer only at the end of the member."""
        parts = []
        while most > 0 and not self.engine.eof:
            data = self.engine.unconsumed_tail or self.file.read(min(1 << 16, max(most, HEAD_BYTES)))
            if not data:
                break
            parts.append(self.engine.decompress(data, most))
            most -= len(parts[-1])
        return b"".join(parts)

    def finish(self) -> None:
        """Go to the next member; without a stated size the rest has to be inflated, in bounded parts."""
        if self.size is not None:
            self.file.seek(self.at + self.size)
            return
        while not self.engine.eof and self.read(1 << 20):
            pass
        self.file.seek(self.file.tell() - len(self.engine.unused_data))


class Plain:
    """One record of an archive that is not compressed."""

    def __init__(self, source: Source):
        self.file, self.at, self.size = source.file, source.file.tell(), None

    def read(self, most: int) -> bytes:
        return self.file.read(most)

    def finish(self) -> None:
        self.file.seek(self.size)


def parse_headers(head: bytes) -> dict[str, str]:
    """Lower-case field name -> value; a continued line belongs to the field before it."""
    fields: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields


def columns_of(fields: dict[str, str]) -> dict[str, str | None]:
    out = {}
    for column, field in FIELDS.items():
        value = fields.get(field.lower())
        if value is not None and column in ("record_id", "refers_to"):
            value = value.removeprefix("<").removesuffix(">")
        out[column] = value
    return out


def records(source: Source, wanted: Callable[[dict], bool], payloads: bool) -> Iterator[dict]:
    """The records whose header columns ``wanted`` accepts."""
    while not source.done():
        entry = Inflated(source) if source.ahead(2) == b"\x1f\x8b" else Plain(source)
        read, looked = bytearray(), 0
        while read.find(b"\r\n\r\n", looked) < 0:
            looked = max(len(read) - 3, 0)  # what was looked through is not looked through again
            more = entry.read(HEAD_BYTES)
            if not more:
                break
            read += more
        if not read.strip():
            break
        head, _, data = bytes(read).partition(b"\r\n\r\n")
        fields = parse_headers(head)
        length = int(fields.get("content-length", 0))
        if isinstance(entry, Plain):
            entry.size = entry.at + len(head) + 4 + length + 4
        row = columns_of(fields)
        if wanted(row):
            http = fields.get("content-type", "").startswith("application/http")
            while http and len(data) < length and b"\r\n\r\n" not in data:
                more = entry.read(min(HEAD_BYTES, length - len(data)))
                if not more:
                    break
                data += more
            inner, begin = {}, 0
            if http and b"\r\n\r\n" in data[:length]:
                begin = data.index(b"\r\n\r\n") + 4
                inner = parse_headers(data[: begin - 4])
            stated = inner.get("content-length", "")
            row["payload_length"] = int(stated) if stated.isdigit() else length - begin
            row["payload"] = None
            if payloads:
                if len(data) < length:
                    data += entry.read(length - len(data))
                row["payload"] = data[begin:length]
            yield row
        entry.finish()


def accepts(f: Filter) -> Callable[[dict], bool] | None:
    """A test of header columns that equals the filter, None where headers don't decide it."""
    inner = f.attribute if hasattr(f, "attribute") else None
    if not inner or len(inner) != 1 or inner[0] not in FIELDS:
        return None
    name = inner[0]
    value = getattr(f, "value", None)
    tests = {
        EqualTo: lambda x: x is not None and x == value,
        EqualNullSafe: lambda x: x == value,
        In: lambda x: x is not None and x in value,
        IsNull: lambda x: x is None,
        IsNotNull: lambda x: x is not None,
        StringStartsWith: lambda x: x is not None and x.startswith(value),
        StringEndsWith: lambda x: x is not None and x.endswith(value),
        StringContains: lambda x: x is not None and value in x,
    }
    test = tests.get(type(f))
    return (lambda row: test(row[name])) if test else None


@dataclass
class Part(InputPartition):
    path: str
    begin: int
    end: int | None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads, self.filters = path, payloads, []

    def pushFilters(self, filters):
        for f in filters:
            if accepts(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Part]:
        fs, root = open_fs(self.path)
        known = manifests(fs, root)
        if known:
            return [
                Part(name, begin, end)
                for manifest in known
                for name, starts, size in listed(fs, manifest.path)
                for begin, end in zip(starts, [*starts[1:], size])
            ]
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return [Part(f.path[len(root) + 1 :], 0, None) for f in found if re.search(r"\.warc(\.gz)?$", f.path)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive at all
            return
        fs, root = open_fs(self.path)
        tests = [accepts(f) for f in self.filters]
        source = Source(fs, f"{root}/{partition.path}", partition.begin, partition.end)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string() for n in names]
        rows, room = [], BATCH_BYTES

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names
            )

        for row in records(source, lambda r: all(t(r) for t in tests), self.payloads):
            rows.append(row)
            room -= 500 + len(row["payload"] or b"")
            if room <= 0:
                yield batch()
                rows, room = [], BATCH_BYTES
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    """format("warc"); options: path, and payloads = false to leave payloads undecoded (null)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payloads", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def use(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark


LEAST_REVISITED = 100


def page_records(pages: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """The record of each page, in the data source's columns; repeated payloads of ``least`` bytes become revisits."""
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(
        "page_id", "url", html.cast("binary").alias("payload"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size")
    )
    shared = (
        rows.filter(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "size", "first")
    )
    rows = join_on(rows, store(shared, "shared-payloads"), ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(DEFAULT_DATE).alias("date"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.col("size").alias("payload_length"),
        F.when(revisit, F.lit(None).cast("binary")).otherwise(F.col("payload")).alias("payload"),
    )


def archived(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as WARC archives under ``path``."""
    use(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").option("path", path).save()


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the archives under ``path``.

    Bytes and digest of a response are taken from its decoded payload; revisits are read without payloads.
    """
    use(spark)
    archive = spark.read.format("warc").option("path", path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS long)")
    responses = archive.load().filter(F.col("record_type") == "response").select(
        number("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = archive.option("payloads", "false").load().filter(F.col("record_type") == "revisit").select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.substring("payload_digest", 8, 64).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
    return responses.unionByName(revisits)


def through_archives(pages: DataFrame) -> DataFrame:
    """The pages written as archives in the shared folder, and what reading these back gives.

    Null html counts as empty, a null url or page_id leaves its header out and reads back as null. Of rows that
    repeat a page_id with its payload, all that have the smallest id are responses. A payload
    that only pages without an id hold has no revisits. An empty table gives an empty result. Only page_id, url and html are read.
    """
    path = shared_path(pages.sparkSession, "llm-warc")
    archived(pages, path)
    return pages_of(pages.sparkSession, path)


@register(
    """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 THEN MIN(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS first
  FROM (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha256(h) AS d FROM (SELECT page_id, COALESCE(html, '') AS h FROM pages)))"""
)
def op3_warc_archives(spark, sf_dir):
    return through_archives(read(spark, sf_dir, "pages"))
