"""WARC archives as a Python data source: format("warc") of the DataFrame reader and writer.

Reading plans one partition per file. Each record's headers are parsed first; equality and membership predicates on
record_type, record_id, target_uri, refers_to and payload_digest are pushed down and decided on them, and only a wanted record's
payload is decoded, if option payload isn't "false". Files are plain or gzip with a member per record; members that
this writer made carry their length, so an unwanted one is skipped without being inflated.

Writing makes files of about max_file_bytes each, named anew by every attempt; the commit lists those of the attempts
that succeeded in _manifest, and readers of the folder go by that list, so files of lost executors are never read.

A record has record_id, target_uri, record_type, refers_to, payload_sha1 (hex), payload_length and payload. Responses
hold the payload behind a short HTTP header. Revisits hold only that header, which states the payload's length.
Null columns become absent headers and null again when read; a null payload of a response is empty. Control characters in
a target_uri are percent-encoded. Payloads of any length are written whole. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from tideline.llm.common import cut

HEADERS = ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")
_NAMES = dict(zip(("warc-type", "warc-record-id", "warc-target-uri", "warc-date", "warc-refers-to", "warc-payload-digest"), HEADERS))
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_MANIFEST = "_manifest"

#: No header block is longer; a file whose record goes on without an end of headers is not WARC.
MOST_HEADER_BYTES = 1 << 20


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# --- records ---------------------------------------------------------------------------------------------------------


def record_head(kind: str, record_id: str, uri: str | None, refers_to: str | None, sha1: str, length: int, date: str) -> tuple[bytes, bytes]:
    """The WARC headers and the HTTP header in front of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", uri))
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <{refers_to}>")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(http) + (length if kind != 'revisit' else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def member(data: bytes, level: int) -> bytes:
    """One gzip member whose extra field "sl" has its own length and that of its data."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 12 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Record:
    fields: dict[str, str]
    payload_length: int
    payload: bytes | None


def _parse(head: bytes) -> tuple[dict[str, str], int]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    pairs = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}
    fields = {ours: pairs[name] for name, ours in _NAMES.items() if name in pairs}
    for name in ("record_id", "refers_to"):
        if name in fields:
            fields[name] = fields[name].removeprefix("<").removesuffix(">")
    return fields, int(pairs.get("content-length", 0))


def _http_open(data: bytes, block: int) -> bool:
    """Whether data is the start of an HTTP header that goes on behind it."""
    return len(data) < min(block, MOST_HEADER_BYTES) and b"HTTP/".startswith(data[:5]) and b"\r\n\r\n" not in data


def _payload_length(fields: dict[str, str], block: int, http: bytes) -> tuple[int, int]:
    """Length of the HTTP header in front of the payload, and of the payload itself."""
    end = http.find(b"\r\n\r\n") + 4 if http.startswith(b"HTTP/") else 0
    if end < 4:
        return 0, block
    if fields.get("record_type") == "revisit":
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http[:end])
        return end, int(stated[1]) if stated else 0
    return end, block - end


def _from_stream(f: io.BufferedIOBase, wanted, with_payload: bool) -> Iterator[Record]:
    """Records of an uncompressed stream; blocks that nobody wants are passed over."""
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        head = [line]
        while line not in (b"\r\n", b"\n", b""):
            line = f.readline()
            head.append(line)
            if sum(map(len, head[-2:])) > MOST_HEADER_BYTES or len(head) > 10_000:
                raise ValueError("a header block without end")
        fields, block = _parse(b"".join(head).rstrip(b"\r\n"))
        if not wanted(fields):
            f.seek(block, io.SEEK_CUR)
            continue
        if with_payload:
            data = f.read(block)
            begin, length = _payload_length(fields, block, data[:MOST_HEADER_BYTES])
            yield Record(fields, length, data[begin:])
        else:
            http = f.read(min(block, 4096))
            while _http_open(http, block):
                http += f.read(min(block - len(http), 65536))
            _, length = _payload_length(fields, block, http)
            f.seek(block - len(http), io.SEEK_CUR)
            yield Record(fields, length, None)


def _from_members(f: io.BufferedIOBase, wanted, with_payload: bool) -> Iterator[Record]:
    """Records of gzip members that state their length; headers are inflated first, the rest only if it is wanted."""
    while head := f.read(24):
        total = struct.unpack("<I", head[16:20])[0]
        packed = f.read(total - 24)
        inflate = zlib.decompressobj(-15)
        data = inflate.decompress(packed, 4096)
        while (end := data.find(b"\r\n\r\n")) < 0:
            more = inflate.decompress(inflate.unconsumed_tail, 65536)
            if not more or len(data) > MOST_HEADER_BYTES:
                raise ValueError("a header block without end")
            data += more
        fields, block = _parse(data[:end])
        if not wanted(fields):
            continue
        if with_payload:
            data += inflate.decompress(inflate.unconsumed_tail)
            if zlib.crc32(data) != struct.unpack("<I", packed[-8:-4])[0]:
                raise ValueError(f"damaged record {fields.get('record_id')}")
        else:
            while _http_open(data[end + 4 :], block) and (more := inflate.decompress(inflate.unconsumed_tail, 4096)):
                data += more
        body = data[end + 4 : end + 4 + block]
        begin, length = _payload_length(fields, block, body[:MOST_HEADER_BYTES])
        yield Record(fields, length, body[begin:] if with_payload else None)


def read_file(path: str, wanted=lambda fields: True, with_payload: bool = True) -> Iterator[Record]:
    system, name = place(path)
    with system.open_input_file(name) as raw:
        f = io.BufferedReader(raw, 1 << 20)
        start = f.peek(24)[:24]
        if start[:2] != b"\x1f\x8b":
            yield from _from_stream(f, wanted, with_payload)
        elif len(start) == 24 and start[3] == 4 and start[12:14] == b"sl":
            yield from _from_members(f, wanted, with_payload)
        else:
            yield from _from_stream(gzip.GzipFile(fileobj=f), wanted, with_payload)


# --- data source -----------------------------------------------------------------------------------------------------


@dataclass
class File(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload, self.allowed = path, with_payload, []

    def pushFilters(self, filters):
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in HEADERS and f.attribute[0] != "date":
                self.allowed.append((f.attribute[0], frozenset(values)))
            else:
                yield f

    def partitions(self):
        system, name = place(self.path)
        prefix = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ""
        if system.get_file_info(f"{name}/{_MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{name}/{_MANIFEST}") as f:
                return [File(f"{self.path.rstrip('/')}/{x}") for x in json.loads(f.read())]
        listed = system.get_file_info(fs.FileSelector(name, recursive=True))
        return [File(prefix + x.path) for x in sorted(listed, key=lambda x: x.path) if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path)]

    def read(self, partition):
        def wanted(fields):
            return all(fields.get(name) in values for name, values in self.allowed)

        if partition is None:  # there is no file
            return
        rows, size = [], 0
        for r in read_file(partition.path, wanted, self.with_payload):
            digest = r.fields.get("payload_digest")
            if digest is not None:
                r.fields["payload_digest"] = digest.rpartition(":")[2]
            rows.append((*[r.fields.get(h) for h in HEADERS], r.payload_length, *([r.payload] if self.with_payload else [])))
            size += 500 + len(r.payload or b"")
            if size > 8_000_000:
                yield self._batch(rows)
                rows, size = [], 0
        yield self._batch(rows)

    def _batch(self, rows):
        kinds = [pa.string()] * len(HEADERS) + [pa.int64()] + [pa.binary()] * self.with_payload
        names = [*HEADERS, "payload_length", *["payload"] * self.with_payload]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, max_file_bytes: int, level: int, date: str):
        self.path, self.max_file_bytes, self.level, self.date = path, max_file_bytes, level, date

    def write(self, iterator):
        system, folder = place(self.path)
        system.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_sha1", "payload_length", "payload")]
            for i in range(batch.num_rows):
                kind, record_id, uri, refers_to, sha1, length, payload = (c[i].as_py() for c in columns)
                warc, http = record_head(kind, record_id, uri, refers_to, sha1, length, self.date)
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                packed = member(b"".join((warc, http, payload or b"" if kind != "revisit" else b"", b"\r\n\r\n")), self.level)
                out.write(packed)
                size += len(packed)
                if size >= self.max_file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        system, folder = place(self.path)
        system.create_dir(folder, recursive=True)
        manifest, files = f"{folder}/{_MANIFEST}", []
        if system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_stream(manifest) as f:
                files = json.loads(f.read())
        files += [name for m in messages if m is not None for name in m.files]
        with system.open_output_stream(f"{manifest}.new") as f:
            f.write(json.dumps(sorted(files)).encode())
        system.move(f"{manifest}.new", manifest)

    def abort(self, messages):
        """What the attempts wrote is in no manifest, and so is never read."""


class WarcSource(DataSource):
    """Options: path; reading: payload; writing: max_file_bytes, level, date."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        payload = ", payload binary" if self._with_payload() else ""
        return ", ".join(f"{h} string" for h in HEADERS) + ", payload_length bigint" + payload

    def _with_payload(self) -> bool:
        return self.options.get("payload", "true").lower() != "false"

    def reader(self, schema):
        return Reader(self.options["path"], self._with_payload())

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are written to a new folder or added to; mode overwrite isn't supported")
        return Writer(
            self.options["path"], int(self.options.get("max_file_bytes", 1 << 27)), int(self.options.get("level", 1)), self.options.get("date", "1970-01-01T00:00:00Z")
        )


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# --- revisits --------------------------------------------------------------------------------------------------------


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """The records of pages. Of equal payloads of at least min_bytes, the smallest page_id is the response.

    Rows without a page_id come after all others; equal payloads that only such rows have are all responses, as are
    repeated rows of the smallest page_id.
    """
    rows = pages.select(
        F.col(page_id).cast("string").alias("page_id"), F.col(page_id).alias("rank"), F.col(url).alias("target_uri"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumns({"payload_sha1": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    firsts = rows.where(F.col("payload_length") >= min_bytes).groupBy("payload_sha1").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    # payloads of one page need no partner; the others' side stays small next to the pages
    shared = firsts.where("n > 1").select("payload_sha1", "first")
    rows = rows.join(shared, "payload_sha1", "left")
    revisit = (F.col("payload_length") >= min_bytes) & ~F.col("first").eqNullSafe(F.col("rank")) & F.col("first").isNotNull()
    named = F.when(F.col("page_id").isNull(), F.concat(F.lit("urn:uuid:"), F.expr("uuid()"))).otherwise(F.concat(F.lit("urn:page:"), F.col("page_id")))
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).select(
        "record_type", named.alias("record_id"), "target_uri",
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
        "payload_sha1", "payload_length", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(records: DataFrame, path: str, **options) -> None:
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of bytes."""

    @F.arrow_udf("string")
    def base32(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((h if h is None else base64.b32encode(bytes.fromhex(h)).decode() for h in batch.to_pylist()), pa.string())

    return base32(F.sha1(payload))


def measured(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, refers_to, payload_length, payload_digest) of each record, length and digest taken from the bytes.

    Responses are read with their payloads. Revisits have none; they get what was measured on the response that they refer to, if
    its digest is the one that they state, else nulls.
    """
    bodies = read(spark, path).where("record_type = 'response'")
    own = cut(bodies.select("record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_length"), digest(F.col("payload")).alias("payload_digest")))
    stated = read(spark, path, payload=False).where("record_type = 'revisit'").select("record_id", "record_type", "refers_to", F.col("payload_digest").alias("stated"))
    theirs = own.select(F.col("record_id").alias("of"), F.col("payload_length"), "payload_digest").distinct()
    same = (F.col("refers_to") == F.col("of")) & (F.col("stated") == F.col("payload_digest"))
    return own.unionByName(stated.join(theirs, same, "left").select(*own.columns))


def page_number(record_id: Column) -> Column:
    """The page_id in a record id of page_records(); null for records of pages without one."""
    return F.when(record_id.startswith("urn:page:"), F.substring(record_id, 10, 20).cast("long"))
